"""Learning-content analytics and training-data preparation on Spark."""
