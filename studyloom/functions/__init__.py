"""Column functions: text cleaning, question parts, formats and checks."""
