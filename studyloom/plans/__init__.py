"""Whole flows made of operators, and the catalogue of registered queries."""
