"""Whole jobs over raw tables and the warehouse, composed from the operators."""
