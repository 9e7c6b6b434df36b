"""Operators on regions, sequences, features, models and curves."""
