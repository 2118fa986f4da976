"""Fixed values, as data."""
