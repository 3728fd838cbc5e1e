"""Reading raw files and live tables, and storing the normalized tables."""
