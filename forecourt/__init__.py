"""Used-vehicle dealership analytics on Spark DataFrames."""

from forecourt.tables import Tables, conform, empty_tables, seed_rows

__all__ = ["Tables", "conform", "empty_tables", "seed_rows"]
