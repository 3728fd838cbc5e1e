"""Training-data operators on document collections.  Nothing else in the library imports this subpackage."""
