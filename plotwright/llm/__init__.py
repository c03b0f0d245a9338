"""Training-data operators that the rest of the library does not import."""
