"""Training-data operators: one module each, with its query; nothing else in the library imports this package."""
