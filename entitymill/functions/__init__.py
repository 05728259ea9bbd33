"""Column-to-column expressions: no shuffle, no Python on the data path."""
