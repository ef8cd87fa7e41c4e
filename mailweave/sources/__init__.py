"""Sources: the driver tables, derived fixtures and landing folders."""
