"""Column-level functions: parsing, time fields, hashing and score combination."""
