"""Column functions with the exact semantics that the data model asks for."""
