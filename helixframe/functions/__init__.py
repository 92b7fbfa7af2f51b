"""Column functions: everything here maps Columns to a Column."""
