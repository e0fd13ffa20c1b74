"""Reading and writing tables and vault files."""
