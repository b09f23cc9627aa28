"""Reading files and tables, writing tables, files and audit rows."""
