"""Named queries over a folder of test tables, and the SQL each is checked against."""
