"""Named queries over the test tables, with the SQL each one is checked against."""
