"""Named queries over the test tables, with the SQL that they are checked against."""
