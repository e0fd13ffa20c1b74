"""Named queries over the tables of a data folder, each with the SQL that gives the same rows."""
