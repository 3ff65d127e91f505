"""Named queries over the test tables, each with a plain SQL twin where one exists."""
