"""Sources: fixture mapping of the test tables, file readers, staging."""
