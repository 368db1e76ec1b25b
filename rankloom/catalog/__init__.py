"""The queries by name, each with the SQL that gives the same result where SQL can express it."""
