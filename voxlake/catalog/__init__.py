"""The library's queries over the usual tables, each with the SQL that gives the same rows where SQL can."""
