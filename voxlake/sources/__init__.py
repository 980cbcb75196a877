"""Volume files, views of plain tables, reports and runs."""
