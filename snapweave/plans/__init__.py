"""Written intermediate tables, fixtures over the test tables, and the registered queries."""
