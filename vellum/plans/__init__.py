"""Query catalogue, staging of intermediate tables, session defaults."""
