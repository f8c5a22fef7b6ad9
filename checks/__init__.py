"""Queries over the star-schema test tables, each with the SQL it is checked against."""
