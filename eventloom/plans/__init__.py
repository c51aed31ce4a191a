"""The registered queries over the standard tables, by theme, each with the SQL it is checked against."""
