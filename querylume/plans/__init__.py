"""Choice of tables, and the catalogue of named queries."""
