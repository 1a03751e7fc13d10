"""Query catalogue of the engine and the SQL that must return the same rows."""
