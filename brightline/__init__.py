"""Evidence analytics on Spark: DataFrame operators, sources, functions and named query plans."""
