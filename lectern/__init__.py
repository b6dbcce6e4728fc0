"""Reading-data analytics on Spark: text, positions, sessions, catalogue, sources and streams."""
