"""Jobs: the registered queries, and building and serving an index."""
