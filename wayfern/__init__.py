"""A Spark engine for place search, its evidence pipeline and text corpora."""
