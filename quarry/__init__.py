"""quarry: preparing, indexing and searching multilingual document collections with Spark."""
