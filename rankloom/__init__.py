"""rankloom: retrieval-evaluation analytics expressed as Spark plans."""
