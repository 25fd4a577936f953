"""sparkvane: vector search and analytics expressed as Spark DataFrame plans."""
