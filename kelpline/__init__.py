"""kelpline: a Spark-first engine for document retrieval, lookups and interaction analytics."""
