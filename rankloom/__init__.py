"""rankloom: batch retrieval and ranking evaluation as PySpark DataFrame jobs."""
