"""Topic, relevance and graph analytics as PySpark DataFrame operators."""
