"""siltstone: document-retrieval analytics as PySpark DataFrame functions."""
