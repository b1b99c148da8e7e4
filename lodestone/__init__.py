"""Code-knowledge retrieval and analytics as lazy PySpark DataFrame functions."""
