"""Sedgewren: document retrieval analytics and training-data operators on PySpark."""
