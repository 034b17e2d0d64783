"""Streaming mixture analytics and training-data operators on PySpark."""
