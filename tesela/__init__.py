"""Tesela: analytics over organisational records and documents, written as PySpark DataFrame jobs."""
