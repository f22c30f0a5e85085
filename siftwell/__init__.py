"""Dataset curation and evaluation analytics as composable PySpark transformations."""
