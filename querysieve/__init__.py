"""Query-log mining and training-data preparation as Spark plans."""
