"""Chat-dataset curation and response evaluation as Spark DataFrame functions."""
