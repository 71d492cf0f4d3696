"""Span-annotation analytics on Spark: DataFrame functions over text records with scored entity spans."""
