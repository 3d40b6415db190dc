"""Spark jobs for the data work around medical-image datasets."""
