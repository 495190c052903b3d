"""Curation of image-generation training data as Spark jobs."""
