"""Preparation of multi-lead recordings for training, as Spark jobs."""
