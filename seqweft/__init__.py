"""Alignment-free comparison of sequence collections, as Spark jobs."""
