"""Spark library for speech transcripts, video metadata, articles and dialogue records."""
