"""Narrative, market and corpus analytics written as Spark jobs."""
