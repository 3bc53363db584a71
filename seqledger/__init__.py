"""Sequencing-project records as set-based Spark jobs."""
