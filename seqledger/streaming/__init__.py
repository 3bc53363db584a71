"""Continuous arrival of reports."""

from .arrivals import load_batch, stream_ingest  # noqa: F401
