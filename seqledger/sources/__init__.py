"""Readers and writers of tables, reports and requests."""

from .envelopes import (  # noqa: F401
    quarantine,
    read_delivery,
    read_modifications,
    read_pipeline_run,
    read_run_processing,
    read_transfer,
)
from .tables import changed_buckets, empty_tables, load_rows, load_tables, write_changes, write_tables  # noqa: F401
