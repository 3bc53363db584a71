"""Loading reports into the tables."""

from .base import Loaded, Moment, create_project, get_or_create  # noqa: F401
from .moves import ingest_delivery, ingest_transfer  # noqa: F401
from .pipeline import ingest_pipeline_run  # noqa: F401
from .runs import ingest_run_processing  # noqa: F401

LOADERS = {
    "run_processing": ingest_run_processing,
    "transfer": ingest_transfer,
    "pipeline_run": ingest_pipeline_run,
    "delivery": ingest_delivery,
}
