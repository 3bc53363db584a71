"""Table schemas, enum domains and fixed vocabulary of the tracking model.

Thirteen entity tables and five link tables.  Every reader uses these types; nothing is
inferred from data.
"""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    BooleanType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

# Columns every entity table ends with.
_COMMON = (
    "deprecated boolean, deleted boolean, creation timestamp, modification timestamp, "
    "extra_metadata string, ext_id bigint, ext_src string"
)

_OWN = {
    "project": "name string, alias array<string>",
    "specimen": (
        "project_id bigint, name string, alias array<string>, cohort string, institution string"
    ),
    "sample": "specimen_id bigint, name string, alias array<string>, tumour boolean",
    "experiment": (
        "sequencing_technology string, type string, nucleic_acid_type string, "
        "library_kit string, kit_expiration_date timestamp"
    ),
    "run": "name string, instrument string, date timestamp",
    "readset": (
        "sample_id bigint, experiment_id bigint, run_id bigint, name string, "
        "alias array<string>, lane string, adapter1 string, adapter2 string, "
        "sequencing_type string, state string"
    ),
    "operation": (
        "operation_config_id bigint, reference_id bigint, project_id bigint, "
        "platform string, cmd_line string, name string, status string"
    ),
    "reference": (
        "name string, alias array<string>, assembly string, version string, "
        "taxon_id string, source string"
    ),
    "operation_config": "name string, version string, md5sum string, data binary",
    "job": (
        "operation_id bigint, name string, start timestamp, stop timestamp, "
        "status string, type string"
    ),
    "metric": (
        "name string, job_id bigint, value string, flag string, deliverable boolean, "
        "aggregate string"
    ),
    "file": "name string, type string, md5sum string, deliverable boolean, state string",
    "location": "file_id bigint, uri string, endpoint string, deliverable boolean",
}

_TYPES = {
    "bigint": LongType(),
    "string": StringType(),
    "boolean": BooleanType(),
    "timestamp": TimestampType(),
    "binary": BinaryType(),
    "array<string>": ArrayType(StringType()),
}


def _schema(text: str) -> StructType:
    """A schema from ``"name type, ..."``, usable before a session exists."""
    pairs = (column.split() for column in text.split(","))
    return StructType([StructField(name, _TYPES[kind]) for name, kind in pairs])


ENTITY_SCHEMAS: dict[str, StructType] = {
    name: _schema(f"id bigint, {own}, {_COMMON}") for name, own in _OWN.items()
}

LINK_SCHEMAS: dict[str, StructType] = {
    "readset_file": _schema("readset_id bigint, file_id bigint"),
    "readset_metric": _schema("readset_id bigint, metric_id bigint"),
    "readset_job": _schema("readset_id bigint, job_id bigint"),
    "readset_operation": _schema("readset_id bigint, operation_id bigint"),
    "job_file": _schema("job_id bigint, file_id bigint"),
}

SCHEMAS: dict[str, StructType] = {**ENTITY_SCHEMAS, **LINK_SCHEMAS}

# Enum domains.
NUCLEIC_ACID_TYPES = ("DNA", "RNA")
LANES = ("1", "2", "3", "4", "5", "6", "7", "8")
SEQUENCING_TYPES = ("SINGLE_END", "PAIRED_END")
STATES = ("VALID", "ON_HOLD", "INVALID", "DELIVERED")
STATUSES = ("PENDING", "RUNNING", "COMPLETED", "FAILED", "OUT_OF_MEMORY", "CANCELLED")
FLAGS = ("PASS", "WARNING", "FAILED", "MISSING", "NOT_APPLICABLE")
AGGREGATES = ("SUM", "AVERAGE", "N")

# Columns that take the values of a domain only.
DOMAINS = {
    "nucleic_acid_type": NUCLEIC_ACID_TYPES, "lane": LANES, "sequencing_type": SEQUENCING_TYPES,
    "state": STATES, "status": STATUSES, "flag": FLAGS, "aggregate": AGGREGATES,
}

# Names given to operations and jobs by the loaders.
RUN_PROCESSING = "run_processing"
TRANSFER = "transfer"
DELIVERY = "delivery"
PIPELINE = "genpipes"

# Timestamp formats of the reports.
LONG_DATE = "yyyy-MM-dd HH:mm:ss"
SHORT_DATE = "yyyy-MM-dd"

# Columns that must be unique within a table.
UNIQUE_COLUMNS = {
    "project": "name",
    "specimen": "name",
    "sample": "name",
    "readset": "name",
    "operation_config": "md5sum",
    "location": "uri",
}

# Foreign keys between entity tables: (parent, child, column of the child).
FOREIGN_KEYS = (
    ("project", "specimen", "project_id"),
    ("project", "operation", "project_id"),
    ("specimen", "sample", "specimen_id"),
    ("sample", "readset", "sample_id"),
    ("experiment", "readset", "experiment_id"),
    ("run", "readset", "run_id"),
    ("operation_config", "operation", "operation_config_id"),
    ("reference", "operation", "reference_id"),
    ("operation", "job", "operation_id"),
    ("job", "metric", "job_id"),
    ("file", "location", "file_id"),
)

# Column defaults of new rows, by table; every other column defaults to null.
ROW_DEFAULTS = {
    "sample": {"tumour": False},
    "readset": {"state": "VALID"},
    "operation": {"status": "PENDING"},
    "metric": {"deliverable": False},
    "file": {"deliverable": False, "state": "VALID"},
    "location": {"deliverable": False},
}
