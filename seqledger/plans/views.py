"""The tracking tables derived from the sales tables of the test data.

``tables(spark, folder)`` builds them in Spark; ``PRELUDE`` says the same in SQL, as common
table expressions named ``e_<table>``, for the second engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text_bytes
from ..operators.entities import Tables
from ..schemas import DELIVERY, PIPELINE, RUN_PROCESSING, SCHEMAS, TRANSFER

SOURCE_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
        "l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SOURCE_SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def _table(df: DataFrame, table: str, /, **cols: Column) -> DataFrame:
    """A table with all its columns; those not given are false flags or null."""
    given = {"deprecated": F.lit(False), "deleted": F.lit(False), **cols}
    return df.select(*[
        given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMAS[table].fields
    ])


def _choice(col: Column, *values: str) -> Column:
    """``values[col % n]``."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (col % len(values) + 1).cast("int"))


def tables(spark: SparkSession, folder: str) -> Tables:
    def src(name: str) -> DataFrame:
        return _read(spark, folder, name)

    c = F.col
    line = src("lineitem").filter(c("l_suppkey") % 9 != 0)
    job_id = c("l_suppkey") * 10 + c("l_linenumber")
    linked_job = line.filter(c("l_linenumber") != 7)
    customer, orders, part, events = src("customer"), src("orders"), src("part"), src("events")
    supplier = src("supplier").join(src("nation"), c("s_nationkey") == c("n_nationkey"))
    year = F.year("o_orderdate")
    file = _table(
        part, "file", id=c("p_partkey"),
        name=F.concat("p_name", F.lit("."), _choice(c("p_partkey"), "bam", "fastq.gz", "bed", "log")),
        type=_choice(c("p_partkey"), "bam", "fastq.gz", "bed", "log"),
        md5sum=F.when(c("p_partkey") % 29 != 0, F.md5(F.concat("p_name", "p_brand"))),
        deliverable=c("p_size") % 2 == 0, state=_choice(c("p_partkey"), "VALID", "ON_HOLD", "INVALID"),
        extra_metadata=F.concat(
            F.lit('{"read_type": "'), F.when(F.floor(c("p_partkey") / 4) % 2 == 0, "R1").otherwise("R2"), F.lit('"}')
        ),
    )
    spots = file.filter(c("id") % 5 != 0).select(
        c("id").alias("file_id"), "name", F.explode(F.array(
            F.struct(F.lit(0).alias("n"), F.lit("alpha").alias("endpoint")),
            F.struct(F.lit(1).alias("n"), F.lit("bravo").alias("endpoint")),
        )).alias("e"),
    )
    spot_id = c("file_id") * 2 + c("e.n")
    return {
        "project": _table(src("region"), "project", id=c("r_regionkey"), name=c("r_name")),
        "specimen": _table(
            src("nation"), "specimen", id=c("n_nationkey"), project_id=c("n_regionkey"), name=c("n_name"),
            cohort=F.concat(F.lit("C"), c("n_nationkey") % 4),
        ),
        "sample": _table(
            customer, "sample", id=c("c_custkey"), specimen_id=c("c_nationkey"), name=c("c_name"),
            tumour=c("c_mktsegment") == "BUILDING", deprecated=c("c_custkey") % 13 == 0,
            deleted=c("c_custkey") % 17 == 0,
        ),
        "experiment": _table(
            spark.range(6), "experiment", id=c("id"),
            nucleic_acid_type=F.when(c("id") % 3 != 0, "DNA").otherwise("RNA"),
            library_kit=F.concat(F.lit("kit"), c("id") % 2),
        ),
        "run": _table(
            orders.select(year.alias("y")).distinct(), "run", id=c("y"), name=F.concat(F.lit("run"), c("y"))
        ),
        "readset": _table(
            orders, "readset", id=c("o_orderkey"), sample_id=c("o_custkey"), experiment_id=c("o_orderkey") % 6,
            run_id=year, name=F.concat(F.lit("RS"), c("o_orderkey")), lane=F.substring("o_orderpriority", 1, 1),
            adapter1=F.lit("AGAT"), adapter2=F.lit("AGCT"),
            sequencing_type=_choice(c("o_orderkey"), "PAIRED_END", "SINGLE_END"),
            state=F.when(c("o_orderstatus") == "O", "VALID").when(c("o_orderstatus") == "P", "ON_HOLD").otherwise("INVALID"),
            deprecated=c("o_orderkey") % 11 == 0, deleted=c("o_orderkey") % 7 == 0,
        ),
        "operation": _table(
            supplier, "operation", id=c("s_suppkey"), project_id=c("n_regionkey"),
            operation_config_id=F.floor(c("s_suppkey") / 16), platform=F.lit("alpha"), cmd_line=F.lit("run.sh"),
            name=_choice(c("s_suppkey"), RUN_PROCESSING, TRANSFER, PIPELINE, DELIVERY), status=F.lit("COMPLETED"),
        ),
        "reference": spark.createDataFrame([], SCHEMAS["reference"]),
        "operation_config": _table(
            src("supplier").select(F.floor(c("s_suppkey") / 16).alias("id")).distinct(), "operation_config", id=c("id"), name=F.lit("cfg"), version=c("id"),
            md5sum=F.concat(F.lit("m"), c("id")), data=text_bytes(F.concat(F.lit("cfg"), c("id") % 3)),
        ),
        "job": _table(
            line.select("l_suppkey", "l_linenumber").distinct(), "job", id=job_id, operation_id=c("l_suppkey"),
            name=F.concat(F.lit("step"), c("l_linenumber") % 3), status=F.lit("COMPLETED"),
        ),
        "metric": _table(
            events, "metric", id=c("event_id"), name=c("event_type"), job_id=(c("user_id") % 8 + 1) * 10 + 1 + c("event_id") % 7,
            value=F.when(c("event_id") % 31 != 0, F.floor("value").cast("bigint")),
            flag=_choice(c("event_id"), "PASS", "WARNING", "FAILED", "MISSING", "NOT_APPLICABLE"),
            deliverable=c("event_id") % 2 == 0, aggregate=_choice(c("event_id"), "SUM", "AVERAGE", "N"),
            extra_metadata=c("props"),
        ),
        "file": file,
        "location": _table(
            spots, "location", id=spot_id, file_id=c("file_id"), endpoint=c("e.endpoint"),
            uri=F.concat(c("e.endpoint"), F.lit(":///d/"), c("file_id"), F.lit("/"), c("name")),
            deleted=spot_id % 37 == 0,
        ),
        "readset_file": src("lineitem").filter(c("l_partkey") % 10 != 0).select(
            c("l_orderkey").alias("readset_id"), c("l_partkey").alias("file_id")
        ).distinct(),
        "readset_operation": line.select(
            c("l_orderkey").alias("readset_id"), c("l_suppkey").alias("operation_id")
        ).distinct(),
        "readset_job": linked_job.select(c("l_orderkey").alias("readset_id"), job_id.alias("job_id")).distinct(),
        "job_file": linked_job.select(job_id.alias("job_id"), c("l_partkey").alias("file_id")).distinct(),
        "readset_metric": events.select((c("user_id") % 100).alias("readset_id"), c("event_id").alias("metric_id")).union(
            events.filter(c("event_id") % 4 == 0).select(((c("user_id") + 1) % 100), "event_id")
        ).distinct(),
    }


def topup_samples(samples: DataFrame) -> DataFrame:
    """Samples renamed to repeated extractions: ``S-<group>-<number>RT``."""
    group = F.floor(F.col("id") / 7) % 200
    return samples.withColumn("name", F.concat(F.lit("S-"), group, F.lit("-"), F.col("id") % 7, F.lit("RT")))


LONG_HOST = "alpha.cluster.example.org"
SHORT_HOST = "alpha"


def long_host_locations(location: DataFrame) -> DataFrame:
    """Half of the locations at their long host name; every fourth one collides with its own
    short form on another row."""
    long = F.col("id") % 4 == 0
    row = F.floor(F.col("id") / 4) * 4
    uri = F.concat(F.lit("alpha"), F.when(long, ".cluster.example.org").otherwise(""), F.lit(":///d/"), row)
    return location.select(*[
        uri.alias(c) if c == "uri"
        else F.when(long, LONG_HOST).otherwise(F.lit("alpha")).alias(c) if c == "endpoint"
        else F.col(c)
        for c in location.columns
    ])


PRELUDE = f"""
WITH e_project AS (
  SELECT CAST(r_regionkey AS BIGINT) id, r_name AS name, false AS deprecated, false AS deleted FROM region),
e_specimen AS (
  SELECT CAST(n_nationkey AS BIGINT) id, CAST(n_regionkey AS BIGINT) project_id, n_name AS name,
    'C' || (n_nationkey % 4) AS cohort, false AS deprecated, false AS deleted FROM nation),
e_sample AS (
  SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) specimen_id, c_name AS name,
    c_mktsegment = 'BUILDING' AS tumour, c_custkey % 13 = 0 AS deprecated, c_custkey % 17 = 0 AS deleted
  FROM customer),
e_experiment AS (
  SELECT range AS id, CASE WHEN range % 3 <> 0 THEN 'DNA' ELSE 'RNA' END AS nucleic_acid_type,
    'kit' || (range % 2) AS library_kit FROM range(6)),
e_run AS (
  SELECT DISTINCT CAST(year(o_orderdate) AS BIGINT) AS id, 'run' || year(o_orderdate) AS name FROM orders),
e_readset AS (
  SELECT o_orderkey AS id, o_custkey AS sample_id, o_orderkey % 6 AS experiment_id,
    CAST(year(o_orderdate) AS BIGINT) AS run_id, 'RS' || o_orderkey AS name,
    substr(o_orderpriority, 1, 1) AS lane, 'AGAT' AS adapter1, 'AGCT' AS adapter2,
    CASE WHEN o_orderkey % 2 = 0 THEN 'PAIRED_END' ELSE 'SINGLE_END' END AS sequencing_type,
    CASE o_orderstatus WHEN 'O' THEN 'VALID' WHEN 'P' THEN 'ON_HOLD' ELSE 'INVALID' END AS state,
    o_orderkey % 11 = 0 AS deprecated, o_orderkey % 7 = 0 AS deleted
  FROM orders),
e_operation AS (
  SELECT s_suppkey AS id, CAST(n_regionkey AS BIGINT) AS project_id, s_suppkey // 16 AS operation_config_id,
    'alpha' AS platform, 'run.sh' AS cmd_line, 'COMPLETED' AS status,
    CASE s_suppkey % 4 WHEN 0 THEN '{RUN_PROCESSING}' WHEN 1 THEN '{TRANSFER}' WHEN 2 THEN '{PIPELINE}'
      ELSE '{DELIVERY}' END AS name, false AS deprecated, false AS deleted
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
e_operation_config AS (
  SELECT DISTINCT s_suppkey // 16 AS id, 'cfg' || ((s_suppkey // 16) % 3) AS data, 'm' || (s_suppkey // 16) AS md5sum FROM supplier),
e_line AS (SELECT * FROM lineitem WHERE l_suppkey % 9 <> 0),
e_job AS (
  SELECT DISTINCT l_suppkey * 10 + l_linenumber AS id, l_suppkey AS operation_id,
    'step' || (l_linenumber % 3) AS name, CAST(NULL AS TIMESTAMP) AS start, CAST(NULL AS TIMESTAMP) AS stop,
    'COMPLETED' AS status, false AS deprecated, false AS deleted
  FROM e_line),
e_metric AS (
  SELECT event_id AS id, event_type AS name, (1 + user_id % 8) * 10 + 1 + event_id % 7 AS job_id,
    CASE WHEN event_id % 31 <> 0 THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS value,
    CASE event_id % 5 WHEN 0 THEN 'PASS' WHEN 1 THEN 'WARNING' WHEN 2 THEN 'FAILED' WHEN 3 THEN 'MISSING'
      ELSE 'NOT_APPLICABLE' END AS flag, event_id % 2 = 0 AS deliverable,
    CASE event_id % 3 WHEN 0 THEN 'SUM' WHEN 1 THEN 'AVERAGE' ELSE 'N' END AS aggregate,
    false AS deprecated, false AS deleted
  FROM events),
e_file AS (
  SELECT p_partkey AS id,
    p_name || '.' || CASE p_partkey % 4 WHEN 0 THEN 'bam' WHEN 1 THEN 'fastq.gz' WHEN 2 THEN 'bed' ELSE 'log' END AS name,
    CASE p_partkey % 4 WHEN 0 THEN 'bam' WHEN 1 THEN 'fastq.gz' WHEN 2 THEN 'bed' ELSE 'log' END AS type,
    CASE WHEN p_partkey % 29 <> 0 THEN md5(p_name || p_brand) END AS md5sum, p_size % 2 = 0 AS deliverable,
    CASE p_partkey % 3 WHEN 0 THEN 'VALID' WHEN 1 THEN 'ON_HOLD' ELSE 'INVALID' END AS state,
    CASE WHEN (p_partkey // 4) % 2 = 0 THEN 'R1' ELSE 'R2' END AS read_type,
    false AS deprecated, false AS deleted
  FROM part),
e_location AS (
  SELECT f.id * 2 + e.n AS id, f.id AS file_id, e.endpoint, e.endpoint || ':///d/' || f.id || '/' || f.name AS uri,
    (f.id * 2 + e.n) % 37 = 0 AS deleted, false AS deprecated
  FROM e_file f, (VALUES (0, 'alpha'), (1, 'bravo')) e(n, endpoint) WHERE f.id % 5 <> 0),
e_readset_file AS (SELECT DISTINCT l_orderkey AS readset_id, l_partkey AS file_id FROM lineitem WHERE l_partkey % 10 <> 0),
e_readset_operation AS (SELECT DISTINCT l_orderkey AS readset_id, l_suppkey AS operation_id FROM e_line),
e_readset_job AS (SELECT DISTINCT l_orderkey AS readset_id, l_suppkey * 10 + l_linenumber AS job_id FROM e_line WHERE l_linenumber <> 7),
e_job_file AS (SELECT DISTINCT l_suppkey * 10 + l_linenumber AS job_id, l_partkey AS file_id FROM e_line WHERE l_linenumber <> 7),
e_readset_metric AS (
  SELECT user_id % 100 AS readset_id, event_id AS metric_id FROM events
  UNION SELECT (user_id + 1) % 100, event_id FROM events WHERE event_id % 4 = 0),
e_topup AS (
  SELECT id, specimen_id, 'S-' || ((id // 7) % 200) || '-' || (id % 7) || 'RT' AS name FROM e_sample),
e_long_location AS (
  SELECT id, file_id, CASE WHEN id % 4 = 0 THEN '{LONG_HOST}' ELSE 'alpha' END AS endpoint,
    'alpha' || CASE WHEN id % 4 = 0 THEN '.cluster.example.org' ELSE '' END || ':///d/' || (id // 4) * 4 AS uri
  FROM e_location)
"""
