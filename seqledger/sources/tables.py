"""The table catalog on Parquet: buckets of rows, copied when written.

A catalog is a folder of Parquet directories plus one small manifest file per version.  A table
lies in buckets by its key modulo their number, and a manifest names the directories that make up
each bucket.  A version that changes rows writes anew only the buckets these rows lie in; one that
adds rows puts a directory beside those of the buckets they fall into, and a bucket of many
directories is merged as it is written to.  Older versions keep naming what they had, so their
readers are not disturbed.  The manifest comes last: a file that only one writer can put there.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.entities import Tables
from ..operators.grouping import replace_rows
from ..schemas import SCHEMAS

#: Buckets of a table that a catalog first gets; large ones should be given more.
BUCKETS = 16
#: Directories of a bucket that are merged into one when rows are added to it.
MERGE_AT = 8


class ConflictError(RuntimeError):
    """Another writer took the version."""


def empty_tables(spark: SparkSession) -> Tables:
    """Tables that are known to be empty before anything is run, so joins with them are left out."""
    nothing = spark.range(1).limit(0)
    return {name: nothing.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]) for name, schema in SCHEMAS.items()}


def key_of(table: str) -> str:
    """The column a table is dealt to buckets by: its id, or the first id of a link table."""
    names = SCHEMAS[table].fieldNames()
    return "id" if "id" in names else names[0]


def bucket_of(table: str, buckets: int) -> Column:
    return F.pmod(F.coalesce(F.col(key_of(table)), F.lit(0)), F.lit(buckets)).cast("int")


# --- files and manifests ------------------------------------------------------------------


def _hadoop(spark: SparkSession, path: str):
    """The classes of Hadoop's file interface, a path, and its file system."""
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    where = jvm.Path(path)
    return jvm, where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where there is no folder."""
    _, where, fs = _hadoop(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(where)) if fs.exists(where) else []


def _publish(spark: SparkSession, path: str, text: str) -> None:
    """Put a whole file at ``path``, unless one is there: written aside, then renamed."""
    jvm, target, fs = _hadoop(spark, path)
    aside = jvm.Path(f"{path.rsplit('/', 1)[0]}/_{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    out.write(bytearray(text.encode()))
    out.close()
    modes = spark.sparkContext._gateway.new_array(jvm.Options.Rename, 1)
    modes[0] = jvm.Options.Rename.NONE
    try:
        jvm.FileContext.getFileContext(aside.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(aside, target, modes)
    except Py4JJavaError as error:
        fs.delete(aside, False)
        raise ConflictError(f"{path} was written meanwhile") from error


def versions(spark: SparkSession, base: str) -> list[int]:
    """Numbers of the versions, from the names of their manifests alone."""
    return [int(x[1:-5]) for x in _names(spark, f"{base}/manifest") if x.startswith("v") and x.endswith(".json")]


def manifest(spark: SparkSession, base: str, version: int | None = None) -> dict | None:
    """The newest manifest, or that of a version; only that one file is read."""
    known = versions(spark, base)
    if version is not None and version not in known:
        raise LookupError(f"no version {version}")
    if not known:
        return None
    return json.loads(spark.read.text(f"{base}/manifest/v{version or max(known):09d}.json", wholetext=True).first()[0])


# --- reading ------------------------------------------------------------------------------


def _paths(entry: dict, buckets: Iterable[int] | None = None) -> list[str]:
    wanted = entry["files"] if buckets is None else {str(b) for b in buckets}
    return [p for b in entry["files"] if b in wanted for p in entry["files"][b]]


def _read(spark: SparkSession, base: str, table: str, entry: dict | None, buckets: Iterable[int] | None = None) -> DataFrame:
    paths = _paths(entry, buckets) if entry else []
    if not paths:
        return spark.createDataFrame([], SCHEMAS[table])
    return spark.read.schema(SCHEMAS[table]).parquet(*[f"{base}/{p}" for p in paths]).select(*SCHEMAS[table].fieldNames())


def load_tables(spark: SparkSession, base: str, version: int | None = None) -> Tables:
    """All tables with their fixed schemas; tables without data are empty.

    Without a manifest, ``base/<table>`` or ``base/<table>.parquet`` are read directly.
    """
    chosen = manifest(spark, base, version)
    if chosen is None:
        return {name: _plain(spark, base, name) for name in SCHEMAS}
    return {name: _read(spark, base, name, chosen["tables"].get(name)) for name in SCHEMAS}


def load_rows(spark: SparkSession, base: str, table: str, keys: Iterable[int], version: int | None = None) -> DataFrame:
    """The rows of ``table`` with the given keys, from the buckets of those keys alone."""
    chosen = manifest(spark, base, version)
    entry = chosen["tables"].get(table) if chosen else None
    keys = sorted(set(keys))
    rows = _plain(spark, base, table) if chosen is None else _read(spark, base, table, entry, {k % entry["buckets"] for k in keys} if entry else ())
    return rows.filter(F.col(key_of(table)).isin(keys))


def _plain(spark: SparkSession, base: str, name: str) -> DataFrame:
    for path in (f"{base}/{name}", f"{base}/{name}.parquet"):
        try:
            return spark.read.schema(SCHEMAS[name]).parquet(path)
        except AnalysisException:
            continue
    return spark.createDataFrame([], SCHEMAS[name])


# --- writing ------------------------------------------------------------------------------


def write_tables(
    spark: SparkSession, base: str, changed: Tables, dry_run: bool = False,
    source: str = "", batch: int = -1, buckets: int = BUCKETS,
) -> int | None:
    """Write whole tables as a new version; a dry run writes nothing."""
    return write_changes(spark, base, changed, dry_run=dry_run, source=source, batch=batch, buckets=buckets)


def _write(rows: DataFrame, base: str, folder: str, table: str, buckets: int) -> dict[str, str]:
    """Write rows by bucket: the directory of each bucket that got some."""
    dealt = rows.select(*SCHEMAS[table].fieldNames()).withColumn("bucket_", bucket_of(table, buckets))
    # Adaptive execution splits a large bucket into several files and puts small ones into one task.
    dealt.hint("rebalance", F.col("bucket_")).write.partitionBy("bucket_").parquet(f"{base}/{folder}")
    return {x.removeprefix("bucket_="): f"{folder}/{x}" for x in _names(rows.sparkSession, f"{base}/{folder}") if x.startswith("bucket_=")}


def _touched(rows: DataFrame, table: str, buckets: int) -> set[int]:
    return {r[0] for r in rows.select(bucket_of(table, buckets)).distinct().collect()}


def write_changes(
    spark: SparkSession, base: str, rewritten: Tables | None = None, appended: Tables | None = None, dry_run: bool = False,
    source: str = "", batch: int = -1, updated: Tables | None = None, buckets: int = BUCKETS,
) -> int | None:
    """Write a new version: ``rewritten`` tables replace theirs, rows of ``updated`` replace those of
    the same id, ``appended`` rows are added.

    Only buckets with updated rows, and those whose directories have become many, are written anew.
    The data goes to a folder of its own; the manifest claims the version number and fails where
    another writer has it already.  What that one wrote stays, and the caller starts anew from it.
    ``source`` and ``batch`` are kept with the version: the last batch of each stream.
    """
    if dry_run:
        return None
    last = manifest(spark, base) or {"version": 0, "streams": {}, "tables": {}}
    version, tables = last["version"] + 1, {k: {"buckets": v["buckets"], "files": dict(v["files"])} for k, v in last["tables"].items()}
    folder = f"v{version:09d}-{uuid.uuid4().hex[:12]}"
    for name, df in (rewritten or {}).items():
        tables[name] = {"buckets": buckets, "files": {b: [p] for b, p in _write(df, base, f"{folder}/{name}", name, buckets).items()}}
    for name, df in (updated or {}).items():
        entry = tables.setdefault(name, {"buckets": buckets, "files": {}})
        touched = _touched(df, name, entry["buckets"])
        if touched:
            whole = replace_rows(_read(spark, base, name, entry, touched), df)
            entry["files"].update({b: [p] for b, p in _write(whole, base, f"{folder}/{name}-changed", name, entry["buckets"]).items()})
    for name, df in (appended or {}).items():
        entry = tables.setdefault(name, {"buckets": buckets, "files": {}})
        for b, p in _write(df, base, f"{folder}/{name}-new", name, entry["buckets"]).items():
            entry["files"][b] = [*entry["files"].get(b, []), p]
        many = [b for b, paths in entry["files"].items() if len(paths) >= MERGE_AT]
        if many:
            merged = _write(_read(spark, base, name, entry, map(int, many)), base, f"{folder}/{name}-merged", name, entry["buckets"])
            entry["files"].update({b: [p] for b, p in merged.items()})
    streams = {**last["streams"], **({source: max(batch, last["streams"].get(source, -1))} if source else {})}
    row = {"version": version, "source": source, "batch": batch, "streams": streams, "tables": tables}
    _publish(spark, f"{base}/manifest/v{version:09d}.json", json.dumps(row))
    return version


def changed_buckets(spark: SparkSession, base: str, version: int) -> DataFrame:
    """(name, bucket, written, files): the buckets of a version, and whether it wrote them anew or added to them."""
    new = manifest(spark, base, version)
    rows = [
        (name, int(b), any(p.startswith(f"v{version:09d}-") for p in paths), len(paths))
        for name, entry in new["tables"].items() for b, paths in entry["files"].items()
    ]
    return spark.createDataFrame(rows, "name string, bucket int, written boolean, files int")


def batch_written(spark: SparkSession, base: str, source: str, batch: int) -> bool:
    """Whether a version holds this micro-batch of the stream already; batches of a stream come in order."""
    newest = manifest(spark, base)
    return newest is not None and newest["streams"].get(source, -1) >= batch
