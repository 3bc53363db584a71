"""Checks on incoming reports and on edited tables.

Each returns the offending rows.  Report rows carry ``doc``, the number of their document;
a document with an error is set aside whole, as one failed request would be.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import unreadable_date
from ..session import cut, side
from .entities import Tables
from .grouping import without_ids

ERROR_COLUMNS = ("doc", "code", "entity", "detail")


def error_rows(rows: DataFrame, code: str, entity: str, detail: Column) -> DataFrame:
    return rows.select(
        F.col("doc"),
        F.lit(code).alias("code"),
        F.lit(entity).alias("entity"),
        detail.cast("string").alias("detail"),
    )


def date_errors(rows: DataFrame, cols: Iterable[str], fmt: str, entity: str) -> DataFrame:
    """Error rows for dates that are there and can't be read; absent ones are no error."""
    bad = F.filter(
        F.array(*[F.when(unreadable_date(F.col(c), fmt), F.concat_ws("=", F.lit(c), F.col(c))) for c in cols]),
        lambda x: x.isNotNull(),
    )
    return error_rows(rows.select("doc", F.explode(bad).alias("text")), "bad_date", entity, F.col("text"))


def existing_names(t: Tables, incoming: DataFrame, table: str = "readset") -> DataFrame:
    """Incoming names already stored, whatever their flags; all of them at once."""
    stored = side(t[table].select("name").distinct(), t[table])
    return incoming.join(stored, "name", "left_semi")


def repeated_names(incoming: DataFrame) -> DataFrame:
    """Names that occur again within the batch: every occurrence outside the first document
    that has the name, and all of them where one document has it twice."""
    # Names that come once, which are most of them, move once.
    again = cut(incoming.groupBy("name").agg(F.min("doc").alias("first_doc"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n"), "repeated")
    return (
        incoming.join(side(again), "name").groupBy("name", "doc", "first_doc").agg(F.count(F.lit(1)).alias("n"))
        .filter((F.col("doc") != F.col("first_doc")) | (F.col("n") > 1))
        .select("name", "doc")
    )


def enum_violations(df: DataFrame, col: str, domain: Iterable[str]) -> DataFrame:
    """Rows whose value is set but outside the domain."""
    return df.filter(F.col(col).isNotNull() & ~F.col(col).isin(list(domain)))


def _active(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("deprecated") & ~F.col("deleted"))


def pipeline_ref_errors(t: Tables, incoming: DataFrame) -> DataFrame:
    """Error rows for (doc, sample_name, readset_name): sample missing, readset missing, or
    readset of another sample.  Names are looked up among unflagged rows."""
    r = _active(t["readset"]).select(
        F.col("name").alias("readset_name"), F.col("id").alias("_readset"),
        F.col("sample_id").alias("_owner"),
    ).hint("merge")
    return ref_errors(t, incoming.join(r, "readset_name", "left"))


def ref_errors(t: Tables, incoming: DataFrame) -> DataFrame:
    """The same for rows beside the stored readset of their name and its sample."""
    s = side(_active(t["sample"]).select(F.col("name").alias("sample_name"), F.col("id").alias("_sample")), t["sample"])
    checked = incoming.join(s, "sample_name", "left")
    code = (
        F.when(F.col("_sample").isNull(), "sample_missing")
        .when(F.col("readset_name").isNull(), None)
        .when(F.col("_readset").isNull(), "readset_missing")
        .when(F.col("_owner") != F.col("_sample"), "readset_of_other_sample")
    )
    return checked.withColumn("code", code).filter(F.col("code").isNotNull()).select(
        "doc",
        "code",
        F.when(F.col("code") == "sample_missing", F.lit("sample")).otherwise(F.lit("readset")).alias("entity"),
        F.when(F.col("code") == "sample_missing", F.col("sample_name")).otherwise(F.col("readset_name")).alias("detail"),
    ).distinct()


def source_files(t: Tables, incoming: DataFrame, check_readset_name: bool = True) -> DataFrame:
    """``incoming`` (readset_name, src_uri, ...) plus ``file_id``: the unflagged file at the
    source uri — of that readset, when asked — or null."""
    f = _active(t["file"]).select(F.col("id").alias("_file"))
    at = t["location"].select(F.col("uri").alias("src_uri"), F.col("file_id").alias("_file"))
    at = at.join(f, "_file", "left_semi")
    found = incoming.join(at, "src_uri", "left")
    if check_readset_name:
        r = t["readset"].select(F.col("id").alias("readset_id"), F.col("name").alias("readset_name"))
        owned = t["readset_file"].join(r, "readset_id").select(
            "readset_name", F.col("file_id").alias("_file"), F.lit(True).alias("_owned")
        ).distinct()
        found = found.join(owned, ["readset_name", "_file"], "left").withColumn(
            "_file", F.when(F.col("_owned"), F.col("_file"))
        ).drop("_owned")
    return found.withColumnRenamed("_file", "file_id")


def missing_source_files(t: Tables, incoming: DataFrame, check_readset_name: bool = True) -> DataFrame:
    """Incoming transfers whose source file is unknown."""
    return source_files(t, incoming, check_readset_name).filter(F.col("file_id").isNull()).drop("file_id")


def empty_documents(docs: DataFrame) -> DataFrame:
    """Pipeline documents without samples, or without any job that has a status.

    ``docs`` holds ``doc`` and the nested ``sample`` array.
    """
    no_sample = F.coalesce(F.size("sample"), F.lit(0)) <= 0
    has_status = F.exists(
        "sample",
        lambda s: F.exists(
            s["readset"],
            lambda r: F.exists(r["job"], lambda j: F.coalesce(j["job_status"], F.lit("")) != ""),
        ),
    )
    code = F.when(no_sample, "no_sample").when(~F.coalesce(has_status, F.lit(False)), "no_job_status")
    return docs.withColumn("code", code).filter(F.col("code").isNotNull()).select(
        "doc", "code", F.lit("document").alias("entity"), F.lit(None).cast("string").alias("detail")
    )


def unique_violations(df: DataFrame, col: str) -> DataFrame:
    """Values of a unique column held by more than one row: (value, rows)."""
    return (
        df.filter(F.col(col).isNotNull())
        .groupBy(F.col(col).alias("value"))
        .agg(F.count(F.lit(1)).alias("rows"))
        .filter(F.col("rows") > 1)
    )


def missing_ids(t: Tables, table: str, ids: DataFrame) -> DataFrame:
    """Requested ids the table does not have."""
    return without_ids(ids.select("id").distinct(), t[table].select("id"))
