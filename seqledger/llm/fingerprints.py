"""Threshold-scaled sketches: every shingle hash below a fixed fraction of all hashes is kept.

A sketch grows with its text, so the share of a small text that a large one holds can be told
from the two sketches alone, and the union of sketches is the sketch of the union. Only DataFrame
functions: the hashes are the first 16 hex digits of the MD5 of a shingle.

A text whose hashes are all above the threshold keeps its least one, so that short texts have a
fingerprint too; that stays mergeable, as the least of two least hashes is the least of the union.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Words of a shingle; hashes whose leading hex digits are below ``BELOW`` stay (a fourth of all).
SHINGLE, BELOW = 5, "4"
#: Hex digits of a hash.
DIGITS = 16
#: Bytes of text that one range of documents takes, and ranges at most (beyond it they take more):
#: the least key of each is sent to all tasks.
RANGE_BYTES, RANGES = 64 << 20, 1 << 16


def shingles(text: Column, k: int = SHINGLE) -> Column:
    """All runs of ``k`` words; the whole sequence when there are fewer; none without words.

    Words are runs of other characters than ASCII white space, as they stand. A null text has none.
    """
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def runs(w: Column) -> Column:
        n = F.size(w)
        all_runs = F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.array_join(F.slice(w, i, k), " "))
        return F.when(n >= k, all_runs).when(n > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))

    # The words are bound once; else each use would split the text again.
    return F.get(F.transform(F.array(words), runs), 0)


def sketch(text: Column, k: int = SHINGLE, below: str = BELOW) -> Column:
    """The sorted distinct hashes (hex strings) of ``text`` under the threshold, or its least one."""
    hashes = F.transform(shingles(text, k), lambda s: F.substring(F.md5(s), 1, DIGITS))

    def chosen(h: Column) -> Column:
        low = F.filter(h, lambda x: x < below)
        return F.when(F.size(low) > 0, F.array_sort(F.array_distinct(low))).when(
            F.size(h) > 0, F.array(F.array_min(h))).otherwise(h)

    return F.get(F.transform(F.array(hashes), chosen), 0)


def printed(sketched: Column) -> Column:
    """A sketch as a string: its hashes with one space between them; empty for an empty sketch."""
    return F.array_join(sketched, " ")


def read(fingerprint: Column) -> Column:
    """The sketch of a fingerprint string; null is empty."""
    text = F.coalesce(fingerprint, F.lit(""))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, " "))


def _packed(sketched: Column) -> Column:
    """A sketch as bytes, half as long as its string."""
    return F.unhex(F.array_join(sketched, ""))


def _unpacked(packed: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.hex(packed)), F.lit("[0-9a-f]{%d}" % DIGITS), F.lit(0))


def merge(a: Column, b: Column, below: str = BELOW) -> Column:
    """The sketch of the union of two sets, from their sketches."""
    both = F.array_sort(F.array_union(a, b))
    low = F.filter(both, lambda x: x < below)
    return F.when(F.size(low) > 0, low).otherwise(F.slice(both, 1, 1))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two sketches: 1 when both are empty, 0 when one is."""
    same, total = F.size(F.array_intersect(a, b)), F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(same.cast("double") / (total - same).cast("double"))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the set of ``a`` that lies in the set of ``b``; 1 when ``a`` is empty."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)).cast("double") / F.size(a).cast("double"))


def with_next(docs: DataFrame, order: list[Column], size: Column, carried: list[str]) -> DataFrame:
    """``docs`` with ``next_<c>`` of every column in ``carried``: that of the row which follows.

    ``order`` are ascending sort columns; the row after the last is the first. Rows are dealt to
    ranges of about ``RANGE_BYTES`` by the least key of each range, found from keys alone; the
    first row of a range is also sent to the range before it, so no order over all rows meets in
    one task. Rows that agree in all keys should be alike: they share a range.
    """
    spark = docs.sparkSession
    keyed = docs.withColumn("key_", F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)]))
    slim = keyed.select("key_", size.cast("long").alias("bytes"))
    total = slim.agg(F.sum("bytes")).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(RANGES, -(-total // RANGE_BYTES)))
    least = slim.select("key_").repartitionByRange(n, "key_").groupBy(F.spark_partition_id().alias("p")).agg(F.min("key_").alias("key_"))
    # One row: the least key of every range, in order.
    bounds = cut(least.agg(F.array_sort(F.collect_list("key_")).alias("keys")), "bounds").select("keys").scalar()
    # Binary search, a step a column: how many bounds are not above the key, less one.
    rows, at = keyed.withColumn("range_", F.lit(0)), F.col("range_")
    for i in reversed(range(max(n, 4096).bit_length() + 1)):
        step = 1 << i
        rows = rows.withColumn("range_", F.when(F.get(bounds, at + (step - 1)) <= F.col("key_"), at + step).otherwise(at))
    rows = rows.withColumn("range_", at - 1)
    first = F.get(bounds, F.col("range_")) == F.col("key_")
    own = F.struct(F.col("range_").alias("r"), F.lit(False).alias("guest"))
    guest = F.struct(F.pmod(F.col("range_") - 1, F.size(bounds)).alias("r"), F.lit(True).alias("guest"))
    rows = rows.withColumn("to_", F.explode(F.when(first, F.array(own, guest)).otherwise(F.array(own))))
    rows = rows.select(*docs.columns, "key_", F.col("to_.r").alias("range_"), F.col("to_.guest").alias("guest_"))
    w = Window.partitionBy("range_").orderBy("guest_", "key_")
    rows = rows.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in carried])
    return rows.filter("NOT guest_").drop("key_", "range_", "guest_")


def fingerprints(docs: DataFrame, k: int = SHINGLE, below: str = BELOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its fingerprint, that of an edited text, and how alike they are.

    The edited text is the text whose last third (rounded down, in code points) gave way to as many
    first code points of the next document, or all it has. The next document is the one of the next
    smaller id; the first one's for the last. Rows of one id follow each other by a hash of their
    text, equal rows in any order (they are alike), and rows without id stand last.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and
    near_next (likeness to the edited text and to the next document), held_edited and held_next
    (the share of this document's shingles in them).

    A null text is an empty one: empty fingerprint, which is alike to empty ones (1) and to no
    other (0). Very long texts are taken whole, by one task each. Other columns are not read. An
    empty table gives no rows.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # Rows without id come last: the flag sorts before the id. ~id turns the order round.
    order = [F.col("doc_id").isNull(), F.bitwise_not(F.coalesce(F.col("doc_id").cast("long"), F.lit(0))), F.xxhash64("text")]
    base = base.withColumn("own", _packed(sketch(F.col("text"), k, below)))
    rows = with_next(base, order, F.octet_length("text"), ["text", "own"])
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "own", "next_own", edited.alias("edited"))
    rows = rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), _unpacked(F.col("own")).alias("a"),
        sketch(F.col("edited"), k, below).alias("e"), _unpacked(F.col("next_own")).alias("b"))
    a, e, b = F.col("a"), F.col("e"), F.col("b")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", printed(a).alias("fingerprint"), printed(e).alias("edited_fingerprint"),
        likeness(a, e).alias("near_edited"), likeness(a, b).alias("near_next"),
        containment(a, e).alias("held_edited"), containment(a, b).alias("held_next"))
