"""Repeated lines or paragraphs, kept once in the whole table.

A unit is a line (or a paragraph, by another separator). Its digest covers its words, A-Z
lower-cased, joined by single spaces. Of all units of one digest the earliest ranked stays: the
one of the least doc_id, then of the least hash of its text, then of the first place in it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .words import parts

#: Units of fewer words are never removed.
LEAST_WORDS = 8


def fresh(names: list[str], base: str) -> str:
    """``base``, lengthened until no column has it (names are compared without case)."""
    taken = {x.lower() for x in names}
    while base.lower() in taken:
        base += "_"
    return base


def normal(unit: bytes) -> tuple[bytes, int]:
    """The digested form of a unit and its number of words."""
    words = unit.lower().split()
    return b" ".join(words), len(words)


def _units(separator: bytes, least: int):
    """(doc_id, key, unit, d1, d2) of every unit that may be removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            rows: list[tuple] = []
            for doc, key, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for at, unit in enumerate((text or "").encode().split(separator)):
                    words, n = normal(unit)
                    if n >= least:
                        d = hashlib.blake2b(words, digest_size=16).digest()
                        rows.append((doc, key, at, int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["doc_id", "key", "unit", "d1", "d2"])

    return run


REMOVED = "array<struct<start: bigint, end: bigint>>"
REMOVED_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _longest_run(units: list[str], shared: set[int]) -> int:
    """Words of the longest run of neighbouring shared units; units without words don't end one."""
    best = run = 0
    for at, unit in enumerate(units):
        n = len(unit.encode().split())
        run = run + n if at in shared else run if not n else 0
        best = max(best, run)
    return best


def _cut(names: list[str], added: list[str], text_at: int, separator: str):
    """Takes the listed units out of the texts; adds how many units there were, what went, and
    with four names in ``added`` how many units others have too and the words of their longest run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            columns = [batch.column(i) for i in range(len(names))]
            texts, gone, met = columns[text_at].to_pylist(), batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist()
            counts, removed, longest = [], [], []
            for i, text in enumerate(texts):
                units = text.split(separator) if text else []
                counts.append(len(units))
                longest.append(_longest_run(units, set(met[i])) if met[i] else 0)
                if not gone[i]:
                    removed.append([])
                    continue
                drop, start, kept, spans = set(gone[i]), 0, [], []
                for at, unit in enumerate(units):
                    if at in drop:
                        spans.append({"start": start, "end": start + len(unit)})
                    else:
                        kept.append(unit)
                    start += len(unit) + len(separator)
                texts[i] = separator.join(kept)
                removed.append(spans)
            columns[text_at] = pa.array(texts, pa.string())
            more = [pa.array(counts, pa.int64()), pa.array(removed, REMOVED_ARROW), pa.array([len(x or ()) for x in met], pa.int64()), pa.array(longest, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, *more[: len(added)]], [*names, *added])

    return run


def remove_repeats(docs: DataFrame, separator: str = "\n", least_words: int = LEAST_WORDS, counts: str = "n_units", spans: str = "removed",
                   id_col: str = "doc_id", text_col: str = "text", measures: tuple[str, str] | None = None) -> DataFrame:
    """``docs`` with repeated units taken out of the text, and columns ``counts`` and ``spans``.

    ``spans`` are the removed units as code point offsets into the original text (the separator
    that went with a unit is not in them). The order of the others is kept. ``measures`` names two
    more columns: how many units of the text stand elsewhere too, in whichever copy they were kept,
    and how many words the longest run of such units has (units without words don't end a run).

    A null text stays null with 0 units, an empty one stays empty. Rows that are equal in doc_id
    and text are one document and get the same result; other rows of one doc_id are documents of
    their own. A null doc_id ranks first. Units of fewer than ``least_words`` words stay. Other
    columns pass through; ``counts`` and ``spans`` are lengthened by ``_`` where a column has the name.
    """
    key = fresh(docs.columns, "_key")
    keyed = docs.withColumn(key, F.xxhash64(F.col(text_col).cast("string")))
    slim = keyed.select(F.col(id_col).cast("long").alias("doc_id"), F.col(key).alias("key"), F.col(text_col).cast("string").alias("text"))
    units = cut(slim.mapInArrow(_units(separator.encode(), least_words), "doc_id long, key long, unit long, d1 long, d2 long"), "units")
    place = F.struct("doc_id", "key", "unit")
    first = units.groupBy("d1", "d2").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last")
    met = units.join(first.select("d1", "d2", "first"), ["d1", "d2"])
    if measures is None:
        met = met.filter(place > F.col("first"))
    met = met.groupBy(F.col("doc_id").alias("_d"), F.col("key").alias("_k")).agg(
        F.collect_set(F.when(place > F.col("first"), F.col("unit"))).alias("gone"), F.collect_set("unit").alias("met"))
    out = keyed.join(met, F.col(id_col).cast("long").eqNullSafe(F.col("_d")) & (F.col(key) == F.col("_k")), "left")
    gone_col = fresh(docs.columns, "gone")
    out = out.select(*[keyed[c] for c in docs.columns], met["gone"].alias(gone_col), met["met"].alias(fresh([*docs.columns, gone_col], "met")))
    named = []
    for name in (counts, spans, *(measures or ())):
        named.append(fresh([*docs.columns, *named], name))
    fields = [T.StructField(f.name, T.StringType(), True) if f.name == text_col else f for f in docs.schema.fields]
    kinds = [T.LongType(), T._parse_datatype_string(REMOVED), T.LongType(), T.LongType()]
    added = [T.StructField(n, k) for n, k in zip(named, kinds)]
    names = docs.columns
    return out.mapInArrow(_cut(names, named, names.index(text_col), separator), T.StructType([*fields, *added]))


def report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, the remaining text, its units before, the removed ones and their places, the
    units that stand elsewhere too and the words of their longest run: the passage it repeats."""
    out = remove_repeats(docs.select("doc_id", "text"), measures=("n_repeated", "longest_repeat"))
    return out.select(
        "doc_id", "text", "n_units", F.size("removed").cast("bigint").alias("n_removed"),
        F.coalesce(F.aggregate("removed", F.lit(0).cast("bigint"), lambda s, x: s + x["end"] - x["start"]), F.lit(0).cast("bigint")).alias("removed_chars"),
        F.concat_ws(",", F.transform("removed", lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string")))).alias("removed_spans"),
        "n_repeated", "longest_repeat")
