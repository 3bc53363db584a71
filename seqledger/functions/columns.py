"""Scalar functions, all built from JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: names of repeated extractions of one sample end in -<number><material>.
TOPUP_PATTERN = r"-([0-9]+)(RT|DT|DN|FRT)$"

_WHOLE = r"^\s*[+-]?\d+\s*$"
_RANGE = r"^\s*\d+\s*-\s*\d+\s*$"


def _tokens(col: Column) -> Column:
    return F.filter(F.split(col, ","), lambda x: x != "")


def id_ranges(col: Column) -> Column:
    """``"1,3-7,9"`` as an array of ids; a range may run either way.

    Null when any token is neither a number nor a range.
    """

    def expand(token: Column) -> Column:
        ends = F.transform(F.split(token, "-"), lambda e: F.trim(e).try_cast("bigint"))
        low = F.least(ends[0], F.get(ends, 1))
        high = F.greatest(ends[0], F.get(ends, 1))
        return F.when(token.rlike(_RANGE), F.sequence(low, high)).otherwise(
            F.array(F.trim(token).try_cast("bigint"))
        )

    return F.when(
        F.size(invalid_id_tokens(col)) == 0, F.flatten(F.transform(_tokens(col), expand))
    )


def invalid_id_tokens(col: Column) -> Column:
    """The tokens of an id-range expression that cannot be read."""
    return F.filter(_tokens(col), lambda x: ~(x.rlike(_WHOLE) & ~x.contains("-")) & ~x.rlike(_RANGE))


def name_list(col: Column) -> Column:
    """A comma list as trimmed, non-empty names."""
    return F.filter(F.transform(F.split(col, ","), lambda x: F.trim(x)), lambda x: x != "")


def upper_name(col: Column) -> Column:
    return F.upper(col)


def bytes_md5(col: Column) -> Column:
    return F.md5(col)


def text_bytes(col: Column) -> Column:
    return F.encode(col, "UTF-8")


def as_text(col: Column) -> Column:
    return F.decode(col, "UTF-8")


def after_scheme(col: Column) -> Column:
    """The path of a uri: what follows its last ``://``."""
    return F.substring_index(col, "://", -1)


def before_triple_slash(col: Column) -> Column:
    """The endpoint of a uri; the whole uri where it has no ``:///``."""
    return F.substring_index(col, ":///", 1)


def json_field(col: Column, field: str) -> Column:
    return F.get_json_object(col, f"$.{field}")


def compact_json(col: Column) -> Column:
    """JSON text without layout, keys in order; text that is no JSON stays as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(col)), col)


def union_alias(current: Column, added: Column) -> Column:
    """``current`` followed by the names of ``added`` it lacks; nulls count as empty."""
    empty = F.array().cast("array<string>")
    return F.array_union(F.coalesce(current, empty), F.coalesce(added, empty))


def first_of(col: Column) -> Column:
    """First element of an array, null when it is empty."""
    return F.get(col, F.lit(0))


def unreadable_date(col: Column, fmt: str) -> Column:
    """Whether ``col`` holds text that is no date of the format; an absent date is none."""
    return col.isNotNull() & F.try_to_timestamp(col, F.lit(fmt)).isNull()


def date_or(col: Column, fmt: str, fallback: Column) -> Column:
    """Parse ``col``; an absent date takes ``fallback``.  Unreadable ones are refused before."""
    return F.coalesce(F.try_to_timestamp(col, F.lit(fmt)), fallback)


def is_topup(col: Column) -> Column:
    return col.rlike(TOPUP_PATTERN)


def topup_base(col: Column) -> Column:
    return F.regexp_replace(col, TOPUP_PATTERN, "")


def topup_number(col: Column) -> Column:
    return F.regexp_extract(col, TOPUP_PATTERN, 1).try_cast("bigint")


def topup_type(col: Column) -> Column:
    return F.regexp_extract(col, TOPUP_PATTERN, 2)


def file_type(col: Column) -> Column:
    """File type from the suffixes of a name.

    The last suffix, or, where ``.gz`` occurs, everything from the suffix before the first
    ``.gz`` onward.  With ``.gz`` as first of several suffixes only the last one counts.
    Leading dots of a hidden file start no suffix.
    """
    base = F.ltrim(F.substring_index(col, "/", -1), F.lit("."))
    parts = F.split(base, r"\.")
    # A name that ends in a dot has no suffixes.
    suffixes = F.when(
        base.endswith("."), F.array().cast("array<string>")
    ).otherwise(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))))
    at = F.array_position(suffixes, "gz").cast("int")
    start = F.when(at > 1, at - 1).otherwise(F.size(suffixes))
    gz = F.array_join(
        F.slice(suffixes, F.greatest(start, F.lit(1)), F.greatest(F.size(suffixes), F.lit(1))), "."
    )
    last = F.when(F.size(parts) > 1, F.element_at(parts, -1)).otherwise(F.lit(""))
    return F.when(at > 0, gz).otherwise(last)
