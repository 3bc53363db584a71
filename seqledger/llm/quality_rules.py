"""Quality rules: text statistics, and a decision list learned from labelled ones.

Only DataFrame functions. The list is learned by sequential covering: a rule is grown by the
threshold condition of the best information gain until it covers no good document or no condition
helps, pruned back on documents kept aside, and taken while it is precise there; what it covers
leaves the table before the next rule. Each step reads counts per feature and interval, which
Spark sums; the driver sees a few hundred numbers. The rules become one ordered CASE expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

SPACES = "\t\n\x0b\x0c\r"
#: Intervals per feature, rules, conditions of a rule, and what a rule must show on rows kept aside.
CUTS, RULES, CONDITIONS, PRECISION, SUPPORT = 24, 8, 3, 0.8, 3


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def _repeated(words: Column) -> Column:
    """Words inside 5-word windows that occur twice or more among ``words``."""

    def covered(hashes: Column) -> Column:
        def among(order: Column) -> Column:
            twice = F.filter(order, lambda x, i: F.coalesce(F.get(order, i - 1)["h"] == x["h"], F.lit(False))
                             | F.coalesce(F.get(order, i + 1)["h"] == x["h"], F.lit(False)))

            def width(at: Column) -> Column:
                steps = F.transform(at, lambda p, i: F.least(F.lit(5), F.coalesce(F.get(at, i + 1) - p, F.lit(5))))
                return F.aggregate(steps, F.lit(0), lambda s, x: s + x)

            return _let(F.array_sort(F.transform(twice, lambda x: x["i"])), width)

        order = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(order, among))

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 5), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(5)]))
    return F.when(F.size(words) < 6, F.lit(0)).otherwise(_let(hashes, covered))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of every row.

    Words are runs of other characters than ASCII white space; a null text has none.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    flat = F.translate("text", SPACES, " " * len(SPACES))
    words = F.array_remove(F.split(flat, " "), "")
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(F.translate(x, SPACES, " " * len(SPACES))) != "")
    found = rows.select(
        "doc_id",
        _let(words, lambda w: F.struct(F.size(w).alias("n"), _repeated(w).alias("again"))).alias("w"),
        F.length(F.translate("text", " " + SPACES, "")).alias("chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).alias("symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).alias("dup"))
    return found.select(
        "doc_id", F.col("w.n").cast("bigint").alias("n_words"), F.col("chars").cast("bigint").alias("word_chars"),
        F.col("symbols").cast("bigint").alias("n_symbols"), F.col("dup").cast("bigint").alias("n_dup_lines"),
        F.col("w.again").cast("bigint").alias("n_repeat_words"))


#: Features of the rules, as ratios of the statistics.
FEATURES = {
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "chars_per_word": "word_chars / greatest(n_words, 1)",
    "dup_lines_per_word": "n_dup_lines / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "n_words": "CAST(n_words AS DOUBLE)",
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    limit: float

    def sql(self) -> str:
        return f"({FEATURES[self.feature]}) {'>=' if self.above else '<'} {self.limit!r}D"


Rule = tuple[Condition, ...]


def _all(rule: Rule) -> str:
    return " AND ".join(c.sql() for c in rule) or "true"


def _any(rules: list[Rule]) -> str:
    return " OR ".join(f"({_all(r)})" for r in rules) or "false"


def _gain(bad: int, good: int, bad0: int, good0: int) -> float:
    if not bad:
        return 0.0
    return bad * (math.log2(bad / (bad + good)) - math.log2(bad0 / (bad0 + good0)))


def learn(rows: DataFrame) -> list[Rule]:
    """Ordered rules for bad documents, from (statistics..., bad boolean, aside boolean).

    Empty when there are no rows, no bad ones, or no rule is precise enough on the rows aside.
    """
    exact = rows.select("bad", "aside", *[F.expr(sql).alias(name) for name, sql in FEATURES.items()])
    shares = [i / CUTS for i in range(1, CUTS)]
    found = exact.agg(*[F.percentile_approx(x, shares, 10_000).alias(x) for x in FEATURES], *[
        F.percentile_approx(F.when(F.col("bad"), F.col(x)), shares, 10_000).alias(f"{x}_bad") for x in FEATURES]).first()
    limits = {x: sorted({*(found[x] or []), *(found[f"{x}_bad"] or [])}) for x in FEATURES}
    # The number of limits that a value reaches: a condition on the value is one on this number.
    steps = [reduce(lambda a, b: a + b, [(F.expr(sql) >= F.lit(t)).cast("int") for t in limits[x]], F.lit(0)).alias(f"i_{x}")
             for x, sql in FEATURES.items()]
    table = cut(rows.select("*", *steps), "rules")
    rules: list[Rule] = []
    while len(rules) < RULES:
        rest = table.filter(f"NOT ({_any(rules)})")
        rule: Rule = ()
        while len(rule) < CONDITIONS:
            here = rest.filter(f"NOT aside AND {_all(rule)}")
            pairs = F.explode(F.array(*[F.struct(F.lit(x).alias("f"), F.col(f"i_{x}").alias("i")) for x in FEATURES])).alias("p")
            counts = here.select("bad", pairs).groupBy("p.f", "p.i").agg(
                F.sum(F.col("bad").cast("int")).alias("bad"), F.sum((~F.col("bad")).cast("int")).alias("good")).collect()
            by = {x: {r["i"]: (r["bad"], r["good"]) for r in counts if r["f"] == x} for x in FEATURES}
            bad0 = sum(b for b, _ in by["n_words"].values())
            good0 = sum(g for _, g in by["n_words"].values())
            if not bad0 or not good0:
                break
            best = max(_conditions(by, limits, bad0, good0), default=None, key=lambda c: (c[0], c[1].feature, c[1].above, -c[1].limit))
            if best is None or best[0] <= 0:
                break
            rule += (best[1],)
        if not rule:
            break
        tried = [rule[:n] for n in range(1, len(rule) + 1)]
        sums = rest.filter("aside").agg(*[
            F.sum(F.expr(f"CAST({label} AND {_all(r)} AS INT)")).alias(f"{name}{i}")
            for i, r in enumerate(tried) for name, label in (("b", "bad"), ("g", "NOT bad"))]).first()
        values = [((sums[f"b{i}"] or 0), (sums[f"g{i}"] or 0)) for i in range(len(tried))]
        worth = [(b - g) / (b + g) if b + g else -1.0 for b, g in values]
        at = max(range(len(tried)), key=lambda i: (worth[i], values[i][0], -i))
        b, g = values[at]
        if b < SUPPORT or b < PRECISION * (b + g):
            break
        rules.append(tried[at])
    return rules


def _conditions(by, limits, bad0: int, good0: int):
    """(gain, condition) of every threshold on every feature."""
    for x, counts in by.items():
        bad = good = 0
        for i in range(len(limits[x]), 0, -1):
            b, g = counts.get(i, (0, 0))
            bad, good = bad + b, good + g
            yield _gain(bad, good, bad0, good0), Condition(x, True, limits[x][i - 1])
            yield _gain(bad0 - bad, good0 - good, bad0, good0), Condition(x, False, limits[x][i - 1])


BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that fires, from 1; null where none does."""
    if not rules:
        return F.lit(None).cast("int")
    return F.expr("CASE " + " ".join(f"WHEN {_all(r)} THEN {i}" for i, r in enumerate(rules, 1)) + " END")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, the statistics, base_failed, kept, rule) of every row of ``docs``.

    base_failed: fewer than 10 words, or over a fifth of the words in repeated 5-word windows. kept:
    not base_failed and no learned rule fires; ``rule`` numbers the first that does. Learns from
    documents whose quality label is 0 (bad) or 1 and whose crc32(doc_id) mod 4 is not 2; those
    with crc32 mod 4 = 3 prune. Without usable labels there are no rules.

    A null or empty text has 0 everywhere and fails the base. A row without doc_id is judged, not
    learned from; repeated rows give a row each; several labels of a document count as the least.
    Other columns are not read.
    """
    stats = cut(statistics(docs), "stats")
    marks = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("q")).filter("q in (0, 1)")
    marks = marks.groupBy("_id").agg(F.min("q").alias("q"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    rows = stats.join(marks, stats["doc_id"] == marks["_id"]).filter(fold != 2).filter(f"NOT ({BASE_FAILED})")
    rules = learn(rows.select(*[c for c in stats.columns if c != "doc_id"], (F.col("q") == 0).alias("bad"), (fold == 3).alias("aside")))
    out = stats.withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("rule", verdict(rules))
    return out.select(*stats.columns, "base_failed", F.expr("NOT base_failed AND rule IS NULL").alias("kept"), "rule")
