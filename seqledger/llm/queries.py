"""One query per operator over the given tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLE[name] = sql
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_ngram_jaccard_join")
def _op1(spark: SparkSession, folder: str) -> DataFrame:
    from .ngram_join import ngram_groups

    return ngram_groups(table(spark, folder, "documents"), k=4, percent=85)


#: Words of op9 and their windows; a row number keeps repeated rows apart.
_CONTAMINATION = r"""
WITH item AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
pattern AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS m, w[i : i + least(len(w), 13) - 1] AS words
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
doc AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
place AS (
  SELECT r, m, i, w[i : i + m - 1] AS words
  FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM doc, (SELECT DISTINCT m FROM pattern) WHERE len(w) >= m)),
met AS (SELECT r, i, place.m, item_id FROM place JOIN pattern ON place.m = pattern.m AND place.words = pattern.words),
hit AS (SELECT r, count(DISTINCT pos) AS n FROM (SELECT r, unnest(range(i, i + m)) AS pos FROM met) GROUP BY r),
named AS (SELECT r, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM met) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(named.n, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""


@query("op9_benchmark_decontamination", _CONTAMINATION)
def _op9(spark: SparkSession, folder: str) -> DataFrame:
    from .decontaminate import report

    return report(table(spark, folder, "documents"), table(spark, folder, "benchmark"), window=13, share=20)


@query("op10_language_id")
def _op10(spark: SparkSession, folder: str) -> DataFrame:
    from .langid import identify

    return identify(table(spark, folder, "documents"))


#: Lines of op7 by window over their normal form.
_REPEATS = r"""
WITH row_ AS (SELECT row_number() OVER () AS r, dense_rank() OVER (ORDER BY doc_id, text) AS same, doc_id, text FROM documents),
line AS (
  SELECT r, same, doc_id, pos, l, array_to_string(regexp_extract_all(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' ') AS unit
  FROM (SELECT r, same, doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM row_ WHERE text <> '')),
ranked AS (
  SELECT *, sum(length(l) + 1) OVER (PARTITION BY r ORDER BY pos) - length(l) - 1 AS first_char,
    len(string_split(unit, ' ')) >= 8 AND dense_rank() OVER (PARTITION BY unit ORDER BY doc_id, same, pos) > 1 AS gone
  FROM line),
shared AS (SELECT unit FROM ranked WHERE gone GROUP BY unit),
run AS (
  SELECT r, CASE WHEN s.unit IS NOT NULL THEN len(string_split(ranked.unit, ' ')) END AS words,
    sum(CASE WHEN s.unit IS NULL AND ranked.unit <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY pos) AS g
  FROM ranked LEFT JOIN shared s ON s.unit = ranked.unit),
longest AS (
  SELECT r, sum(n) AS n_repeated, max(words) AS longest_repeat
  FROM (SELECT r, g, count(words) AS n, coalesce(sum(words), 0) AS words FROM run GROUP BY r, g) GROUP BY r),
summed AS (
  SELECT r, count(*) AS n_units, count(*) FILTER (gone) AS n_removed, coalesce(sum(length(l)) FILTER (gone), 0) AS removed_chars,
    coalesce(string_agg(CAST(first_char AS BIGINT)::VARCHAR || '-' || CAST(first_char + length(l) AS BIGINT)::VARCHAR, ',' ORDER BY pos) FILTER (gone), '') AS removed_spans,
    coalesce(string_agg(l, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS rest
  FROM ranked GROUP BY r)
SELECT doc_id, CASE WHEN n_units IS NULL THEN text ELSE rest END AS text, CAST(coalesce(n_units, 0) AS BIGINT) AS n_units,
  CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(removed_chars, 0) AS BIGINT) AS removed_chars, coalesce(removed_spans, '') AS removed_spans,
  CAST(coalesce(n_repeated, 0) AS BIGINT) AS n_repeated, CAST(coalesce(longest_repeat, 0) AS BIGINT) AS longest_repeat
FROM row_ LEFT JOIN summed USING (r) LEFT JOIN longest USING (r)
"""


@query("op7_substring_dedup", _REPEATS)
def _op7(spark: SparkSession, folder: str) -> DataFrame:
    from .line_dedup import report

    return report(table(spark, folder, "documents"))


@query("op5_best_fit_packing")
def _op5(spark: SparkSession, folder: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, folder, "documents"))


@query("op4_quality_rules")
def _op4(spark: SparkSession, folder: str) -> DataFrame:
    from .quality_rules import judge

    return judge(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op2_quality_classifier")
def _op2(spark: SparkSession, folder: str) -> DataFrame:
    from .quality_net import score

    return score(table(spark, folder, "documents"), table(spark, folder, "labels"), least=0.7)


@query("op3_token_counts")
def _op3(spark: SparkSession, folder: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(table(spark, folder, "documents"))


@query("op8_html_extraction")
def _op8(spark: SparkSession, folder: str) -> DataFrame:
    from .wrapper import extract_pages

    return extract_pages(table(spark, folder, "pages"))


#: Pairs of op6 by list functions.
_PREFERENCES = r"""
WITH turn_ AS (
  SELECT DISTINCT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM turn_),
ending AS (SELECT conv_id, max(n) AS last, arg_max(text, n) AS reply FROM numbered WHERE role = 'assistant' GROUP BY conv_id),
pair AS (SELECT a.conv_id AS pair_id, a.last, b.reply AS other FROM ending a JOIN ending b ON b.conv_id = xor(a.conv_id, 1)),
side AS (
  SELECT pair_id, 1 AS chosen, n, role, text FROM pair JOIN numbered ON conv_id = pair_id
  UNION ALL
  SELECT pair_id, 0, n, role, CASE WHEN n = last THEN other ELSE text END FROM pair JOIN numbered ON conv_id = pair_id WHERE n <= last),
paired AS (
  SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, coalesce(c.n, r.n) AS n,
    coalesce(c.role = r.role AND c.text = r.text, false) AS same
  FROM (SELECT * FROM side WHERE chosen = 1) c FULL JOIN (SELECT * FROM side WHERE chosen = 0) r ON c.pair_id = r.pair_id AND c.n = r.n),
common AS (SELECT pair_id, coalesce(min(n) FILTER (NOT same) - 1, count(*)) AS k FROM paired GROUP BY pair_id),
piece AS (
  SELECT side.*, k, n <= k AS shared, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS line FROM side JOIN common USING (pair_id)),
placed AS (
  SELECT *, sum(length(line)) OVER (PARTITION BY pair_id, chosen, shared ORDER BY n) AS stop FROM piece),
told AS (
  SELECT pair_id, k,
    coalesce(string_agg(line, '' ORDER BY n) FILTER (shared AND chosen = 1), '') AS prompt,
    coalesce(string_agg(line, '' ORDER BY n) FILTER (NOT shared AND chosen = 1), '') AS good,
    coalesce(string_agg(line, '' ORDER BY n) FILTER (NOT shared AND chosen = 0), '') AS bad,
    coalesce(string_agg(CAST(stop - length(text) - 11 AS BIGINT)::VARCHAR || '-' || CAST(stop - 1 AS BIGINT)::VARCHAR, ',' ORDER BY n)
      FILTER (NOT shared AND chosen = 1 AND role = 'assistant'), '') AS good_spans,
    coalesce(string_agg(CAST(stop - length(text) - 11 AS BIGINT)::VARCHAR || '-' || CAST(stop - 1 AS BIGINT)::VARCHAR, ',' ORDER BY n)
      FILTER (NOT shared AND chosen = 0 AND role = 'assistant'), '') AS bad_spans
  FROM placed GROUP BY pair_id, k)
SELECT pair_id, CAST(k AS BIGINT) AS n_common, prompt, good AS chosen, bad AS rejected, good_spans AS chosen_spans, bad_spans AS rejected_spans FROM told
"""


@query("op6_preference_formatting", _PREFERENCES)
def _op6(spark: SparkSession, folder: str) -> DataFrame:
    from .preference import format_pairs, swapped_replies

    return format_pairs(swapped_replies(table(spark, folder, "conversations")))


#: Fingerprints of op11 by list functions.
_FINGERPRINTS = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
followed AS (
  SELECT doc_id, t, length(t) AS n, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS nt FROM d),
edit AS (SELECT *, substring(t, 1, n - n // 3) || substring(nt, 1, n // 3) AS e FROM followed),
word AS (
  SELECT t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w
  FROM (SELECT t FROM edit UNION SELECT e FROM edit)),
hashed AS (
  SELECT t, list_transform(CASE WHEN len(w) = 0 THEN [] ELSE range(1, greatest(len(w) - 4, 1) + 1) END,
    lambda i: md5(array_to_string(w[i : i + 4], ' '))[1:16]) AS h FROM word),
sketch AS (
  SELECT t, CASE WHEN len(list_filter(h, lambda x: x < '4')) > 0 THEN list_sort(list_distinct(list_filter(h, lambda x: x < '4')))
    WHEN len(h) > 0 THEN [list_min(h)] ELSE [] END AS s FROM hashed),
three AS (
  SELECT doc_id, n, e, a.s AS a, b.s AS b, c.s AS c, len(list_intersect(a.s, b.s)) AS ab, len(list_intersect(a.s, c.s)) AS ac
  FROM edit JOIN sketch a ON a.t = edit.t JOIN sketch b ON b.t = edit.e JOIN sketch c ON c.t = edit.nt)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(e) AS edited_sha256,
  array_to_string(a, ' ') AS fingerprint, array_to_string(b, ' ') AS edited_fingerprint,
  CASE WHEN len(a) + len(b) = 0 THEN 1.0::DOUBLE ELSE ab::DOUBLE / (len(a) + len(b) - ab)::DOUBLE END AS near_edited,
  CASE WHEN len(a) + len(c) = 0 THEN 1.0::DOUBLE ELSE ac::DOUBLE / (len(a) + len(c) - ac)::DOUBLE END AS near_next,
  CASE WHEN len(a) = 0 THEN 1.0::DOUBLE ELSE ab::DOUBLE / len(a)::DOUBLE END AS held_edited,
  CASE WHEN len(a) = 0 THEN 1.0::DOUBLE ELSE ac::DOUBLE / len(a)::DOUBLE END AS held_next
FROM three
"""


@query("op11_document_fingerprints", _FINGERPRINTS)
def _op11(spark: SparkSession, folder: str) -> DataFrame:
    from .fingerprints import fingerprints

    return fingerprints(table(spark, folder, "documents"))


#: Terms and divergences of op13 in exact integers.
_DIVERGENCE = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'), []) AS w FROM documents),
held AS (SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(w) AS term FROM doc) GROUP BY ALL),
kept AS (SELECT lang, term FROM held GROUP BY lang, term HAVING count(*) >= 3),
cnt AS (SELECT lang, source, term, sum(n)::HUGEINT AS n FROM held SEMI JOIN kept USING (lang, term) GROUP BY ALL),
size AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
grp AS (
  SELECT lang, source, coalesce(total, 0)::HUGEINT AS total, coalesce(v, 0)::HUGEINT AS v FROM (SELECT DISTINCT lang, source FROM doc)
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM cnt GROUP BY ALL) USING (lang, source) LEFT JOIN size USING (lang)),
p AS (
  SELECT grp.lang, grp.source, kept.term, coalesce(n, 0) AS n, 1 + (1000000000 * (coalesce(n, 0) + 1)) // (total + v) AS p
  FROM grp JOIN kept ON kept.lang = grp.lang LEFT JOIN cnt ON cnt.lang = grp.lang AND cnt.source = grp.source AND cnt.term = kept.term),
whole AS (SELECT lang, sum(total) AS total, any_value(v) AS v FROM grp GROUP BY lang),
q AS (SELECT lang, term, 1 + (1000000000 * (sum(n) + 1)) // (any_value(total) + any_value(v)) AS q FROM cnt JOIN whole USING (lang) GROUP BY lang, term),
pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // y.p), 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL),
term AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pair
  UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM term)
WHERE part = 'pair' OR rank <= 200
"""


@query("op13_source_divergence_audit", _DIVERGENCE)
def _op13(spark: SparkSession, folder: str) -> DataFrame:
    from .divergence import divergence

    return divergence(table(spark, folder, "documents"))


#: Damage, faults, the lightest repair and its lines of op12 by list functions. A weight is a string:
#: eight digits of cost, then the audit, so the least string is the lightest.
_REPAIRS = r"""
WITH RECURSIVE raw AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
coded AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 1, 2, 3, 4, 5, 6, 7, 8], lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)),
    4294967295::BIGINT) % 20 AS fault FROM raw),
hurt AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE fault WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM coded),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(role || ':' || text), copy) AS pos FROM hurt),
told AS (
  SELECT *, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) AS last, role[1:1] AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again,
    lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM placed),
faulty AS (
  SELECT *, CASE WHEN last = '' THEN 1 WHEN again THEN 2 WHEN last NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS f FROM told),
conv AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 1) AS blank,
    count(*) FILTER (f = 2) AS duplicate, count(*) FILTER (f = 3) AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal,
    list([i, CAST(f AS VARCHAR)] ORDER BY pos) AS items, list(role ORDER BY pos) AS roles, list(text ORDER BY pos) AS texts FROM faulty GROUP BY conv_id),
step AS (
  SELECT conv_id, items, 0 AS k, '00000000' AS s0, NULL::VARCHAR AS s1, NULL::VARCHAR AS s2, NULL::VARCHAR AS s3 FROM conv
  UNION ALL
  SELECT conv_id, items, k + 1,
    {D(s0)}, least({D(s1)}, CASE WHEN keeps AND i = 's' THEN {K(s0)} END),
    least({D(j2)}, CASE WHEN keeps AND i = 'u' THEN least({K(s0)}, {K(s1)}, {K(j3)}) END, CASE WHEN keeps THEN least({R(s0)}, {R(s1)}, {R(j3)}) END),
    least({D(j3)}, CASE WHEN keeps AND i = 'a' THEN {K(j2)} END, CASE WHEN keeps THEN {R(j2)} END)
  FROM (
    SELECT *, items[k + 1][1] AS i, items[k + 1][2] NOT IN ('1', '2') AS keeps, CASE WHEN items[k + 1][2] = '3' THEN 1 ELSE 0 END AS t, least(a2, {I(a3)}) AS j2, least(a3, {I(a2)}) AS j3
    FROM (SELECT *, least(s2, {I(s0)}, {I(s1)}, {I(s3)}) AS a2, least(s3, {I(s2)}) AS a3 FROM step WHERE k < len(items)))),
best AS (
  SELECT conv_id, least(s0, j3) AS w FROM (
    SELECT *, least(s3, {I(a2)}) AS j3 FROM (SELECT *, least(s2, {I(s0)}, {I(s1)}, {I(s3)}) AS a2 FROM step WHERE k = len(items)))),
audited AS (SELECT conv.*, CAST(w[1:8] AS BIGINT) AS cost, w[9:] AS audit FROM conv JOIN best ON conv.conv_id IS NOT DISTINCT FROM best.conv_id),
line AS (
  SELECT conv_id, e.n, audit[e.n : e.n] AS edit, len(replace(audit[1 : e.n], 'I', '')) AS row_, len(replace(audit[1 : e.n], 'D', '')) AS out_, audit, roles, texts
  FROM audited, LATERAL (SELECT unnest(range(1, len(audit) + 1)) AS n) e),
kept AS (
  SELECT *, roles[row_] AS role, bool_or(edit = 'K' AND out_ = 1 AND roles[row_][1:1] = 's') OVER (PARTITION BY conv_id) AS led FROM line WHERE edit <> 'D'),
said AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (out_ - CASE WHEN led THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || CASE WHEN edit = 'I' THEN '' ELSE texts[row_] END, chr(10) ORDER BY n) AS lines FROM kept GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
LEFT JOIN audited ON audited.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN said ON said.conv_id IS NOT DISTINCT FROM a.conv_id
"""


def _edits(sql: str) -> str:
    """Writes out {X(s)}: the weight s with the edit X after it."""
    price = {"I": "2", "D": "3", "K": "t", "R": "2 + t"}
    return re.sub(r"\{(\w)\((\w+)\)\}", lambda m: f"(lpad(CAST(CAST({m[2]}[1:8] AS BIGINT) + {price[m[1]]} AS VARCHAR), 8, '0') || {m[2]}[9:] || '{m[1]}')", sql)


@query("op12_conversation_structure_repair", _edits(_REPAIRS))
def _op12(spark: SparkSession, folder: str) -> DataFrame:
    from .turn_repair import damage, repair

    turns = table(spark, folder, "conversations")
    return repair(damage(turns), turns)
