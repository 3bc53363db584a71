from pyspark.sql import functions as F

from seqledger import functions as fn


def one(spark, expr, *values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(expr(F.col("v"))).collect()]


def test_file_type(spark):
    cases = {
        "a.bam": "bam", "a.b.fastq.gz": "fastq.gz", "a.gz": "gz", "a.gz.txt": "txt", "a.fastq.gz.md5": "fastq.gz.md5",
        "noext": "", ".hidden": "", ".hidden.gz": "gz", "a.": "", "x.y.gz.z.gz": "y.gz.z.gz",
    }
    assert one(spark, fn.file_type, *cases) == list(cases.values())


def test_id_ranges(spark):
    assert one(spark, fn.id_ranges, "1,3-7,9", "7-3,,2", "", "a", "1-2-3", " 4 ", "-5") == [
        [1, 3, 4, 5, 6, 7, 9], [3, 4, 5, 6, 7, 2], [], None, None, [4], None,
    ]
    assert one(spark, fn.invalid_id_tokens, "1,x,2-y") == [["x", "2-y"]]


def test_names_and_uris(spark):
    assert one(spark, fn.name_list, " a , b,,c ") == [["a", "b", "c"]]
    # Two slashes only: the whole uri is the endpoint.
    assert one(spark, fn.before_triple_slash, "alpha:///x/y", "s3://bucket/x") == ["alpha", "s3://bucket/x"]
    assert one(spark, fn.after_scheme, "alpha:///x/y", "a://b://c", "plain") == ["/x/y", "c", "plain"]


def test_alias_union_treats_null_as_empty(spark):
    row = spark.range(1).select(fn.union_alias(F.lit(None).cast("array<string>"), F.array(F.lit("a"), F.lit("a")))).first()
    assert row[0] == ["a"]


def test_topup_parts(spark):
    df = spark.createDataFrame([("S-1-3-12FRT",), ("S-1",)], "v string")
    v = F.col("v")
    rows = df.select(fn.is_topup(v), fn.topup_base(v), fn.topup_number(v), fn.topup_type(v)).collect()
    assert tuple(rows[0]) == (True, "S-1-3", 12, "FRT")
    assert rows[1][0] is False and rows[1][2] is None
