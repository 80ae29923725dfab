"""Operator 6: the sample has the rows with the smallest hashes of every label, rare ones too."""

from pyspark.sql import functions as F

from roadloom.llm.language import sample


def test_rows_of_every_label(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"), F.when(F.col("id") % 2000 == 7, "rare").when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("lang"))
    want = {}
    for r in df.withColumn("h", F.xxhash64("doc_id")).collect():
        if r.lang:
            want.setdefault(r.lang, []).append((r.h, r.text))
    want = {lang: sorted(v)[:150] for lang, v in want.items()}
    got = {}
    for r in sample(df, 150).collect():
        got.setdefault(r.lang, []).append((r.h, r.text))
    assert {lang: sorted(v) for lang, v in got.items()} == want and len(want["rare"]) == 10
