"""Escapes become characters without Python workers, as the Arrow function has them."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.queries import ingestion

BITS = [
    "\\", "u", "\\u", "\\ud83d", "\\uDE00", "\\ud8", "\\uD800", "\\udfff", "\\ufffe", "\\ufeff", "\\uffff", "\\u0000", "\\u000a", "\\u0022", "\\u005c", "\\n", "\\\\", "\\/", "\\u4e2d", "\\u4E2D",
    '"', "'", "\n", "\0", "\x1f", "\x7f", "\u2028", "\ufeff", "😀", "中", "a", "4e2d", "{", "}", "$1", "$",
]


def test_unescaping_needs_no_python_worker(spark, sf):
    plan = ingestion.unicode_escape(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_unescaped_equals_the_arrow_function(spark):
    r = random.Random(9)
    texts = [None, "", *BITS, *("".join(r.choices(BITS, k=r.randint(1, 12))) for _ in range(3000))]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", text.unescaped(F.col("t")).alias("back")).collect()
    assert [x.back for x in sorted(rows)] == text._unescape(pa.array(texts, pa.string())).to_pylist()


def test_a_long_text_is_unescaped_whole(spark):
    back = text.unescaped(F.concat(F.repeat(F.lit("a"), 20_000_001), F.lit("\\u4e2d")))
    row = spark.range(1).select(back.alias("b")).select(F.length("b").alias("n"), F.right("b", F.lit(2)).alias("end")).first()
    assert tuple(row) == (20_000_002, "a中")
