"""Fixed text rules that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that separates words.
WORD = r"[^\x20\x09-\x0D]+"
#: Upper-case letters that are lowered; other letters stay as they are.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The words of a text as an array; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row, though the body's lambdas name it often."""
    return F.element_at(F.transform(F.array(value), body), 1)


def before(values: Column, zero: Column, add) -> Column:
    """For each entry of an array the fold of those before it, by an associative ``add`` with the neutral ``zero``. Arrays grow in about sqrt(n) parts of
    sqrt(n) entries, as one that grows by n entries is copied n times."""
    step = lambda acc, x: F.struct(add(acc["sum"], x).alias("sum"), F.concat(acc["out"], F.array(acc["sum"])).alias("out"))
    start = F.struct(zero.alias("sum"), F.slice(F.array(zero), 1, 0).alias("out"))
    fold = lambda part: F.aggregate(part, start, step)

    def dealt(v: Column) -> Column:
        share = F.ceil(F.sqrt(F.size(v))).cast("int")
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / share).cast("int")), lambda k: fold(F.slice(v, k * share + 1, share)))
        return let(parts, lambda p: let(fold(F.transform(p, lambda x: x["sum"]))["out"], lambda sums: F.flatten(F.transform(p, lambda x, k: F.transform(x["out"], lambda y: add(F.get(sums, k), y))))))

    return let(values, lambda v: F.when(F.size(v) > 0, dealt(v)).otherwise(F.slice(F.array(zero), 1, 0)))


def slices(batches, rows: int = 256):
    """Arrow batches in slices: what a function holds at a time is bounded by a slice, whatever the batch."""
    for batch in batches:
        for i in range(0, len(batch), rows):
            yield batch[i : i + rows]


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
