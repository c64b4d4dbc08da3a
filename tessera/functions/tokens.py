"""Token counts, limits and batches. A counter is a Column function; the default needs no vocabulary."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import let

#: The token limit of a batch and of a code chunk; tokens kept back from a model's window; characters of the
#: alternate provider's context.
BATCH_LIMIT, RESERVE, CHARACTER_LIMIT = 8191, 200, 128_000
#: Token windows of known models.
MODEL_LIMITS = {
    "gpt-3.5-turbo-1106": 16385, "gpt-3.5-turbo": 4096, "gpt-3.5-turbo-16k": 16385, "gpt-3.5-turbo-instruct": 4096, "gpt-3.5-turbo-0613": 4096, "gpt-3.5-turbo-16k-0613": 16385, "gpt-3.5-turbo-0301": 4096,
    "text-davinci-003": 4096, "text-davinci-002": 4096, "code-davinci-002": 8001, "gpt-4-1106-preview": 128000, "gpt-4-vision-preview": 128000, "gpt-4": 8192, "gpt-4-32k": 32768, "gpt-4-0613": 8192,
    "gpt-4-32k-0613": 32768, "gpt-4-0314": 8192, "gpt-4-32k-0314": 32768, "text-embedding-ada-002": 8191,
}


def approximate_tokens(text: Column) -> Column:
    """A quarter of the code points, rounded up."""
    return F.ceil(F.length(text) / 4).cast("long")


def vocabulary_tokens(path: str) -> Callable[[Column], Column]:
    """A counter by a tokenizers file on the executors."""

    def run(texts: pa.Array) -> pa.Array:
        from tokenizers import Tokenizer

        from tessera.functions.process_cache import kept

        file = kept("tokenizer", path, lambda: Tokenizer.from_file(path))
        return pa.array([None if t is None else len(file.encode(t, add_special_tokens=False).ids) for t in texts.to_pylist()], pa.int64())

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "long")


def batches(counts: Column, limit: int = BATCH_LIMIT) -> Column:
    """Batch numbers, from 0, of items by their token counts, in order. An item joins the batch while the sum is within the limit
    (equality fits), else it opens the next one: an oversize first item leaves batch 0 empty, as callers expect."""
    start = F.struct(F.lit(0).alias("batch"), F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, n: Column) -> Column:
        opens = n + acc["used"] > limit
        batch = acc["batch"] + F.when(opens, 1).otherwise(0)
        return F.struct(batch.alias("batch"), F.when(opens, n).otherwise(acc["used"] + n).cast("long").alias("used"), F.concat(acc["out"], F.array(batch)).alias("out"))

    return F.aggregate(counts, start, step, lambda acc: acc["out"])


def prefix_within(text: Column, limit: int, counter: Callable[[Column], Column] = approximate_tokens) -> Column:
    """The longest prefix whose letters, each counted by itself, stay within the limit; never shorter than one letter."""
    folded = lambda letters: F.aggregate(
        letters,
        F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda acc, c: F.when(acc["on"] & (acc["used"] + counter(c) <= limit), F.struct((acc["used"] + counter(c)).alias("used"), (acc["n"] + 1).alias("n"), F.lit(True).alias("on"))).otherwise(F.struct(acc["used"].alias("used"), acc["n"].alias("n"), F.lit(False).alias("on"))),
        lambda acc: F.greatest(acc["n"], F.lit(1)),
    )
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    return F.substring(text, F.lit(1), let(letters, folded))


def with_limit(df: DataFrame, model: str, name: str = "max_tokens") -> DataFrame:
    """``df`` with the token limit of the model in a column; -1 where it is unknown."""
    limits = F.create_map(*(F.lit(x) for pair in MODEL_LIMITS.items() for x in pair))
    return df.withColumn(name, F.coalesce(F.try_element_at(limits, F.col(model)), F.lit(-1)))
