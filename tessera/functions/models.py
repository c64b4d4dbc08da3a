"""Outside models as Column functions, and stand-ins for them: deterministic and offline. Real ones are injected in their place."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import by_slices

#: Texts that an embedder is given at once.
TEXTS = 1_024
LETTERS = "abcdefghijklmnopqrstuvwxyz"


class Embedder:
    """A batch embedder as Column functions; it runs once for TEXTS texts, or the texts of a few rows, of each Arrow batch. Task retries are its retries."""

    def __init__(self, function: Callable[[list[str]], list[list[float]]]):
        self.function = function

    def __call__(self, text: Column) -> Column:
        """Vectors of a text column."""
        function = self.function

        def run(texts: pa.Array) -> pa.Array:
            return by_slices(texts, lambda part: function([t or "" for t in part]), pa.list_(pa.float64()), TEXTS)

        run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
        return F.arrow_udf(run, "array<double>")(text)

    def each(self, texts: Column) -> Column:
        """Vectors of each text of an array column."""
        function = self.function

        def vectors_of(rows: list) -> list:
            flat = [t or "" for row in rows for t in row or []]
            vectors = iter(function(flat) if flat else [])
            return [None if row is None else [next(vectors) for _ in row] for row in rows]

        def run(rows: pa.Array) -> pa.Array:
            return by_slices(rows, vectors_of, pa.list_(pa.list_(pa.float64())))

        run.__annotations__ = {"rows": pa.Array, "return": pa.Array}
        return F.arrow_udf(run, "array<array<double>>")(texts)


def letter_counts(texts: list[str]) -> list[list[float]]:
    """Unit vectors of letter counts; zeros for a text without letters."""
    import math

    out = []
    for text in texts:
        text = text.lower()
        counts = [text.count(c) for c in LETTERS]
        size = math.sqrt(sum(n * n for n in counts))
        out.append([n / size if size else 0.0 for n in counts])
    return out


#: The stand-in for an embedding model.
letter_vector = Embedder(letter_counts)


def language_model(function: Callable[[str], str]) -> Callable[[Column], Column]:
    """A prompt-to-text callable as a Column function; what it raises is raised with a plain name for timeouts and aborts."""

    def run(prompts: pa.Array) -> pa.Array:
        out = []
        for p in prompts.to_pylist():
            try:
                out.append(None if p is None else function(p))
            except Exception as error:
                raise plain_error(error) from error
        return pa.array(out, pa.string())

    run.__annotations__ = {"prompts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "string").asNondeterministic()


def retrying(function: Callable, attempts: int = 3, wait: float = 0.0) -> Callable:
    """A callable that tries again when it fails; the last failure is raised with a plain name."""

    def run(*args):
        import time

        for k in range(attempts):
            try:
                return function(*args)
            except Exception as error:
                if k + 1 == attempts:
                    raise plain_error(error) from error
                time.sleep(wait * 2**k)

    return run


def provider(name: str, makers: dict[str, Callable[..., Callable[[str], str]]], **settings) -> Callable[[Column], Column]:
    """A language model by its provider's name: ``makers`` makes prompt-to-text callables of settings."""
    if name not in makers:
        raise ValueError(f"unknown provider {name}")
    return language_model(makers[name](**settings))


def deltas(prompts: DataFrame, speak: Callable[[str], Iterator[str]], stream_id: str = "stream_id", prompt: str = "prompt") -> DataFrame:
    """Rows (stream_id, seq, chunk): what a model says to each prompt, piece by piece, in the order in which it comes. Null prompts and empty
    pieces give no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pieces = [] if text is None else [p for p in speak(text) if p]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(pieces), pa.string()), pa.array(range(len(pieces)), pa.int64()), pa.array(pieces, pa.string())], ["stream_id", "seq", "chunk"])

    return prompts.select(F.col(stream_id).cast("string"), prompt).mapInArrow(run, "stream_id string, seq long, chunk string")


def with_prefix(ids: DataFrame, prefixes: tuple[str, ...] = ("gpt",), column: str = "id") -> DataFrame:
    """Models whose name begins with one of the prefixes."""
    ok = F.lit(False)
    for p in prefixes:
        ok = ok | F.col(column).startswith(p)
    return ids.where(ok)


def plain_error(error: Exception) -> Exception:
    """Client errors by two names that callers can tell apart."""
    name = type(error).__name__.lower()
    if "timeout" in name:
        return TimeoutError(str(error))
    if "abort" in name or "cancel" in name:
        return InterruptedError(str(error))
    return error


def echo(prompt: Column) -> Column:
    """The stand-in for a language model: the prompt's digest."""
    return F.concat(F.lit("answer "), F.substring(F.sha2(prompt, 256), 1, 12))
