"""Semantic chunking. All of it happens inside a document's row: nothing is shuffled, and a document is never gathered from parts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.models import Embedder, letter_vector
from tessera.functions.text import let, not_blank, split_sentences, trim
from tessera.functions.tokens import BATCH_LIMIT
from tessera.functions.vectors import cosine_distance

BUFFER, PERCENTILE, DIGITS = 1, 80, 9


def sentence_groups(pieces: Column, buffer: int = BUFFER) -> Column:
    """Each sentence with ``buffer`` neighbours on both sides, concatenated."""
    return F.transform(pieces, lambda s, i: F.array_join(F.slice(pieces, F.greatest(i - buffer, F.lit(0)) + 1, F.least(i, F.lit(buffer)) + 1 + buffer), ""))


def adjacent_distances(vectors: Column) -> Column:
    """Cosine distance of each vector to the next: one fewer than vectors. Rounded, so that equal ones are equal."""
    n = F.size(vectors)
    steps = F.transform(F.slice(vectors, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda v, i: F.round(F.coalesce(cosine_distance(v, F.get(vectors, i + 1)), F.lit(0.0)), DIGITS))
    return steps


def percentile_of(values: Column, percent: float) -> Column:
    """Exact, between two neighbours in proportion; null of no values."""

    def at(ordered: Column) -> Column:
        place = (F.size(ordered) - 1) * F.lit(percent / 100.0)
        low = F.floor(place).cast("int")
        return F.get(ordered, low) + (F.coalesce(F.get(ordered, low + 1), F.get(ordered, low)) - F.get(ordered, low)) * (place - low)

    return let(F.sort_array(values), at)


def spread_threshold(values: Column, factor: float) -> Column:
    """Mean plus ``factor`` population standard deviations of an array."""
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)
    return let(values, lambda v: let(mean(v), lambda m: m + factor * F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / F.size(v))))


def chunks(pieces: Column, distances: Column, percent: float = PERCENTILE) -> Column:
    """A chunk ends after each sentence whose distance to the next is strictly above the percentile. Chunks are concatenated;
    without distances the whole is one chunk, joined by spaces."""

    def cut(d: Column) -> Column:
        limit = F.round(percentile_of(d, percent), DIGITS)
        ends = let(limit, lambda t: F.filter(F.transform(d, lambda x, i: F.when(x > t, i + 1)), lambda e: e.isNotNull()))
        whole = F.concat(ends, F.array(F.size(pieces)))
        return let(whole, lambda e: F.transform(e, lambda stop, k: F.array_join(F.slice(pieces, F.coalesce(F.get(e, k - 1), F.lit(0)) + 1, stop - F.coalesce(F.get(e, k - 1), F.lit(0))), "")))

    return F.when(F.size(distances) > 0, let(distances, cut)).otherwise(F.array(F.array_join(pieces, " ")))


def chunked(docs: DataFrame, text: str = "text", embed: Embedder = letter_vector, percent: float = PERCENTILE, buffer: int = BUFFER, split: Callable[[Column], Column] = split_sentences) -> DataFrame:
    """One row for each chunk of each document that is not blank: its columns but the text, then chunk_no and page_content. ``split`` makes
    an array of sentences of a text.

    Sentences, groups, vectors, distances and breaks are columns of the document's row; chunks are trimmed, blank ones left out.
    """
    keep = [c for c in docs.columns if c not in (text, "chunk_no", "page_content")]
    rows = docs.where(not_blank(F.col(text))).select(*keep, split(F.col(text)).alias("__ts_pieces"))
    rows = rows.withColumn("__ts_vectors", embed.each(sentence_groups(F.col("__ts_pieces"), buffer)))
    made = let(F.col("__ts_vectors"), lambda v: let(adjacent_distances(v), lambda d: chunks(F.col("__ts_pieces"), d, percent)))
    return rows.select(*keep, F.posexplode(F.filter(F.transform(made, trim), lambda c: c != "")).alias("chunk_no", "page_content"))


def packed(pieces: list[str], count: Callable[[str], int], limit: int = BATCH_LIMIT) -> list[str]:
    """Top-level pieces of a source file, packed one after another.

    A piece joins while the tokens fit, or if the chunk is empty; what joins is cut to ``limit`` minus the tokens used, in
    characters, and the rest goes on. Each part begins with a line break.
    """
    out, now, used = [], [], 0
    for piece in pieces:
        while piece:
            if now and used + count(piece) > limit:
                out.append("".join(now))
                now, used = [], 0
                continue
            part = piece[: max(0, limit - used)]
            if not part:  # nothing fits behind what is there
                out.append("".join(now))
                now, used = [], 0
                continue
            piece = piece[len(part) :]
            now.append("\n" + part)
            used += count(part)
    return [*out, "".join(now)] if now else out


def code_chunks(files: DataFrame, parts: Callable[[str, str], list[str] | None], count: Callable[[str], int] = lambda s: -(-len(s) // 4), limit: int = BATCH_LIMIT) -> DataFrame:
    """Rows (source, chunk_no, page_content) of code files (source, suffix, content); ``parts`` cuts a source into its top-level
    pieces, or gives None for a language that it does not know."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for source, suffix, content in zip(*(batch.column(i).to_pylist() for i in range(3))):
                rows += [(source, k, c) for k, c in enumerate(packed(parts(content or "", suffix) or [], count, limit))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())], ["source", "chunk_no", "page_content"])

    return files.select("source", "suffix", "content").mapInArrow(run, "source string, chunk_no int, page_content string")
