"""Benchmark decontamination with a broadcast hash set of the test items' word windows.

Windows of 13 words (a shorter item is one window) are numbered by the benchmark's own words, hashed, and broadcast in
blocks of bounded size; each block costs one reading of the texts. It numbers a text's words, looks only at runs of known words, tests
their rolling hashes against the set and verifies each hit word by word. With more than one block the documents are written once; of
every further block only the hits are kept, and meet the documents at the end.

Nulls have no words. An item without words never occurs. An item whose id is null still marks words, but has no name to list.
Repeated items and rows are judged each by itself; a hit that several windows cover counts once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.process_cache import kept, only
from tessera.llm.words import slices
from tessera.plans.staging import staged

WINDOW = 13
#: UTF-8 bytes of benchmark text in one broadcast block.
BLOCK_BYTES = 8_000_000
#: Multiplier of the rolling hash; collisions are verified away.
MULTIPLIER = 0x9E3779B97F4A7C15
DIGEST = "n_words long, n_hit long, items array<string>, spans array<struct<start:int,stop:int>>"


def byte_table() -> bytes:
    """Upper-case letters become lower case, other ASCII but digits and letters becomes a space."""
    return bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256))


class Windows:
    """The windows of one block of items."""

    def __init__(self, items: list[tuple[str | None, bytes]], size: int = WINDOW):
        import numpy as np

        self.table, self.vocabulary, self.found = byte_table(), {}, {}
        for name, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in text.translate(self.table).split()]
            n = min(size, len(ids))
            for i in range(len(ids) - n + 1 if n else 0):
                self.found.setdefault(tuple(ids[i : i + n]), set()).add(name)
        self.by_size = {}
        for n in sorted({len(k) for k in self.found}):
            rows = np.array([k for k in self.found if len(k) == n], dtype=np.uint64)
            self.by_size[n] = np.unique(self.hashes(rows))

    @staticmethod
    def hashes(rows):
        """Of each row of word numbers, modulo 2**64."""
        import numpy as np

        out = np.zeros(len(rows), dtype=np.uint64)
        for j in range(rows.shape[1]):
            out = out * np.uint64(MULTIPLIER) + rows[:, j]
        return out ^ (out >> np.uint64(29))

    def scan(self, texts: list[bytes]) -> list[tuple[int, list[tuple[int, int]], set]]:
        """For each text: its number of words, the merged hit ranges of word positions, the items."""
        import numpy as np

        numbers, starts, get = [], [0], self.vocabulary.get
        for t in texts:
            numbers += [get(w, 0) for w in t.translate(self.table).split()]
            numbers.append(0)  # no window crosses two texts
            starts.append(len(numbers))
        flat, starts = np.array(numbers, dtype=np.uint64), np.array(starts)
        known = np.concatenate([[0], np.cumsum(flat > 0)])
        hits, names = [], {}
        for n, wanted in self.by_size.items():
            if len(flat) < n:
                continue
            at = np.flatnonzero(known[n:] - known[:-n] == n)
            for part in np.array_split(at, len(at) // 200_000 + 1):
                rows = flat[part[:, None] + np.arange(n)]
                h = self.hashes(rows)
                near = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
                for k in np.flatnonzero(wanted[near] == h):
                    if items := self.found.get(tuple(rows[k].tolist())):
                        hits.append((int(part[k]), n))
                        names.setdefault(int(np.searchsorted(starts, part[k], "right")) - 1, set()).update(items)
        ranges: dict[int, list] = {}
        for at, n in sorted(hits):
            doc = int(np.searchsorted(starts, at, "right")) - 1
            begin, own = at - int(starts[doc]), ranges.setdefault(doc, [])
            if own and begin <= own[-1][1]:
                own[-1][1] = max(own[-1][1], begin + n)
            else:
                own.append([begin, begin + n])
        return [(int(starts[d + 1] - starts[d]) - 1, ranges.get(d, []), names.get(d, set())) for d in range(len(texts))]


def blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str | None, bytes]]]:
    """Items in blocks of about ``block_bytes``, one block on the driver at a time. The benchmark's size is measured first."""
    rows = benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t")).where("t is not null")
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-total // block_bytes)
    for k in range(n):
        own = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield [(r.i, r.t.encode()) for r in own.collect()]


def scanned(text: Column, shared) -> Column:
    """Digest of each text against one broadcast block of items."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        only("windows")
        windows = kept("windows", shared.value[0], lambda: Windows(shared.value[1], shared.value[2]))
        for batch in slices(batches):
            out = []
            for n, ranges, items in windows.scan([t or b"" for t in batch.cast(pa.binary()).to_pylist()]):
                out.append({"n_words": n, "n_hit": sum(b - a for a, b in ranges), "items": sorted(x for x in items if x is not None), "spans": [{"start": a, "stop": b} for a, b in ranges]})
            yield pa.array(out, pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))]))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, DIGEST).asNondeterministic()(text)


def merged(first: Column, others: Column) -> Column:
    """The digests of one text by several blocks as one; ``others`` is an array."""
    spans = F.array_sort(F.concat(first["spans"], F.flatten(F.transform(others, lambda d: d["spans"]))))
    whole = F.aggregate(
        spans,
        F.array().cast("array<struct<start:int,stop:int>>"),
        lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["stop"] >= s["start"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["stop"], s["stop"]).alias("stop"))))).otherwise(F.concat(acc, F.array(s))),
    )
    covered = F.aggregate(whole, F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    items = F.array_sort(F.array_distinct(F.concat(first["items"], F.flatten(F.transform(others, lambda d: d["items"])))))
    return F.struct(first["n_words"].alias("n_words"), covered.alias("n_hit"), items.alias("items"), whole.alias("spans"))


def with_digest(docs: DataFrame, benchmark: DataFrame, name: str = "contamination", text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with a struct of n_words, n_hit, items (sorted names) and spans (merged ranges of word positions). A column of
    that name gives way."""
    import uuid

    sc, columns = docs.sparkSession.sparkContext, [c for c in docs.columns if c != name]
    found = hits = None
    for block in blocks(benchmark, text="text", block_bytes=block_bytes):
        shared = sc.broadcast((uuid.uuid4().hex, block, window))
        if found is None:
            found = docs.select(*columns, scanned(docs[text], shared).alias("__ts_digest"))
            continue
        if hits is None:
            found = staged(found.withColumn("__ts_row", F.monotonically_increasing_id()), "contamination")
        more = staged(found.select("__ts_row", scanned(F.col(text), shared).alias("d")).where("d.n_hit > 0"), "hits")
        hits = more if hits is None else hits.unionByName(more)
    if found is None:
        found = docs.select(*columns, scanned(docs[text], sc.broadcast((uuid.uuid4().hex, [], window))).alias("__ts_digest"))
    if hits is None:
        return found.withColumnRenamed("__ts_digest", name)
    gathered = hits.groupBy(F.col("__ts_row").alias("__ts_of")).agg(F.collect_list("d").alias("__ts_more"))  # a row a block at most
    met = found.join(gathered, F.col("__ts_row") == F.col("__ts_of"), "left")
    return met.select(*columns, F.when(F.col("__ts_more").isNull(), F.col("__ts_digest")).otherwise(merged(F.col("__ts_digest"), F.col("__ts_more"))).alias(name))


def is_contaminated(digest: Column) -> Column:
    """At least a twentieth of the words, and one at least, are inside windows."""
    return (digest["n_hit"] > 0) & (20 * digest["n_hit"] >= digest["n_words"])


def without_spans(text: Column, spans: Column) -> Column:
    """The text without the words of the spans; what stands between words stays as it is."""

    def run(texts: pa.Array, found: pa.Array) -> pa.Array:
        import re

        word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
        out = []
        for t, ranges in zip(texts.to_pylist(), found.to_pylist()):
            if t and ranges:
                at = [m.span() for m in word.finditer("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))]
                for r in reversed(ranges):
                    t = t[: at[r["start"]][0]] + t[at[r["stop"] - 1][1] :]
            out.append(t)
        return pa.array(out, pa.string())

    run.__annotations__ = {"texts": pa.Array, "found": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "string")(text, spans)


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", text: str = "text") -> DataFrame:
    """Documents without contaminated ones (``remove="documents"``), or all of them without the hit words (``"spans"``)."""
    columns = docs.columns
    found = with_digest(docs, benchmark, "__ts_found", text)
    if remove == "documents":
        return found.where(~is_contaminated(F.col("__ts_found"))).select(*columns)
    return found.withColumn(text, without_spans(F.col(text), F.col("__ts_found.spans"))).select(*columns)
