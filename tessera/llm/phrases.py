"""Phrase collocations by vertical positional inverted lists.

Texts are dealt into blocks of about two million words. A block holds, for every word, the ascending list of the places where it occurs;
places skip one between pieces, so no phrase crosses their border. A phrase of k + 1 words occurs where a frequent phrase of k words
occurs and the frequent phrase of k words that ends with the adjacent word occurs one place further: its list is the merge join of the
two lists, and the length of the list, summed over blocks, is its exact frequency. Lists stay in their block. What is shuffled is the
length of each distinct list of a block, packed by buckets of phrases; what comes back is which of them are frequent, and their numbers.
Buckets are as many as there are millions of places, so a bucket is about as large at every size of the table; a phrase has one length a
block, so no phrase is hot.

Everything is per language. A phrase's number is exact (its bucket and rank there), never a hash. Frequencies of all prefixes and
suffixes of a candidate come along from the shorter phrases, so scores need no further count.

Null texts have no words; a null language is ``und``. Tied scores are ranked by frequency, then by the phrase's bytes; two phrases never
tie in all. Repeated rows count as often as they occur. A text of any length lies in one block. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.process_cache import give_back, only
from tessera.llm.words import slices
from tessera.plans.staging import recorded, remove, staged

LEAST, LONGEST, TOP = 100, 5, 2_000
#: Words in one block, and bytes of text that are split at once.
BLOCK_WORDS, SPLIT_BYTES = 2_000_000, 1_000_000
#: Places (or, for single words, bytes of text) that a bucket of phrases is made for.
BUCKET_PLACES, BUCKET_BYTES = 1_000_000, 32_000_000
#: A block's number is the task's, and its place in the task.
PLACE_BITS = 12
MULTIPLIER = 0x9E3779B97F4A7C15
LISTS = "block long, ids array<long>, lengths array<int>, lists binary"
COUNTS = "bucket long, block long, first binary, second binary, n binary"
FOUND = "block long, bucket long, place binary, ids binary, first array<long>, second array<long>, words array<string>, a array<long>"
#: Rows of candidates a bucket of the last ranking has.
RANK_BUCKET = 100_000


def byte_table() -> bytes:
    """Upper-case letters become lower case, a separator becomes a line end and a tab a space."""
    return bytes(b + 32 if 0x41 <= b <= 0x5A else 10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))


def shrunk(values) -> bytes:
    """Bytes, or an array of numbers byte by byte (all lowest bytes first), compressed."""
    import numpy as np

    content = values if isinstance(values, bytes) else np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes()
    return len(content).to_bytes(8, "little") + pa.compress(content, codec="zstd", asbytes=True)


def grown(content: bytes, kind=None):
    import numpy as np

    content = pa.decompress(content[8:], int.from_bytes(content[:8], "little"), codec="zstd", asbytes=True)
    return np.frombuffer(content, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel() if kind else content


def packed(at, lengths) -> bytes:
    """Ascending lists, one behind the other, as differences."""
    import numpy as np

    steps = np.diff(at, prepend=at[:1] * 0)
    starts = np.cumsum(lengths)[:-1]
    steps[starts] = at[starts]
    return shrunk(steps.astype(np.int32))


def unpacked(lists: bytes, lengths):
    import numpy as np

    if not len(lengths):
        return np.empty(0, np.int64)
    at = np.cumsum(grown(lists, np.int32).astype(np.int64))
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    return at - np.repeat(np.where(starts, at[starts - 1], 0), lengths)


class Block:
    """Words of some texts, gathered until there are enough for a block."""

    def __init__(self):
        self.parts, self.n, self.names, self.langs, self.words, self.totals = [], 0, {}, [], [], {}

    def number(self, lang: str) -> dict:
        outer, langs, words = self, self.langs, self.words

        class Numbers(dict):
            def __missing__(self, word):
                langs.append(lang)
                words.append(word)
                self[word] = n = len(words)
                return n

        if lang not in outer.names:
            outer.names[lang] = Numbers({b"": -1, b"\n": 0})
        return outer.names[lang]

    def add(self, lang: str, text: bytes) -> None:
        import numpy as np

        number, count = self.number(lang), 0
        at = 0
        while at < len(text):
            stop = len(text)
            if at + SPLIT_BYTES < stop:
                ends = [x for x in (text.find(b" ", at + SPLIT_BYTES), text.find(b"\n", at + SPLIT_BYTES)) if x >= 0]
                stop = min(ends, default=stop)
            tokens = text[at:stop].replace(b"\n", b" \n ").split(b" ")
            ids = np.fromiter(map(number.__getitem__, tokens), np.int32, len(tokens))
            ids = ids[ids >= 0]
            count += int((ids > 0).sum())
            self.parts.append(ids)
            at = stop
        self.parts.append(np.zeros(1, np.int32))  # no phrase crosses two texts
        self.n += count
        self.totals[lang] = self.totals.get(lang, 0) + count

    def rows(self, block: int, share: int) -> Iterator[pa.RecordBatch]:
        """The lists, ordered by their words' buckets, and each bucket's words with the lengths."""
        import numpy as np

        stream = np.concatenate(self.parts)
        prefix = {lang: quote(lang, "").encode() + b"\t" for lang in self.names}
        keys = np.array([prefix[lang] + w for lang, w in zip(self.langs, self.words)], dtype=object)
        bucket = np.fromiter((zlib.crc32(k) % share for k in keys), np.int64, len(keys))
        order = np.argsort(bucket, kind="stable")
        number = np.zeros(len(keys) + 1, np.int64)
        number[order + 1] = np.arange(1, len(keys) + 1)
        stream = number[stream]
        at = np.argsort(stream, kind="stable")
        lengths = np.bincount(stream, minlength=len(keys) + 1)
        at, lengths, keys, bucket = at[lengths[0] :], lengths[1:], keys[order], bucket[order]
        starts = np.flatnonzero(np.diff(bucket, prepend=-1))
        yield block_row(block, packed(at, lengths), lengths=lengths, buckets=bucket[starts], starts=starts, totals=self.totals)
        for start, stop in zip(starts, [*starts[1:], len(keys)]):
            yield block_row(block, shrunk(b"\n".join(keys[start:stop])), bucket=int(bucket[start]), n=shrunk(lengths[start:stop].astype(np.int32)))


BLOCKS = "block long, content binary, bucket long, n binary, lengths array<int>, buckets array<long>, starts array<int>, totals array<struct<lang:string,n:long>>"


def block_row(block: int, content: bytes, bucket=None, n=None, lengths=None, buckets=None, starts=None, totals=None) -> pa.RecordBatch:
    listed = lambda v, kind: pa.array([v], pa.list_(kind))
    totals = None if totals is None else [{"lang": k, "n": v} for k, v in totals.items()]
    return pa.RecordBatch.from_arrays(
        [pa.array([block], pa.int64()), pa.array([content], pa.binary()), pa.array([bucket], pa.int64()), pa.array([n], pa.binary()), listed(lengths, pa.int32()), listed(buckets, pa.int64()), listed(starts, pa.int32()), listed(totals, pa.struct([("lang", pa.string()), ("n", pa.int64())]))],
        ["block", "content", "bucket", "n", "lengths", "buckets", "starts", "totals"],
    )


def blocks(docs: DataFrame) -> DataFrame:
    """Two kinds of rows: a block's lists (bucket null), and the words of one bucket in a block."""
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text")).where("text is not null and text != ''")
    share = (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET_BYTES + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        only()
        task, place, held, table = TaskContext.get().partitionId(), 0, Block(), byte_table()
        for batch in slices(batches):
            langs, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
            for lang, text in zip(langs, texts):
                held.add(lang, text.translate(table))
                if held.n >= BLOCK_WORDS and place + 1 < 1 << PLACE_BITS:
                    yield from held.rows(task << PLACE_BITS | place, share)
                    place, held = place + 1, Block()
        if held.n:
            yield from held.rows(task << PLACE_BITS | place, share)
        del held
        give_back()

    return staged(rows.mapInArrow(run, BLOCKS), "words")


def array_of(column):
    return column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[-1].as_py()]


def arrays(columns: dict, schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(columns[f.name], f.type) for f in schema], schema)


FOUND_ARROW = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("place", pa.binary()), ("ids", pa.binary()), ("first", pa.list_(pa.int64())), ("second", pa.list_(pa.int64())), ("words", pa.list_(pa.string())), ("a", pa.list_(pa.int64()))])


def summed(counts: DataFrame, least: int, share: int, whole_words: bool) -> DataFrame:
    """Of the lengths in each bucket: for every block which of its phrases are frequent (places in the block's bucket, and numbers),
    and in a row without a block the frequent phrases themselves, in the order of their numbers."""

    def run(group: pa.Table) -> pa.Table:
        import numpy as np

        bucket = group.column("bucket")[0].as_py()
        group = group.sort_by("block")
        sizes, firsts, seconds, ns = [], [], [], []
        for row in group.to_pylist():
            n = grown(row["n"], np.int32)
            sizes.append(len(n))
            ns.append(n)
            if whole_words:
                firsts += grown(row["first"]).split(b"\n")
            else:
                firsts.append(np.cumsum(grown(row["first"], np.int64)))
                seconds.append(grown(row["second"], np.int64))
        n = np.concatenate(ns).astype(np.int64)
        if whole_words:
            known: dict = {}
            of = np.fromiter((known.setdefault(w, len(known)) for w in firsts), np.int64, len(firsts))
            a = np.bincount(of, n, len(known)).astype(np.int64)
            names = list(known)
        else:
            first, second = np.concatenate(firsts), np.concatenate(seconds)
            order = np.lexsort((second, first))
            new = np.ones(len(order), bool)
            new[1:] = (np.diff(first[order]) != 0) | (np.diff(second[order]) != 0)
            of = np.empty(len(order), np.int64)
            of[order] = np.cumsum(new) - 1
            a = np.bincount(of, n, int(new.sum())).astype(np.int64)
            names = order[new]
        often = np.flatnonzero(a >= least)
        number = np.full(len(a), -1)
        number[often] = np.arange(len(often)) * share + bucket
        out: dict = {f.name: [] for f in FOUND_ARROW}
        at = 0
        for size, block in zip(sizes, group.column("block").to_pylist()):
            own = number[of[at : at + size]]
            at += size
            place = np.flatnonzero(own >= 0)
            if len(place):
                for k, v in (("block", block), ("bucket", bucket), ("place", shrunk(place.astype(np.int32))), ("ids", shrunk(own[place])), ("first", None), ("second", None), ("words", None), ("a", None)):
                    out[k].append(v)
        if len(often):
            pairs = (None, None, [names[i].decode() for i in often]) if whole_words else (first[names[often]], second[names[often]], None)
            for k, v in (("block", None), ("bucket", bucket), ("place", None), ("ids", shrunk(number[often])), ("first", pairs[0]), ("second", pairs[1]), ("words", pairs[2]), ("a", a[often])):
                out[k].append(v)
        return arrays(out, FOUND_ARROW)

    run.__annotations__ = {"group": pa.Table, "return": pa.Table}
    return staged(counts.groupBy("bucket").applyInArrow(run, FOUND), "frequent")


def pair_buckets(prefix, suffix, share: int):
    import numpy as np

    h = (prefix.astype(np.uint64) * np.uint64(MULTIPLIER)) ^ suffix.astype(np.uint64)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(MULTIPLIER)
    return ((h >> np.uint64(20)) % np.uint64(share)).astype(np.int64)


def joined(at, lengths, ids, share: int):
    """Merge join of every list with that of the phrase one place further: (bucket, prefix, suffix, length) of the longer phrases by
    bucket, and their lists."""
    import numpy as np

    order = np.argsort(at, kind="stable")
    place, owner = at[order], np.repeat(np.arange(len(ids)), lengths)[order]
    near = np.flatnonzero(np.diff(place) == 1)
    pair, place = owner[near].astype(np.int64) * len(ids) + owner[near + 1], place[near]
    order = np.argsort(pair, kind="stable")
    pair, place = pair[order], place[order]
    first = np.flatnonzero(np.diff(pair, prepend=-1))
    n = np.diff(np.append(first, len(pair)))
    prefix, suffix = ids[pair[first] // max(len(ids), 1)], ids[pair[first] % max(len(ids), 1)]
    bucket = pair_buckets(prefix, suffix, share)
    order = np.lexsort((suffix, prefix, bucket))
    where = np.repeat(first[order] - np.cumsum(np.append(0, n[order]))[:-1], n[order]) + np.arange(len(place))
    return bucket[order], prefix[order], suffix[order], n[order], place[where]


def candidates(lists: DataFrame, share: int) -> DataFrame:
    """The longer phrases of each block, a row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in slices(batches, 1):
            ids, lengths = array_of(batch.column("ids")), array_of(batch.column("lengths"))
            bucket, prefix, suffix, n, _ = joined(unpacked(batch.column("lists")[0].as_py(), lengths), lengths, ids, share)
            starts = np.flatnonzero(np.diff(bucket, prepend=-1))
            parts = [slice(a, b) for a, b in zip(starts, [*starts[1:], len(bucket)])]
            for i in range(0, len(parts), 1_000):
                own = parts[i : i + 1_000]
                columns = [bucket[starts[i : i + 1_000]], np.full(len(own), batch.column("block")[0].as_py()), [shrunk(np.diff(prefix[p], prepend=0)) for p in own], [shrunk(suffix[p]) for p in own], [shrunk(n[p].astype(np.int32)) for p in own]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["bucket", "block", "first", "second", "n"])

    return lists.mapInArrow(run, COUNTS)


def back(lists: DataFrame, found: DataFrame) -> DataFrame:
    """``lists`` with what of each block is frequent. A block's rows are bounded by its words."""
    own = found.where("block is not null").groupBy(F.col("block").alias("__ts_b")).agg(F.collect_list(F.struct("bucket", "place", "ids")).alias("found"))
    return lists.join(own, lists.block == own["__ts_b"]).drop("__ts_b")


def marked(found: list, buckets, starts):
    """(index, number) of the frequent phrases of a block, by index."""
    import numpy as np

    base = dict(zip(buckets.tolist(), starts.tolist()))
    index = np.concatenate([grown(r["place"], np.int32) + base[r["bucket"]] for r in found])
    ids = np.concatenate([grown(r["ids"], np.int64) for r in found])
    order = np.argsort(index)
    return index[order], ids[order]


def lists_row(block: int, ids, lengths, at) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int32())), pa.array([packed(at, lengths)], pa.binary())], ["block", "ids", "lengths", "lists"])


def kept_lists(table: DataFrame) -> DataFrame:
    """Of blocks with what is frequent: the lists of the frequent words, under their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in slices(batches, 1):
            lengths, buckets, starts = (array_of(batch.column(c)) for c in ("lengths", "buckets", "starts"))
            index, ids = marked(batch.column("found")[0].as_py(), buckets, starts)
            keep = np.zeros(len(lengths), bool)
            keep[index] = True
            yield lists_row(batch.column("block")[0].as_py(), ids, lengths[index], unpacked(batch.column("content")[0].as_py(), lengths)[np.repeat(keep, lengths)])

    return table.select("block", "content", "lengths", "buckets", "starts", "found").mapInArrow(run, LISTS)


def longer_lists(table: DataFrame, share: int) -> DataFrame:
    """Of lists with what is frequent among their longer phrases: the lists of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in slices(batches, 1):
            ids, lengths = array_of(batch.column("ids")), array_of(batch.column("lengths"))
            bucket, _, _, n, at = joined(unpacked(batch.column("lists")[0].as_py(), lengths), lengths, ids, share)
            starts = np.flatnonzero(np.diff(bucket, prepend=-1))
            index, found = marked(batch.column("found")[0].as_py(), bucket[starts], starts)
            keep = np.zeros(len(n), bool)
            keep[index] = True
            yield lists_row(batch.column("block")[0].as_py(), found, n[index], at[np.repeat(keep, n)])

    return table.select("block", "ids", "lengths", "lists", "found").mapInArrow(run, LISTS)


def phrase_rows(found: DataFrame) -> DataFrame:
    """Rows (id, first, second, word, a) of the frequent phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in slices(batches, 1):
            ids, a = grown(batch.column("ids")[0].as_py(), np.int64), array_of(batch.column("a"))
            one = lambda c, kind: batch.column(c).flatten() if batch.column(c)[0].is_valid else pa.nulls(len(ids), kind)
            yield pa.RecordBatch.from_arrays([pa.array(ids), one("first", pa.int64()), one("second", pa.int64()), one("words", pa.string()), pa.array(a)], ["id", "first", "second", "word", "a"])

    return found.where("block is null").select("ids", "first", "second", "words", "a").mapInArrow(run, "id long, first long, second long, word string, a long")


def counted(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, list[DataFrame]]:
    """Words of each language (lang, n), and for each length from 1 the frequent phrases: (id, lang, phrase, last, a, before, after),
    ``before`` and ``after`` the frequencies of the shorter prefixes and suffixes by length, longer ones also (prefix, suffix,
    prefix_a, suffix_a). Lists go when those of the next length are written."""
    spark = docs.sparkSession
    with recorded() as old:
        whole = blocks(docs)
    words, by_bucket = whole.where("bucket is null"), whole.where("bucket is not null")
    totals = staged(words.select(F.explode("totals").alias("t")).groupBy(F.col("t.lang").alias("lang")).agg(F.sum("t.n").alias("n")).where("n > 0"), "totals")
    share = int(by_bucket.agg(F.max("bucket")).first()[0] or 0) + 1
    found = summed(by_bucket.select("bucket", "block", F.col("content").alias("first"), F.lit(None).cast("binary").alias("second"), "n"), least, share, True)

    def named(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            parts = [w.split("\t", 1) for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([unquote(x) for x, _ in parts], pa.string()), pa.array([w for _, w in parts], pa.string()), batch.column("a")], ["id", "lang", "phrase", "a"])

    none = F.array().cast("array<long>")
    levels = [staged(phrase_rows(found).select("id", "word", "a").mapInArrow(named, "id long, lang string, phrase string, a long").select("id", "lang", "phrase", F.col("phrase").alias("last"), "a", none.alias("before"), none.alias("after")), "phrases")]
    lists = kept_lists(back(words, found))
    for _ in range(2, longest + 1):
        with recorded() as made:
            lists = staged(lists, "lists")
            remove(spark, old)
            share = int(levels[-1].agg(F.sum("a")).first()[0] or 0) // BUCKET_PLACES + 1
            found = summed(candidates(lists, share), least, share, False)
        p = levels[-1].select(F.col("id").alias("p_id"), "lang", F.col("phrase").alias("p_phrase"), F.col("a").alias("prefix_a"), F.col("before").alias("p_before"))
        s = levels[-1].select(F.col("id").alias("s_id"), "last", F.col("a").alias("suffix_a"), F.col("after").alias("s_after"))
        pairs = phrase_rows(found).select("id", F.col("first").alias("prefix"), F.col("second").alias("suffix"), "a")
        longer = pairs.join(p, F.col("prefix") == F.col("p_id")).join(s, F.col("suffix") == F.col("s_id"))
        levels.append(staged(longer.select("id", "lang", F.concat_ws(" ", "p_phrase", "last").alias("phrase"), "last", "a", F.concat("p_before", F.array("prefix_a")).alias("before"), F.concat("s_after", F.array("suffix_a")).alias("after"), "prefix", "suffix", "prefix_a", "suffix_a"), "phrases"))
        lists, old = longer_lists(back(lists, found), share), made
    remove(spark, old)
    return totals, levels


def scored(found: DataFrame, totals: DataFrame) -> DataFrame:
    """Each phrase by its lowest-scoring cut: (lang, phrase, a, l, r, n, score). Products are decimals of 38 digits."""
    own = totals.withColumnRenamed("lang", "__ts_lang")
    found = found.join(F.broadcast(own) if totals.count() <= 100_000 else own, F.col("lang") == F.col("__ts_lang"))
    exact = lambda c: c.cast("decimal(19,0)")

    def cut(before, k):
        after = F.element_at("after", F.size("after") - k)
        score = F.call_function("div", exact(F.col("a")) * exact(F.col("n")) * F.lit(1000).cast("decimal(4,0)"), exact(before) * exact(after))
        return F.struct(score.alias("score"), k.alias("k"), before.alias("l"), after.alias("r"))

    found = found.withColumn("cut", F.array_min(F.transform("before", cut)))
    return found.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))


def first_of(rows: DataFrame, order: list[Column], top: int, n: int) -> DataFrame:
    """The first rows of each language with ``rank``. About ``n`` rows go through rounds of buckets, so that no window holds more than a
    bucket's rows."""
    share = n // RANK_BUCKET + 1
    while share > 1:
        inside = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(share))).orderBy(*order)
        rows = rows.withColumn("rank", F.row_number().over(inside)).where(F.col("rank") <= top).drop("rank")
        share = share * top // RANK_BUCKET + 1 if top < RANK_BUCKET // 2 else 1
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): each language's first candidates by score, frequency and phrase. A candidate that lies in
    a longer one as frequent as itself goes; as frequencies never grow with length, one more word decides."""
    totals, levels = counted(docs, least, longest)
    levels = levels[1:]
    kept = []
    for found, longer in zip(levels, [*levels[1:], None]):
        if longer is not None:
            inside = longer.where("100 * a >= 100 * prefix_a").select(F.col("prefix").alias("gone")).union(longer.where("100 * a >= 100 * suffix_a").select("suffix")).distinct()
            found = found.join(inside, found.id == inside.gone, "left_anti")
        kept.append(found.select("lang", "phrase", "a", "before", "after"))
    rows = scored(reduce(DataFrame.unionByName, kept), totals)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    return first_of(rows, order, top, sum(x.count() for x in levels)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
