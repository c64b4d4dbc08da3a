"""Language-model scores from a subword lattice: the marginal probability of a text over all its segmentations.

The pieces are those of an existing vocabulary file. Their probabilities start from the vocabulary's own order (Zipf: a file of kind
BPE has merge ranks for scores, no probabilities) and are then fitted by STEPS expectation-maximisation steps over every distinct word
of the training documents, weighted by its count. A word's log10 probability is the forward recursion over its lattice in log space;
letters that the vocabulary lacks are spelled with its byte pieces. A text's is the sum over its words plus the end's.

Each distinct word of the corpus is counted and scored once, in a table that is dealt out by word. The at most HEAD_ROWS most
frequent words are broadcast (a fixed bound); other words of a document meet the table in a join on the word, where none of them
is hot, since all hot words are in the head.

Sums over tasks are of fixed-point numbers, so that no result depends on the order in which tasks end. Null texts are empty: only the
end is scored. Documents without an id are training ones. Repeated rows count each time.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.process_cache import give_back, kept, only
from tessera.llm.quality import bucket
from tessera.llm.words import slices
from tessera.plans.staging import staged

#: Most frequent words that are broadcast.
HEAD_ROWS = 200_000
#: Distinct words that a task counts before it hands them on.
COUNTED_ROWS = 600_000
MISSING = 0.1
#: Expectation-maximisation steps.
STEPS = 2
SPACE = "▁"
NEG = -1e300
#: A word whose probability is below this is fitted in log space: far enough above the smallest double for the word's parts.
LEAST = 1e-250
#: Fixed-point numbers have so many parts of one.
PARTS = 10**10


class Lattice:
    """Pieces with probabilities. ``pieces``: (text, id); ``bytes_``: ids of the 256 byte pieces; ``logs``: natural logs by id."""

    def __init__(self, pieces: list[tuple[str, int]], bytes_: list[int], logs: list[float]):
        import ahocorasick

        self.bytes_, self.logs = bytes_, logs
        self.automaton = ahocorasick.Automaton()
        for text, i in pieces:
            self.automaton.add_word(text, (len(text), i))
        self.automaton.make_automaton()
        self.letters = {text for text, _ in pieces if len(text) == 1}
        self.odds = [math.exp(x) for x in logs]

    def edges(self, word: str) -> list[tuple[int, int, int]]:
        """(start, end, id or minus the start minus one for a letter that is spelled in bytes), by end."""
        found = [(e + 1 - size, e + 1, i) for e, (size, i) in self.automaton.iter(word)]
        if not self.letters.issuperset(word):
            found += [(k, k + 1, -k - 1) for k, c in enumerate(word) if c not in self.letters]
            found.sort(key=lambda x: x[1])
        return found

    def spelled(self, letter: str) -> list[int]:
        return [self.bytes_[b] for b in letter.encode()]

    def weight(self, word: str, i: int) -> float:
        return self.logs[i] if i >= 0 else sum(self.logs[b] for b in self.spelled(word[-i - 1]))

    def log10(self, word: str) -> float:
        """Forward recursion in log space over all segmentations of the word."""
        word, logs = SPACE + word, self.logs
        ahead = [NEG] * (len(word) + 1)
        ahead[0] = 0.0
        for start, end, i in self.edges(word):
            x = ahead[start] + (logs[i] if i >= 0 else self.weight(word, i))
            y = ahead[end]
            if y == NEG:
                ahead[end] = x
            elif x > y:
                ahead[end] = x + math.log1p(math.exp(y - x))
            else:
                ahead[end] = y + math.log1p(math.exp(x - y))
        return ahead[-1] / math.log(10)

    def expect(self, word: str, count: int, into: list[float]) -> None:
        """Add the expected uses of each piece in ``count`` words, by the forward and backward recursions."""
        word = SPACE + word
        edges = self.edges(word)
        ahead, back = [0.0] * (len(word) + 1), [0.0] * (len(word) + 1)
        ahead[0] = back[-1] = 1.0
        odds = self.odds if self.letters.issuperset(word) else {i: self.odds[i] if i >= 0 else math.exp(self.weight(word, i)) for _, _, i in edges}
        for start, end, i in edges:
            ahead[end] += ahead[start] * odds[i]
        if ahead[-1] >= LEAST:
            scale = count / ahead[-1]
            for start, end, i in reversed(edges):
                x = odds[i] * back[end]
                back[start] += x
                if i >= 0:
                    into[i] += ahead[start] * x * scale
                else:
                    for k in self.spelled(word[-i - 1]):
                        into[k] += ahead[start] * x * scale
            return
        add = lambda x, y: max(x, y) + math.log1p(math.exp(min(x, y) - max(x, y))) if min(x, y) > NEG else max(x, y)
        ahead, back = [NEG] * (len(word) + 1), [NEG] * (len(word) + 1)
        ahead[0] = back[-1] = 0.0
        for start, end, i in edges:
            ahead[end] = add(ahead[end], ahead[start] + self.weight(word, i))
        for start, end, i in sorted(edges, key=lambda e: -e[0]):
            x = self.weight(word, i) + back[end]
            back[start] = add(back[start], x)
            use = count * math.exp(min(0.0, ahead[start] + x - ahead[-1]))
            for k in [i] if i >= 0 else self.spelled(word[-i - 1]):
                into[k] += use


def vocabulary(path: str) -> tuple[list[tuple[str, int]], list[int], list[float]]:
    """Pieces, byte pieces and first logs of a sentencepiece vocabulary file."""
    import sentencepiece

    file = sentencepiece.SentencePieceProcessor(model_file=path)
    size = file.vocab_size()
    pieces = [(file.id_to_piece(i), i) for i in range(size) if not (file.is_byte(i) or file.is_control(i) or file.is_unknown(i) or file.is_unused(i))]
    bytes_ = [file.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    odds = [1.0 / (i + 10) for i in range(size)]
    total = sum(odds)
    return pieces, bytes_, [math.log(x / total) for x in odds]


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    only()
    trained: Counter = Counter()
    others: Counter = Counter()

    def emit():
        keys = list(trained.keys() | others.keys())
        for i in range(0, len(keys), 50_000):
            own = keys[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()).cast(pa.string()), pa.array([trained[k] for k in own], pa.int64()), pa.array([trained[k] + others[k] for k in own], pa.int64())], ["word", "c", "n"])

    for batch in batches:
        texts = batch.column(0).cast(pa.binary())
        for i in range(0, len(texts), 256):
            for text, train in zip(texts[i : i + 256].to_pylist(), batch.column(1)[i : i + 256].to_pylist()):
                if text:
                    (trained if train else others).update(text.lower().split())
            if len(trained) + len(others) > COUNTED_ROWS:
                yield from emit()
                trained.clear()
                others.clear()
    yield from emit()
    trained.clear()
    others.clear()
    give_back()


def _expectation(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("lattice")
        lattice = kept("lattice", shared.value[0], lambda: Lattice(*shared.value[1:]))
        into = [0.0] * len(lattice.logs)
        for batch in batches:
            for word, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lattice.expect(word, count, into)
        ids = [i for i, x in enumerate(into) if x]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array([into[i] for i in ids], pa.float64())], ["id", "uses"])

    return run


def word_scores(word: Column, shared) -> Column:
    """log10 probability of each word."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        only("lattice")
        lattice = kept("lattice", shared.value[0], lambda: Lattice(*shared.value[1:]))
        for batch in batches:
            yield pa.array([lattice.log10(w) for w in batch.to_pylist()], pa.float64())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "double").asNondeterministic()(word)


def _head_scores(text: Column, shared) -> Column:
    """Counts and sums over a text's frequent words; its other words, as often as they stand there."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np

        only("head")
        numbers, base, score, known = kept("head", shared.value[0], lambda: _head(*shared.value[1:]))
        for batch in slices(batches):
            words = [(t or b"").lower().split() for t in batch.cast(pa.binary()).to_pylist()]
            sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
            flat = list(chain.from_iterable(words))
            ids = np.fromiter(map(numbers.get, flat, repeat(len(numbers))), dtype=np.int64, count=len(flat))  # the last row: a word of the tail
            doc, tail = np.repeat(np.arange(len(words)), sizes), np.flatnonzero(ids == len(numbers))
            summed = lambda values: np.bincount(doc, weights=values[ids], minlength=len(words))
            ends = np.concatenate([[0], np.cumsum(np.bincount(doc[tail], minlength=len(words)))]) if len(words) else [0]
            others = pa.array([flat[i] for i in tail.tolist()], pa.binary()).cast(pa.string())
            columns = [pa.array(sizes), pa.array(summed(known).astype(np.int64)), pa.array(summed(base)), pa.array(summed(score)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), others)]
            yield pa.StructArray.from_arrays(columns, ["n", "known", "base", "score", "tail"])
        give_back()

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "n long, known long, base double, score double, tail array<string>").asNondeterministic()(text)


def _head(words: list[bytes], *columns: list) -> tuple:
    """Numbers of the frequent words, and columns of their values with a zero behind."""
    import numpy as np

    return dict(zip(words, range(len(words)))), *(np.array([*c, 0], dtype=float) for c in columns)


def head_cut(words: DataFrame, head_rows: int) -> int:
    """The least count such that at most ``head_rows`` words have it or more, from a histogram of counts' leading bits."""
    taken, cut = 0, 1 << 62
    for low, n in sorted(words.groupBy(bucket(F.col("n"), 6).alias("low")).count().collect(), reverse=True):  # under 2,000 buckets
        taken += n
        if taken > head_rows:
            break
        cut = low
    return cut


def scores(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", head_rows: int = HEAD_ROWS) -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one for each row of ``docs``."""
    import uuid

    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    held = F.coalesce(F.crc32(docs[doc_id].cast("string")) % 10 == 0, F.lit(False))
    slim = docs.select(docs[doc_id].alias("doc_id"), held.alias("held_out"), docs[text].alias("text"))
    counts = slim.select("text", (~F.col("held_out")).alias("train")).mapInArrow(_word_counts, "word string, c long, n long")
    counts = staged(counts.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n")), "words")
    ends = slim.where("not held_out").count()
    tokens, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    tokens, kinds = tokens + ends, kinds + (ends > 0)

    pieces, bytes_, logs = vocabulary(path)
    fitted = sc.broadcast((uuid.uuid4().hex, pieces, bytes_, logs))
    for _ in range(STEPS):
        uses = counts.where("c > 0").select("word", "c").mapInArrow(_expectation(fitted), "id int, uses double").groupBy("id").agg(F.sum(F.col("uses").cast("decimal(30,6)")).cast("double").alias("uses"))
        expected = dict(sorted(uses.collect()))  # at most one row for each piece of the vocabulary
        total = sum(expected.values()) + ends + MISSING * (len(logs) + 1)
        fitted = sc.broadcast((uuid.uuid4().hex, pieces, bytes_, [math.log((expected.get(i, 0.0) + MISSING) / total) for i in range(len(logs))]))
    end_score = math.log10((ends + MISSING) / total)

    words = staged(counts.withColumn("score", word_scores(F.col("word"), fitted)), "scored_words").withColumn("base", F.log10(F.col("c") + MISSING))
    top = words.where(F.col("n") >= head_cut(words, head_rows)).select("word", "base", "score", (F.col("c") > 0).cast("int").alias("known")).toArrow()
    head = sc.broadcast((uuid.uuid4().hex, top.column("word").cast(pa.binary()).to_pylist(), *(top.column(c).to_pylist() for c in ("base", "score", "known"))))

    part = staged(slim.select("doc_id", "held_out", F.monotonically_increasing_id().alias("row"), _head_scores(F.col("text"), head).alias("h")), "heads")
    total_of = lambda c: (F.sum(F.round(F.col(c) * PARTS).cast("long")) / PARTS).alias(f"t_{c}")
    tail = part.select("row", F.explode("h.tail").alias("word")).join(words, "word").groupBy("row").agg(total_of("base"), total_of("score"), F.count_if(F.col("c") > 0).alias("t_known"))
    out = part.select("doc_id", "held_out", "row", "h.n", "h.known", "h.base", "h.score").join(tail.withColumnRenamed("row", "t_row"), F.col("row") == F.col("t_row"), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    norm = math.log10(tokens + MISSING * (kinds + 1))
    n = F.col("n") + 1
    return out.select(
        "doc_id", "held_out", n.alias("n_tokens"), (F.col("known") + zero("t_known") + int(ends > 0)).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + zero("t_base") + math.log10(ends + MISSING) - n * norm).alias("base_score"), (F.col("score") + zero("t_score") + end_score).alias("score"),
    )
