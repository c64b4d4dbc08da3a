"""Toxicity by a linear classifier of character n-grams whose features are scaled by naive Bayes log-count ratios.

A text is lower-cased and its words stand between single spaces. Features are the n-grams of 3 to 6 characters that lie in one word with
its two spaces, dealt by their hash into buckets; a feature's value is log(1 + 200 * occurrences / words), so long texts are judged by how
often and not by whether. Over the labelled sample each bucket has a log-count ratio r: the log of its
mean value in toxic texts over that in others, both smoothed. Values times r are what a logistic regression with squared penalty sees; classes weigh as in
all labelled rows, so the score is a probability.

The fit reads a bounded sample: at most ``sample_rows`` labelled rows of each class, those of the least hashes, and of these as many as
have ``sample_bytes`` of text together (texts of more than an eighth of it are left out of the fit). Scoring reads every whole text. Its model is a table of a fixed number of weights, broadcast.

Null and empty texts have no features; their score is that of the intercept. Rows labelled more than once are toxic if one label says so; null
labels count as none. Without labelled rows of both classes the score is the share of toxic ones (0 without any). Repeated and tied rows
are scored each by itself; further columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.process_cache import kept, only
from tessera.llm.words import slices

SAMPLE_ROWS, SAMPLE_BYTES = 2_500, 8_000_000
LENGTHS = (3, 4, 5, 6)
BUCKET_BITS = 22
MULTIPLIER = 0x9E3779B97F4A7C15
RATE, SMOOTHING, LEAST_TEXTS, LEAST_RATIO, PENALTY = 200.0, 2.0, 5, 1.0, 1.0
THRESHOLD = 0.3
#: Characters that are hashed at once.
CHARACTERS = 1_000_000


def grams(text: str | None) -> tuple[Iterator, int]:
    """Arrays of the n-grams' buckets, a part of the text at a time, and the text's number of words."""
    words = (text or "").lower().split()

    def parts():
        at = 0
        while at < len(words):
            held, size = at, 0
            while at < len(words) and size < CHARACTERS:
                size += len(words[at]) + 1
                at += 1
            yield from buckets(" " + " ".join(words[held:at]) + " ")

    return parts(), len(words)


def buckets(spaced: str) -> Iterator:
    import numpy as np

    points = np.frombuffer(spaced.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    inner = np.concatenate([[0], np.cumsum(points == 32)])  # spaces before each place
    h = points.copy()
    for n in range(2, max(LENGTHS) + 1):
        if len(points) < n:
            return
        h = (h[: len(points) - n + 1] * np.uint64(MULTIPLIER)) ^ points[n - 1 :]
        if n in LENGTHS:
            whole = inner[n - 1 : len(points)] == inner[1 : len(points) - n + 2]  # no space but at the ends
            mixed = (h[whole] ^ np.uint64(n)) * np.uint64(MULTIPLIER)
            yield ((mixed ^ (mixed >> np.uint64(32))) * np.uint64(MULTIPLIER) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def counted(text: str | None, wanted=None) -> tuple:
    """(buckets, values) of a text, buckets ascending; only those that ``wanted``, a table of flags, holds."""
    import numpy as np

    found, n = grams(text)
    held = [np.unique(b[wanted[b]] if wanted is not None else b, return_counts=True) for b in found]
    if not held:
        return np.empty(0, np.int64), np.empty(0)
    ids, inverse = np.unique(np.concatenate([b for b, _ in held]), return_inverse=True)
    return ids, np.log1p(RATE / n * np.bincount(inverse, np.concatenate([c for _, c in held]), len(ids)))


def fitted(texts: list[str], toxic: list[int], share: float) -> tuple:
    """(buckets, weights, intercept) from labelled texts; ``share`` is that of toxic texts among all labelled ones."""
    import numpy as np

    y = np.array(toxic, dtype=float)
    share = min(max(share, 0.0), 1.0)
    if not len(y) or y.min() == y.max():
        share = share if len(y) else 0.0
        return np.empty(0, np.int64), np.empty(0), float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    size = 1 << BUCKET_BITS
    mass, present = np.zeros((2, size), np.float32), np.zeros(size, np.int32)
    for text, label in zip(texts, toxic):
        ids, values = counted(text)
        mass[label, ids] += values
        present[ids] += 1
    part = np.array([1 - y.mean(), y.mean()], np.float32)[:, None]
    shares = (mass + SMOOTHING * part) / part  # a bucket that no text has is equal in both
    ratio = np.log(shares[1]) - np.log(shares[0])
    wanted = (present >= LEAST_TEXTS) & (np.abs(ratio) >= LEAST_RATIO)
    names = np.flatnonzero(wanted)
    rows = [counted(t, wanted) for t in texts]
    ends = np.cumsum([len(ids) for ids, _ in rows])
    columns = np.searchsorted(names, np.concatenate([ids for ids, _ in rows]))
    data = np.concatenate([v for _, v in rows]) * ratio[names][columns]
    of = np.repeat(np.arange(len(rows)), np.diff(ends, prepend=0))
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    w, b = regression(columns, of, data, y, weight, len(names))
    return names, w * ratio[names], b


def regression(columns, of, data, y, weight, width: int, steps: int = 15) -> tuple:
    """Weights and intercept of a logistic regression with squared penalty (none on the intercept), by Newton steps solved with
    conjugate gradients. Entry k of the matrix is data[k] in row of[k] and column columns[k]."""
    import numpy as np

    n = len(y)
    forward = lambda v: np.bincount(of, data * v[columns], n) + v[-1]
    back = lambda g: np.append(np.bincount(columns, data * g[of], width), g.sum())
    damp = np.append(np.full(width, PENALTY), 1e-6)
    loss = lambda v, m: (weight * (np.logaddexp(0, m) - y * m)).sum() + 0.5 * (damp * v * v).sum()
    v = np.zeros(width + 1)
    m = forward(v)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(m, -500, 500)))
        gradient = back(weight * (p - y)) + damp * v
        if np.abs(gradient).max() < 1e-2:
            break
        curve = weight * p * (1 - p)
        step, residual = np.zeros_like(v), -gradient
        direction, power = residual.copy(), residual @ residual
        for _ in range(20):
            image = back(curve * forward(direction)) + damp * direction
            a = power / (direction @ image)
            step, residual = step + a * direction, residual - a * image
            after = residual @ residual
            if after < 1e-3 * (gradient @ gradient):
                break
            direction, power = residual + after / power * direction, after
        now, rate = loss(v, m), 1.0
        while rate > 1e-6:
            ahead = forward(v + rate * step)
            if loss(v + rate * step, ahead) <= now + 1e-4 * rate * (gradient @ step):
                break
            rate /= 2
        else:
            break
        v, m = v + rate * step, ahead
    return v[:-1], float(v[-1])


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % 4 == 2


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> tuple[list[str], list[int], float]:
    """Texts and labels of the fit, and the share of toxic ones among all labelled rows outside the held-out fold."""
    spark = docs.sparkSession
    said = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic")).where(~is_held_out(F.col("doc_id")))
    number = {r.toxic: r.n for r in said.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    texts, toxic = [], []
    order = F.xxhash64("doc_id"), F.col("doc_id")
    for label in (0, 1):
        chosen = said.where(F.col("toxic") == label).select(F.col("doc_id").alias("__ts_id")).orderBy(F.xxhash64("__ts_id"), "__ts_id").limit(rows)
        ids = spark.createDataFrame([(r[0],) for r in chosen.collect()], chosen.schema)
        size = F.coalesce(F.octet_length("text"), F.lit(0))
        own = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("__ts_id")).where(size <= most_bytes // 8)  # at most ``rows`` ids
        used = 0
        for r in own.select("doc_id", "text").orderBy(*order, "text").limit(rows).toLocalIterator():
            used += len((r.text or "").encode())
            if used > most_bytes:
                break
            texts.append(r.text or "")
            toxic.append(label)
    total = sum(number.values())
    return texts, toxic, number.get(1, 0) / total if total else 0.0


def scored(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES, name: str = "toxicity") -> DataFrame:
    """``docs`` with column ``name``: the probability that a text is toxic, rounded to nine digits."""
    names, weights, intercept = fitted(*sample(docs, labels, rows, most_bytes))
    shared = docs.sparkSession.sparkContext.broadcast((names.astype("int32"), weights.astype("float32"), intercept))

    def table():
        import numpy as np

        out = np.zeros(1 << BUCKET_BITS, np.float32)
        out[shared.value[0]] = shared.value[1]
        return out

    version = (len(names), float(weights.sum()), intercept)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np

        only("toxicity")
        weight, b = kept("toxicity", version, table), shared.value[2]
        wanted = weight != 0
        for batch in slices(batches):
            sums = []
            for text in batch.to_pylist():
                ids, values = counted(text, wanted)
                sums.append(b + float(values @ weight[ids].astype(float)))
            yield pa.array(np.round(1 / (1 + np.exp(-np.clip(sums, -500, 500))), 9))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn(name, F.arrow_udf(run, "double").asNondeterministic()("text"))
