"""Hard negatives by exact search in rotated vectors with early discards.

Components are scaled and floored to integers; a score is an integer inner product. All vectors are turned into the principal axes of
the whole table (an orthogonal rotation, so products stay), leading axes first. A task compares a slice of its rows with a slice of the
anchors: products of the leading components are summed range by range, and what is left is bounded by the product of the residual norms
plus a slack for rounding. A pair whose bound lies under what its anchor still needs is dropped there and then; pairs that are
left to the end are verified by integer products. Each task keeps the best few of each anchor, which alone are shuffled.

First the positives: the best rows of the anchor's label. Their scores give the windows in which negatives are looked for, by a second
reading. Anchors come in blocks of bounded size; each block costs these two readings.

Rows with a null id, a null label, a null vector, or a null or non-finite component take no part, nor do those with a component whose
square times the length passes 64 bits, since such products are no longs. Vectors meet vectors of their own length only. A row is
known by its id: "other" rows have another id, and repeated rows of one id, label and score count once; an id with several vectors has
the results of each. Ties go to the smaller id. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.process_cache import kept, only

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: A negative's score lies between these hundredths of the positive's.
LEAST_SHARE, MOST_SHARE = 50, 95
#: Anchors that are broadcast at once; anchors and rows that a task compares at once.
ANCHOR_BLOCK, ANCHOR_SLICE, ROW_SLICE = 4_096, 1_024, 2_048
#: Shares of the components after which pairs are tested; below this share of pairs they go on one by one.
CUTS, SPARSE = (0.25, 0.5, 0.75, 0.875, 1.0), 0.05
#: Relative slack for rounding in double precision, far above what sums of this length lose.
SLACK = 1e-9
LOWEST, HIGHEST = -(2**63), 2**63 - 1
#: The longest vectors that are rotated; longer ones keep their own axes.
MOST_AXES = 1_024
FOUND = "anchor int, slot int, score long, id long"


def usable(rows: DataFrame, label: Column, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Rows (id, label, v) that take part."""
    v = F.transform(embedding, lambda x: x.cast("double"))
    rows = rows.select(F.col(vec_id).cast("long").alias("id"), label.cast("long").alias("label"), v.alias("v")).where("id is not null and label is not null and v is not null")
    most = F.floor(F.sqrt(F.lit(float(2**62)) / F.greatest(F.size("v"), F.lit(1))))
    return rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * SCALE < most)))


def stacked(column) -> Iterator:
    """Of an Arrow list column without nulls: for each length, which rows have it and their matrix."""
    import numpy as np

    sizes = np.diff(column.offsets.to_numpy())
    flat = column.values.to_numpy()[column.offsets[0].as_py() :]
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    for size in np.unique(sizes):
        own = np.flatnonzero(sizes == size)
        yield int(size), own, flat[starts[own][:, None] + np.arange(size)]


def integers(matrix):
    import numpy as np

    return np.floor(SCALE * matrix).astype(np.int64)


def axes(rows: DataFrame) -> tuple[int, object] | None:
    """The most frequent length and the principal axes of its vectors, over all rows: (length, matrix). Tasks sum products of components;
    the driver gets one number a pair of components."""
    import numpy as np

    common = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).where(F.col("d").between(1, MOST_AXES)).orderBy(F.desc("n"), "d").first()
    if common is None:
        return None
    d = common.d

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            for _, _, matrix in stacked(batch.column(0)):
                x = np.floor(SCALE * matrix)
                total += x.T @ x
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d * d, dtype=np.int32)), pa.array(total.ravel())], ["cell", "s"])

    cells = rows.where(F.size("v") == d).select("v").mapInArrow(run, "cell int, s double").groupBy("cell").agg(F.sum("s").alias("s")).collect()
    moment = np.zeros(d * d)
    for r in cells:
        moment[r.cell] = r.s
    moment = moment.reshape(d, d)
    turned = np.linalg.eigh((moment + moment.T) / 2)[1][:, ::-1]
    return d, np.ascontiguousarray(turned)


class Rotated:
    """Integer vectors, the same in leading axes first, and the norms of what follows each cut."""

    def __init__(self, whole, turn):
        import numpy as np

        self.whole = whole
        self.turned = whole.astype(float) @ turn if turn is not None else whole.astype(float)
        d = whole.shape[1]
        self.cuts = sorted({max(1, math.ceil(d * c)) for c in CUTS}) if d else [0]
        squares = np.cumsum((self.turned**2)[:, ::-1], axis=1)[:, ::-1]
        self.tails = np.sqrt(np.stack([squares[:, c] if c < d else np.zeros(len(whole)) for c in self.cuts], 1))
        self.norms = np.sqrt((self.turned**2).sum(1))

    def at(self, rows) -> Rotated:
        out = object.__new__(Rotated)
        out.whole, out.turned, out.cuts, out.tails, out.norms = self.whole[rows], self.turned[rows], self.cuts, self.tails[rows], self.norms[rows]
        return out


def survivors(q: Rotated, x: Rotated, low, high=None):
    """Pairs (i, j) whose product may lie between low[i] and high[i]; all that do are among them."""
    import numpy as np

    columns, part, at = np.arange(len(x.whole)), np.zeros((len(q.whole), len(x.whole))), 0
    pairs = None
    for k, stop in enumerate(q.cuts):
        if pairs is None:
            part += q.turned[:, at:stop] @ x.turned[columns, at:stop].T
            reach = np.outer(q.tails[:, k], x.tails[columns, k]) + SLACK * np.outer(q.norms, x.norms[columns]) + SLACK
            alive = part + reach >= low[:, None]
            if high is not None:
                alive &= part - reach <= high[:, None]
            if alive.sum() < SPARSE * alive.size or stop == q.cuts[-1]:
                i, j = np.nonzero(alive)
                part, pairs = part[i, j], (i, columns[j])
            else:
                some = alive.any(0)
                if some.mean() < 0.7:
                    columns, part = columns[some], part[:, some]
        else:
            i, j = pairs
            part = part + np.einsum("ij,ij->i", q.turned[i, at:stop], x.turned[j, at:stop])
            reach = q.tails[i, k] * x.tails[j, k] + SLACK * q.norms[i] * x.norms[j] + SLACK
            alive = part + reach >= low[i]
            if high is not None:
                alive &= part - reach <= high[i]
            part, pairs = part[alive], (i[alive], j[alive])
        at = stop
    return pairs


def verified(q, x, i, j):
    """Integer products of the pairs."""
    import numpy as np

    return np.concatenate([np.empty(0, np.int64), *(np.einsum("ij,ij->i", q[i[k : k + 100_000]], x[j[k : k + 100_000]]) for k in range(0, len(i), 100_000))])


class Best:
    """The best ``top`` (score, id) of each of n keys."""

    def __init__(self, n: int, top: int):
        import numpy as np

        self.n, self.top = n, top
        self.key, self.score, self.id = (np.empty(0, np.int64) for _ in range(3))
        self.worst = np.full(n, LOWEST)

    def add(self, key, score, ids) -> None:
        import numpy as np

        key, score, ids = np.append(self.key, key), np.append(self.score, score), np.append(self.id, ids)
        order = np.lexsort((ids, -score, key))
        key, score, ids = key[order], score[order], ids[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (score[1:] != score[:-1]) | (ids[1:] != ids[:-1])
        key, score, ids = key[new], score[new], ids[new]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        place = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
        keep = place < self.top
        self.key, self.score, self.id = key[keep], score[keep], ids[keep]
        last = place[keep] == self.top - 1
        self.worst[self.key[last]] = self.score[last]


class Anchors:
    """A block of anchors of one length: where they stand in the block, ids, labels, vectors, and the windows of their negatives."""

    def __init__(self, place, ids, labels, whole, turn):
        self.place, self.ids, self.labels, self.turn, self.vectors = place, ids, labels, turn, Rotated(whole, turn)
        self.low = self.high = None  # a column for each window

    def positives(self, rows, best: Best, labels, ids) -> None:
        """Rows of the anchors' labels, label by label."""
        import numpy as np

        for label in np.intersect1d(labels, self.labels):
            mine, theirs = np.flatnonzero(self.labels == label), np.flatnonzero(labels == label)
            x = rows.at(theirs)
            for a in range(0, len(mine), ANCHOR_SLICE):
                own = mine[a : a + ANCHOR_SLICE]
                q = self.vectors.at(own)
                i, j = survivors(q, x, best.worst[own])
                other = self.ids[own][i] != ids[theirs][j]
                i, j = i[other], j[other]
                best.add(own[i], verified(q.whole, x.whole, i, j), ids[theirs][j])

    def negatives(self, rows, best: Best, labels, ids) -> None:
        """Rows of other labels, in the windows under the anchors' positives."""
        import numpy as np

        slots = self.low.shape[1]
        for a in range(0, len(self.ids), ANCHOR_SLICE):
            own = np.arange(a, min(a + ANCHOR_SLICE, len(self.ids)))
            own = own[(self.high[own] >= self.low[own]).any(1)]
            if not len(own):
                continue
            q, low = self.vectors.at(own), np.maximum(self.low, best.worst.reshape(-1, slots))[own]
            i, j = survivors(q, rows, low.min(1), self.high[own].max(1))
            other = self.labels[own][i] != labels[j]
            i, j = i[other], j[other]
            score = verified(q.whole, rows.whole, i, j)
            keys, kept_rows = [], []
            for s in range(slots):
                inside = np.flatnonzero((score >= low[i, s]) & (score <= self.high[own][i, s]))
                keys.append(own[i[inside]] * slots + s)
                kept_rows.append(inside)
            k = np.concatenate(kept_rows)
            best.add(np.concatenate(keys), score[k], ids[j[k]])


def searched(rows: DataFrame, shared, negatives: bool, top: int, slots: int) -> DataFrame:
    """Rows (anchor, slot, score, id): the best of every task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        only("anchors")
        name, block = shared.value
        anchors = kept("anchors", name, lambda: {d: built(*x) for d, x in block.items()})
        best = {d: Best(len(a.ids) * slots, top) for d, a in anchors.items()}
        for batch in batches:
            for at in range(0, batch.num_rows, ROW_SLICE):
                part = batch.slice(at, ROW_SLICE)
                ids, labels = part.column(0).to_numpy(), part.column(1).to_numpy()
                for d, own, matrix in stacked(part.column(2)):
                    if d in anchors:
                        a = anchors[d]
                        (a.negatives if negatives else a.positives)(Rotated(integers(matrix), a.turn), best[d], labels[own], ids[own])
        for d, found in best.items():
            anchor, slot = np.divmod(found.key, slots)
            yield pa.RecordBatch.from_arrays([pa.array(anchors[d].place[anchor].astype(np.int32)), pa.array(slot.astype(np.int32)), pa.array(found.score), pa.array(found.id)], ["anchor", "slot", "score", "id"])

    found = rows.select("id", "label", "v").mapInArrow(run, FOUND).distinct()
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def built(place, ids, labels, whole, turn, low=None, high=None) -> Anchors:
    out = Anchors(place, ids, labels, whole, turn)
    out.low, out.high = low, high
    return out


def mined(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST_SHARE, most: int = MOST_SHARE) -> DataFrame:
    """Of usable() rows: (anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    import uuid

    import numpy as np

    spark, out = rows.sparkSession, None
    asked = rows.where(is_anchor).distinct()
    n = asked.count()
    turned = axes(rows) if n else None
    for b in range(-(-n // ANCHOR_BLOCK)):
        own = asked if n <= ANCHOR_BLOCK else asked.where(F.pmod(F.xxhash64("id", "v"), F.lit(-(-n // ANCHOR_BLOCK))) == b)
        anchors = sorted((r.id, r.label, r.v) for r in own.collect())
        block = {}
        for d in {len(v) for _, _, v in anchors}:
            place = np.array([i for i, (_, _, v) in enumerate(anchors) if len(v) == d], dtype=np.int64)
            ids, labels = (np.array([anchors[i][c] for i in place], dtype=np.int64) for c in (0, 1))
            block[d] = place, ids, labels, integers(np.array([anchors[i][2] for i in place], dtype=float).reshape(len(place), d)), turned[1] if turned and turned[0] == d else None
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, block))
        best = [(r.anchor, r.id, r.score) for r in searched(rows, shared, False, positives, 1).collect()]  # a few rows an anchor of the block
        scores: dict[int, list] = {}
        for a, _, s in sorted(best):
            if s not in scores.setdefault(a, []):
                scores[a].append(s)
        windows = {}
        for d, (place, *rest) in block.items():
            low, high = np.full((len(place), positives), HIGHEST), np.full((len(place), positives), LOWEST)
            for k, i in enumerate(place):
                for slot, s in enumerate(scores.get(int(i), [])):
                    if -(-least * s // 100) <= most * s // 100:
                        low[k, slot], high[k, slot] = -(-least * s // 100), most * s // 100
            windows[d] = place, *rest, low, high
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, windows))
        pairs = spark.createDataFrame([(a, scores[a].index(s), anchors[a][0], i, s) for a, i, s in best], "p_anchor int, p_slot int, anchor_id long, positive_id long, positive_score long")
        found = searched(rows, shared, True, negatives, positives)
        part = found.join(F.broadcast(pairs), (F.col("anchor") == F.col("p_anchor")) & (F.col("slot") == F.col("p_slot")))  # at most ``positives`` rows an anchor of the block
        part = part.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return out
