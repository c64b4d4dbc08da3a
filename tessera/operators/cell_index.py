"""A trained vector index: vectors lie in cells around the means of a distributed k-means, and a search reads only the cells that can hold an
answer. Answers are exact.

A cell's vectors are written as one partition of a Parquet table, ordered by their distance to the cell's mean (``radius``). For a query at
distance d from a mean, no vector of radius r is nearer than \\|d - r\\|: once k vectors are known, cells (by their least and greatest
radius) and stretches of a cell whose bound lies beyond the k-th best are never compared. How much that saves depends on the data: clustered vectors
gain most of the work, directions without structure in many dimensions gain none.

Few queries are broadcast and the partitions of their cells are read. Many queries (``nearest_join``) are sent to the blocks of neighbouring cells that
they need, once a block; both sides of a block are dealt into parts of bounded size, so a cell may hold any share of the rows or of the queries. In
a part, products in single precision with a bound on their error leave few pairs, whose distances are exact.

Metrics are ``l2`` (squared) and ``cosine`` (by unit vectors). A vector that is null, has a null or NaN entry, is zero under cosine, or has another
length than the training rows' most frequent one is never found; neither has such a query an answer. Ties go to the smaller label. Tables
may be empty; an index of none finds nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.process_cache import kept
from tessera.functions.text import let
from tessera.operators.vector_index import DEFAULT_K, DIGITS, QUERY_BLOCK
from tessera.plans.staging import recorded, remove, scratch, staged

#: The most cells: their means are broadcast, and one row a cell passes through the driver.
MOST_CELLS = 4_096
ROUNDS = 6
#: The most rows and queries that a task compares, and the most bytes of its rows' vectors (half as many of its queries'); smaller tables are
#: dealt into SPREAD times SPREAD tasks, of no fewer rows than LEAST.
PART_ROWS, PART_QUERIES, PART_BYTES, SPREAD, LEAST = 196_608, 98_304, 48 << 20, 8, 1_024
#: Queries whose stretch of radii is read together; rows that they meet first, and then at a time.
SLICE, PILOT, STEP = 256, 512, 4_096
#: Slack of the bounds, far above what is lost in rounding.
SLACK = 1e-6
#: Distances that differ by less may tie when they are rounded.
ROUNDED = 10.0**-DIGITS
FOUND = "query_id long, vec_id long, distance double, compared long"


def usable(vector, metric: str):
    """A column of vectors as doubles, null where it has no distance; unit vectors under cosine."""
    v = F.transform(vector, lambda x: x.cast("double"))
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    if metric == "cosine":
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
        return F.when(ok, let(norm, lambda n: F.when(n > 0, F.transform(v, lambda x: x / n))))
    return F.when(ok, v)


def matrix(column, size: int):
    """Of an Arrow list column: which rows have vectors of a length, and these."""
    import numpy as np

    sizes = np.array(pa.compute.list_value_length(column).fill_null(-1))
    own = np.flatnonzero(sizes == size)
    part = column.take(pa.array(own)) if len(own) < len(sizes) else column
    part = part.combine_chunks() if isinstance(part, pa.ChunkedArray) else part
    return own, part.flatten().to_numpy(zero_copy_only=False).reshape(len(own), size) if len(own) else np.empty((0, size))


def gaps(x, means):
    """Distances of every row of x to every mean."""
    import numpy as np

    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (means * means).sum(1) - 2 * (x @ means.T), 0))


def steady_gaps(x, means):
    """gaps() to the last bit, whatever rows are computed together: both passes must agree on a query's nearest cells."""
    import numpy as np

    out = np.empty((len(x), len(means)))
    size = np.zeros(len(means))
    for j in range(x.shape[1]):
        size += means[:, j] * means[:, j]
    for i in range(0, len(x), 1024):
        part = x[i : i + 1024]
        own, met = np.zeros((len(part), 1)), np.zeros((len(part), len(means)))
        for j in range(x.shape[1]):
            column = part[:, j : j + 1]
            own += column * column
            met += column * means[:, j]
        out[i : i + 1024] = np.sqrt(np.maximum(own + size - 2 * met, 0))
    return out


def nearest_cells(gap, sizes, k: int):
    """Of distances to all cells: for every query the nearest cells that hold k rows."""
    import numpy as np

    order = np.argsort(gap, 1, kind="stable")
    held = sizes[order]
    near = np.zeros(gap.shape, bool)
    np.put_along_axis(near, order, np.cumsum(held, 1) - held < k, 1)
    return near


def best_of(i, ids, d, k: int):
    """The k best of every query i: (i, ids, d) by query, distance and id."""
    import numpy as np

    order = np.lexsort((ids, d, i))
    i = i[order]
    kept_ = np.arange(len(i)) - np.searchsorted(i, i, "left") < k
    return i[kept_], ids[order][kept_], d[order][kept_]


def stretches(low: int, high: int, middle: int) -> list[tuple[int, int]]:
    """[low, high) in pieces: a few rows around the middle first, then the others."""
    a = max(low, min(middle - PILOT // 2, high - PILOT))
    b = min(high, a + PILOT)
    return [(a, b), *((x, min(x + STEP, high)) for x in range(b, high, STEP)), *((x, min(x + STEP, a)) for x in range(low, a, STEP))]


def nearest(q, away, limit, x, radius, ids, k: int, squared: float):
    """Of queries q at distance ``away`` from a cell's mean, each with a limit: the k best of the cell's rows, which are ordered by
    radius, that may lie within the limit. Gives (query, id, distance) and how many rows each query met.

    Queries of like limits and places go together. A pair is compared exactly if its product in single precision, of vectors that are
    moved and scaled to norms of 1 at most, does not put it beyond the limit by more than the error; limits shrink as rows are met."""
    import numpy as np

    met = np.zeros(len(q), np.int64)
    none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    if not len(q) or not len(x):
        return list(none), met
    centre = x.mean(0)
    qc, xc = q - centre, x - centre
    scale = max(np.sqrt((qc * qc).sum(1).max()), np.sqrt((xc * xc).sum(1).max()), 1e-300)
    qc, xc = qc / scale, xc / scale
    size, q32 = (qc * qc).sum(1), np.column_stack([qc, np.ones(len(q))]).astype(np.float32)
    x32 = np.column_stack([xc, (xc * xc).sum(1) / -2]).astype(np.float32)
    error, most = (q.shape[1] + 4) * 2.5e-7, max(1, 4_000_000 // q.shape[1])
    qq, xx = (q * q).sum(1), (x * x).sum(1)
    with np.errstate(divide="ignore"):
        order = np.lexsort((away, np.floor(2 * np.log2(limit))))
    out = [none]
    for at in range(0, len(q), SLICE):
        own = order[at : at + SLICE]
        reach = limit[own].astype(float)
        low, high = np.searchsorted(radius, (away[own] - reach - SLACK).min(), "left"), np.searchsorted(radius, (away[own] + reach + SLACK).max(), "right")
        met[own] = high - low
        held = none
        for a, b in stretches(low, high, int(np.searchsorted(radius, away[own].mean()))) if high > low else []:
            hit = q32[own] @ x32[a:b].T >= ((size[own] - (reach / scale) ** 2) / 2 - error).astype(np.float32)[:, None]
            if np.count_nonzero(hit) <= min(most, hit.size // 8):
                i, j = np.divmod(np.flatnonzero(hit), b - a)
                d = np.round(np.maximum(qq[own[i]] + xx[a + j] - 2 * np.einsum("ij,ij->i", q[own[i]], x[a + j]), 0) * squared, DIGITS)
            else:
                d = np.round(np.maximum(qq[own][:, None] + xx[a:b] - 2 * (q[own] @ x[a:b].T), 0) * squared, DIGITS)
                i, j = (d <= np.partition(d, k - 1, 1)[:, k - 1 : k]).nonzero() if b - a > k else np.ones(d.shape, bool).nonzero()
                d = d[i, j]
            if len(i):
                held = best_of(*(np.concatenate(c) for c in zip(held, (i, ids[a + j], d))), k)
                full = np.flatnonzero(np.diff(held[0], append=len(own)) > 0)  # the last found of every query
                full = full[np.bincount(held[0], minlength=len(own))[held[0][full]] == k]
                reach[held[0][full]] = np.minimum(reach[held[0][full]], np.sqrt((held[2][full] + ROUNDED) / squared) + SLACK)
        out.append((own[held[0]], held[1], held[2]))
    return [np.concatenate(c) for c in zip(*out)], met


class CellIndex:
    """Vectors ``embedding`` with labels ``vec_id`` in trained cells. ``train`` finds the means, ``build`` writes the cells."""

    def __init__(self, rows: DataFrame, cells: int, metric: str = "l2", vec_id: str = "vec_id", embedding: str = "embedding"):
        if metric not in ("l2", "cosine"):
            raise ValueError(f"no cells under metric {metric}")
        if not 1 <= cells <= MOST_CELLS:
            raise ValueError(f"between 1 and {MOST_CELLS} cells")
        self.rows, self.cells, self.metric, self.vec_id, self.embedding = rows, cells, metric, vec_id, embedding
        self.squared = 0.5 if metric == "cosine" else 1.0
        self.means = self.lists = self.stats = None
        #: Of the last search: cells read by queries, and all cells times queries.
        self.read, self.of = 0, 0

    @property
    def is_trained(self) -> bool:
        return self.means is not None

    def _vectors(self, rows: DataFrame) -> DataFrame:
        return rows.select(F.col(self.vec_id).cast("long").alias("vec_id"), usable(F.col(self.embedding), self.metric).alias("v")).where("vec_id is not null and v is not null")

    def train(self, rows: DataFrame | None = None, rounds: int = ROUNDS) -> CellIndex:
        """K-means over ``rows`` (all of the index's own, if none are given), from the rows of the least hashes."""
        with recorded() as made:
            self._train(rows, rounds)
        remove(self.rows.sparkSession, made)
        return self

    def _train(self, rows: DataFrame | None, rounds: int) -> None:
        import numpy as np

        vectors = staged(self._vectors(self.rows if rows is None else rows), "training")  # read once a round
        common = vectors.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).where("d > 0").orderBy(F.desc("n"), "d").first()
        if common is None:
            self.means = np.empty((0, 1))
            return
        d = common.d
        vectors = vectors.where(F.size("v") == d)
        means = np.array([r.v for r in vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(self.cells).collect()])
        for _ in range(rounds):
            shared = vectors.sparkSession.sparkContext.broadcast(means)

            def sums(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                means = shared.value
                total, n = np.zeros_like(means), np.zeros(len(means), np.int64)
                for batch in batches:
                    for i in range(0, batch.num_rows, 4096):
                        _, x = matrix(batch.column(0).slice(i, 4096), d)
                        cell = gaps(x, means).argmin(1)
                        n += np.bincount(cell, minlength=len(means))
                        for j in range(d):
                            total[:, j] += np.bincount(cell, x[:, j], len(means))
                sums = np.column_stack([n, total]).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.size)), pa.array(sums)], ["at", "s"])

            moved = np.zeros((len(means), d + 1)).ravel()
            for r in vectors.select("v").mapInArrow(sums, "at long, s double").groupBy("at").agg(F.sum("s").alias("s")).collect():  # numbers of the means
                moved[r.at] = r.s
            moved = moved.reshape(len(means), d + 1)
            moved = np.where(moved[:, :1] > 0, moved[:, 1:] / np.maximum(moved[:, :1], 1), means)
            shared.unpersist()
            done = np.abs(moved - means).max() < SLACK
            means = moved
            if done:
                break
        self.means = means

    def placed(self, rows: DataFrame, column: str) -> DataFrame:
        """``rows`` with ``cell`` and ``radius`` of a column of usable vectors; null for other lengths."""
        shared, name = rows.sparkSession.sparkContext.broadcast(self.means), uuid.uuid4().hex

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            import numpy as np

            means = kept("means", name, lambda: shared.value)
            for batch in batches:
                cells, radii = np.full(len(batch), -1), np.full(len(batch), np.nan)
                for i in range(0, len(batch), 4096):
                    own, x = matrix(batch.slice(i, 4096), means.shape[1])
                    if len(own) and len(means):
                        gap = gaps(x, means)
                        cells[own + i] = gap.argmin(1)
                        radii[own + i] = gap.min(1)
                yield pa.StructArray.from_arrays([pa.array(cells.astype(np.int32), mask=cells < 0), pa.array(radii, mask=cells < 0)], ["cell", "radius"])

        run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        at = F.arrow_udf(run, "cell int, radius double").asNondeterministic()(F.col(column))
        return rows.withColumn("at", at).select(*rows.columns, "at.cell", "at.radius")

    def build(self) -> CellIndex:
        """Write every vector to its cell. Large cells are several files: rows are dealt by size, not by cell alone."""
        if not self.is_trained:
            raise ValueError("an index is trained before vectors are added")
        spark, path = self.rows.sparkSession, scratch(self.rows.sparkSession, "cells")
        rows = self.placed(self._vectors(self.rows), "v").where("cell is not null")
        rows.hint("rebalance", "cell").sortWithinPartitions("cell", "radius").write.partitionBy("cell").parquet(path)
        self.lists = spark.read.schema("vec_id long, v array<double>, radius double, cell int").parquet(path)
        self.stats = {r.cell: (r.n, r.low, r.high) for r in self.lists.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("radius").alias("low"), F.max("radius").alias("high")).collect()}  # a row a cell
        return self

    def bounds(self):
        """Cells with rows, their means, sizes, least and greatest radius."""
        import numpy as np

        cells = np.array(sorted(self.stats), dtype=int)
        n, low, high = (np.array([self.stats[c][k] for c in cells]) for k in range(3))
        return cells, self.means[cells], n, low, high

    def search_batch(self, queries: DataFrame, k: int = DEFAULT_K, query_id: str = "query_id", vector: str = "embedding") -> DataFrame:
        """Rows (query_id, rank, vec_id, distance), as a flat index finds them. Queries are broadcast in blocks of bounded size."""
        import numpy as np

        if self.lists is None:
            raise ValueError("build() comes before a search")
        asked = queries.select(F.col(query_id).cast("long").alias("query_id"), usable(F.col(vector), self.metric).alias("v")).where("v is not null")
        spark, found, (cells, means, sizes, low, high) = queries.sparkSession, None, self.bounds()
        self.read = self.of = 0
        blocks = -(-asked.count() // QUERY_BLOCK)
        for b in range(blocks if len(cells) else 0):
            own = [(r.query_id, r.v) for r in (asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)).collect() if len(r.v) == means.shape[1]]
            if not own:
                continue
            ids, q = [i for i, _ in own], np.array([v for _, v in own])
            gap = gaps(q, means)
            first = nearest_cells(gap, sizes, k)
            begun = staged(self._scan(ids, q, gap, first, np.full(len(q), np.inf), k), "begun")
            limit = np.full(len(q), np.inf)
            kth = Window.partitionBy("query").orderBy("distance", "vec_id")
            for r in begun.withColumn("rank", F.row_number().over(kth)).where(F.col("rank") == k).collect():  # a row a query of the block
                limit[r.query] = np.sqrt((r.distance + ROUNDED) / self.squared) + SLACK
            rest = ~first & (np.maximum(np.maximum(gap - high, low - gap), 0) <= limit[:, None])
            self.read, self.of = self.read + int(first.sum() + rest.sum()), self.of + first.size
            part = begun.unionByName(self._scan(ids, q, gap, rest, limit, k)).drop("query")
            found = part if found is None else found.unionByName(part)
        if found is None:
            return spark.createDataFrame([], "query_id long, rank int, vec_id long, distance double")
        order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")

    def _scan(self, ids, q, gap, wanted, limit, k: int) -> DataFrame:
        """Rows (query, query_id, vec_id, distance) from the partitions of the wanted cells."""
        spark, cells, squared = self.rows.sparkSession, self.bounds()[0], self.squared
        some = [int(cells[c]) for c in wanted.any(0).nonzero()[0]]
        if not some:
            return spark.createDataFrame([], "query int, query_id long, vec_id long, distance double")
        shared, column = spark.sparkContext.broadcast((ids, q, gap, wanted, limit)), {int(c): i for i, c in enumerate(cells)}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import numpy as np

            ids, q, gap, wanted, limit = shared.value
            for batch in batches:
                labels, x, radius, cell = batch.column(0).to_numpy(), matrix(batch.column(1), q.shape[1])[1], batch.column(2).to_numpy(), batch.column(3).to_numpy()
                for c in np.unique(cell):
                    rows, asking = np.flatnonzero(cell == c), np.flatnonzero(wanted[:, column[int(c)]])
                    rows = rows[np.argsort(radius[rows], kind="stable")]
                    (i, found, d), _ = nearest(q[asking], gap[asking, column[int(c)]], limit[asking], x[rows], radius[rows], labels[rows], k, squared)
                    i = asking[i]
                    yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(np.array(ids, dtype=np.int64)[i]), pa.array(found), pa.array(d)], ["query", "query_id", "vec_id", "distance"])

        lists = self.lists.where(F.col("cell").isin(some)).select("vec_id", "v", "radius", "cell")
        return lists.mapInArrow(run, "query int, query_id long, vec_id long, distance double")

    def nearest_join(self, queries: DataFrame, k: int = DEFAULT_K, query_id: str = "query_id", vector: str = "embedding", counts: bool = False) -> DataFrame:
        """search_batch() for any number of queries, none of which passes through the driver: every query first meets the nearest cells
        that hold k rows, then those that its k-th best leaves open. ``counts`` adds ``compared``, a query's compared rows."""
        if self.lists is None:
            raise ValueError("build() comes before a search")
        spark = queries.sparkSession
        asked = queries.select(F.col(query_id).cast("long").alias("query_id"), usable(F.col(vector), self.metric).alias("v")).where("query_id is not null and v is not null")
        out = spark.createDataFrame([], FOUND)
        if self.stats:
            with recorded() as made:
                begun = staged(self._block_join(self._sent(asked.withColumn("limit", F.lit(None).cast("double")), k, True), k, True), "begun")
            kth = Window.partitionBy("query_id").orderBy("distance", "vec_id")
            limits = begun.where("vec_id is not null").withColumn("rank", F.row_number().over(kth)).where(F.col("rank") == k).select("query_id", (F.sqrt((F.col("distance") + ROUNDED) / self.squared) + SLACK).alias("limit"))
            left = asked.join(limits, "query_id", "left").select("query_id", "v", F.coalesce("limit", F.lit(float("inf"))).alias("limit"))
            out = begun.unionByName(self._block_join(self._sent(left, k, False), k, False))
            remove(spark, made[:-1])
        order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
        best = out.where("vec_id is not null").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")
        if counts:
            met = out.groupBy("query_id").agg(F.sum("compared").alias("compared"))
            best = best.join(met, "query_id")
        return best

    def _blocks(self) -> tuple[list[int], list[int]]:
        """Of every cell in bounds(): its block, and the parts of its rows. Cells follow each other to the nearest one not yet taken; a block holds a
        bounded number of rows, or one large cell in parts."""
        import numpy as np

        cells, means, sizes, _, _ = self.bounds()
        most = max(1, min(PART_ROWS, PART_BYTES // (8 * means.shape[1]), max(LEAST, int(sizes.sum()) // SPREAD)))
        block, parts, number, used, free, now = [0] * len(cells), [1] * len(cells), 0, 0, np.ones(len(cells), bool), 0
        for _ in cells:
            free[now] = False
            if used and used + sizes[now] > most:
                number, used = number + 1, 0
            block[now], parts[now], used = number, int(-(-sizes[now] // most)), used + sizes[now]
            now = int(np.where(free, ((means - means[now]) ** 2).sum(1), np.inf).argmin())
        return block, parts

    def _sent(self, asked: DataFrame, k: int, first: bool) -> DataFrame:
        """Rows (query_id, v, limit, block): each query with the blocks that hold cells which it needs."""
        block = self._blocks()[0]
        shared = asked.sparkSession.sparkContext.broadcast((self.bounds(), block))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import numpy as np

            bounds, block = shared.value
            order = np.argsort(block, kind="stable")
            starts = np.flatnonzero(np.diff(np.array(block)[order], prepend=-1))
            for whole in batches:
                for at in range(0, whole.num_rows, 1024):
                    batch = whole.slice(at, 1024)
                    own, q = matrix(batch.column(1), bounds[1].shape[1])
                    limit = batch.column(2).to_numpy(zero_copy_only=False).astype(float)[own]
                    wanted, _ = needed(q, limit, bounds, k, first)
                    i, b = np.nonzero(np.logical_or.reduceat(wanted[:, order], starts, 1))
                    rows = batch.take(pa.array(own[i]))
                    yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(np.full(len(i), np.inf) if first else limit[i]), pa.array(b.astype(np.int32))], ["query_id", "v", "limit", "block"])

        return staged(asked.select("query_id", "v", "limit").mapInArrow(run, "query_id long, v array<double>, limit double, block int"), "sent")

    def _block_join(self, sent: DataFrame, k: int, first: bool) -> DataFrame:
        """The k best rows of every query in each part of its blocks, and one row (without vec_id) that counts what it met there."""
        spark, squared, bounds = sent.sparkSession, self.squared, self.bounds()
        waiting = {r.block: r.n for r in sent.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a block
        most = max(1, min(PART_QUERIES, PART_BYTES // (16 * bounds[1].shape[1]), max(LEAST, max(waiting.values(), default=0) // SPREAD)))
        placed = [(int(c), b, p, -(-waiting[b] // most)) for c, b, p in zip(bounds[0], *self._blocks()) if b in waiting]
        cells = F.broadcast(spark.createDataFrame(placed, "p_cell int, block int, parts int, waits int"))  # a row a cell
        blocks = F.broadcast(spark.createDataFrame(sorted({p[1:] for p in placed}), "p_block int, parts int, waits int"))
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        rows = self.lists.where(F.col("cell").isin([p[0] for p in placed])).join(cells, F.col("cell") == F.col("p_cell"))
        rows = rows.select("block", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"), each("waits").alias("wait"), "vec_id", "v", "radius", "cell")
        q = sent.join(blocks, F.col("block") == F.col("p_block")).select("block", each("parts").alias("part"), F.pmod(F.xxhash64("query_id"), F.col("waits")).cast("int").alias("wait"), "query_id", "v", "limit")
        shared = spark.sparkContext.broadcast(bounds)

        def compare(asking: pa.Table, held: pa.Table) -> pa.Table:
            import numpy as np

            schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("distance", pa.float64()), ("compared", pa.int64())])
            if not asking.num_rows or not held.num_rows:
                return schema.empty_table()
            bounds = shared.value
            size = bounds[1].shape[1]
            radius, cell, ids = (held.column(c).to_numpy() for c in ("radius", "cell", "vec_id"))
            order = np.lexsort((radius, cell))
            radius, cell, ids, x = radius[order], cell[order], ids[order], matrix(held.column("v").combine_chunks(), size)[1][order]
            names, reach, v = asking.column("query_id").to_numpy(), asking.column("limit").to_numpy(), matrix(asking.column("v").combine_chunks(), size)[1]
            out, met = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))], np.zeros(len(names), np.int64)
            step = max(1, 2_000_000 // len(bounds[0]))
            for a in range(0, len(names), step):
                wanted, gap = needed(v[a : a + step], reach[a : a + step], bounds, k, first)
                found = []
                for c in np.unique(cell):
                    column, (low, high) = int(np.searchsorted(bounds[0], c)), np.searchsorted(cell, [c, c + 1])
                    own = np.flatnonzero(wanted[:, column])
                    (i, label, d), n = nearest(v[a + own], gap[own, column], reach[a + own], x[low:high], radius[low:high], ids[low:high], k, squared)
                    found.append((a + own[i], label, d))
                    met[a + own] += n
                out.append(best_of(*(np.concatenate(f) for f in zip(*found)), k))
            i, found, d = (np.concatenate(f) for f in zip(*out))
            none = len(names)
            return pa.table([pa.array(np.concatenate([names[i], names])), pa.concat_arrays([pa.array(found, pa.int64()), pa.nulls(none, pa.int64())]), pa.concat_arrays([pa.array(d, pa.float64()), pa.nulls(none, pa.float64())]), pa.array(np.concatenate([np.zeros(len(i), np.int64), met]))], schema)

        compare.__annotations__ = {"asking": pa.Table, "held": pa.Table, "return": pa.Table}
        by = "block", "part", "wait"
        return q.groupBy(*by).cogroup(rows.groupBy(*by)).applyInArrow(compare, FOUND)


def needed(q, limit, bounds, k: int, first: bool):
    """Which cells each query meets, in the first pass or after it, and its distances to their means."""
    import numpy as np

    _, means, sizes, low, high = bounds
    gap = steady_gaps(q, means)
    near = nearest_cells(gap, sizes, k)
    return (near if first else ~near & (np.maximum(np.maximum(gap - high, low - gap), 0) <= limit[:, None])), gap
