"""A flat vector index: rows of a DataFrame, exact search, labels that are dense from 0.

Search never gathers the index. One query is a projection and a bounded top-k. Many queries are sent to the index in blocks of
bounded size; every task keeps k rows a query, and only those are shuffled to be ranked. A vector that is null, of another length than
the query's, or without a distance (a null or NaN entry, a zero vector under cosine) is never found.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.vectors import METRICS
from tessera.plans.ranking import running

DEFAULT_K = 4
#: Fixed value: retrieved rows must be nearer than this (squared L2).
MAX_DISTANCE = 0.6
#: Queries that are broadcast at once, and those that a worker compares at once: the first bounds the readings of the index, the
#: second a worker's memory.
QUERY_BLOCK, QUERY_SLICE = 20_000, 2_000
#: Distances are rounded to so many digits, so that equal vectors tie whatever order their terms were summed in.
DIGITS = 9
#: Sums of entries up to which a difference of entropies keeps those digits.
SHARES = 16.0


class FlatIndex:
    """Vectors ``embedding`` with labels ``vec_id``; other columns are the stored documents."""

    def __init__(self, rows: DataFrame, metric: str = "l2", p: float = 3.0, vec_id: str = "vec_id", embedding: str = "embedding"):
        if metric not in METRICS:
            raise ValueError(f"unknown metric {metric}")
        self.rows, self.metric, self.p, self.vec_id, self.embedding = rows, metric, p, vec_id, embedding
        self.measure, self.descending = METRICS[metric]

    #: A flat index needs no training.
    is_trained = True

    def train(self, _rows: DataFrame | None = None) -> FlatIndex:
        return self

    def _with(self, rows: DataFrame) -> FlatIndex:
        return FlatIndex(rows, self.metric, self.p, self.vec_id, self.embedding)

    def distance(self, query: Column) -> Column:
        args = (self.p,) if self.metric == "lp" else ()
        return F.round(self.measure(F.col(self.embedding), query, *args), DIGITS)

    def search(self, query: list[float], k: int = DEFAULT_K, keep: Column | None = None) -> DataFrame:
        """The k nearest rows with ``distance`` and ``rank``, ties by label. ``keep`` filters what was found: fewer than k may stay.
        Ranks are those before that filter."""
        vector = F.lit([float(x) for x in query]).cast("array<double>") if query else F.array().cast("array<double>")
        found = self.rows.where((F.size(self.embedding) == len(query)) & F.forall(self.embedding, lambda x: x.isNotNull())).withColumn("distance", self.distance(vector)).where("distance is not null and not isnan(distance)")
        order = (F.desc("distance") if self.descending else F.asc("distance")), F.asc(self.vec_id)
        best = found.orderBy(*order).limit(k)
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))  # k rows
        return best.where(keep) if keep is not None else best

    def search_batch(self, queries: DataFrame, k: int = DEFAULT_K, query_id: str = "query_id", vector: str = "embedding", pad: bool = False) -> DataFrame:
        """Rows (query_id, rank, vec_id, distance) for every query row. ``pad`` fills missing ranks with label -1."""
        spark, found = queries.sparkSession, None
        asked = queries.select(F.col(query_id).alias("query_id"), F.col(vector).alias("v"))
        blocks = -(-asked.count() // QUERY_BLOCK)
        for b in range(blocks):
            own = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
            part = self._block(spark.sparkContext.broadcast([(r.query_id, r.v) for r in own.collect()]), k)
            found = part if found is None else found.unionByName(part)
        if found is None:
            return asked.limit(0).select("query_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("vec_id"), F.lit(0.0).alias("distance"))
        order = (F.desc("distance") if self.descending else F.asc("distance")), F.asc("vec_id")
        out = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")
        if pad:
            slots = asked.select("query_id", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank"))
            out = slots.join(out, ["query_id", "rank"], "left").select("query_id", "rank", F.coalesce("vec_id", F.lit(-1)).alias("vec_id"), "distance")
        return out

    def _block(self, shared, k: int) -> DataFrame:
        metric, p, descending = self.metric, self.p, self.descending

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import numpy as np

            asked: dict[int, list] = {}
            for name, v in shared.value:
                if v:
                    asked.setdefault(len(v), []).append((name, [np.nan if x is None else x for x in v]))
            parts = [own[i : i + QUERY_SLICE] for own in asked.values() for i in range(0, len(own), QUERY_SLICE)]
            q = [np.array([v for _, v in own], dtype=float) for own in parts]
            best = [(np.empty((len(x), 0)), np.empty((len(x), 0), dtype=np.int64)) for x in q]
            for batch in batches:
                for i in range(0, batch.num_rows, 1024):
                    labels, vectors = (c.to_numpy(zero_copy_only=False) for c in batch.slice(i, 1024).columns)
                    sizes = np.fromiter(map(len, vectors), dtype=int, count=len(vectors))
                    rows = {n: np.flatnonzero(sizes == n) for n in set(sizes.tolist()) & asked.keys()}
                    stacked = {n: np.stack(vectors[own]).astype(float) for n, own in rows.items()}
                    for part, (x_q, (best_d, best_i)) in enumerate(zip(q, best)):
                        n = x_q.shape[1]
                        if n in rows:
                            d = np.concatenate([best_d, np.round(distances(x_q, stacked[n], metric, p), DIGITS)], 1)
                            ids = np.concatenate([best_i, np.broadcast_to(labels[rows[n]].astype(np.int64), (len(x_q), len(rows[n])))], 1)
                            best[part] = k_best(d, ids, k, descending)
            for own, found in zip(parts, best):
                for (name, _), d, ids in zip(own, *found):
                    d, ids = d[~np.isnan(d)], ids[~np.isnan(d)]
                    if len(d):
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(d), pa.int64()), pa.array(ids, pa.int64()), pa.array(d, pa.float64())], ["query_id", "vec_id", "distance"])

        rows = self.rows.select(F.col(self.vec_id).cast("long"), F.col(self.embedding)).where(F.col(self.embedding).isNotNull() & F.col(self.vec_id).isNotNull())
        return rows.mapInArrow(run, "query_id long, vec_id long, distance double")

    def ntotal(self) -> DataFrame:
        """One row: the number of vectors and their dimension."""
        return self.rows.agg(F.count(F.lit(1)).alias("ntotal"), F.coalesce(F.max(F.size(self.embedding)), F.lit(0)).cast("long").alias("dimension"))

    def merge(self, other: FlatIndex) -> FlatIndex:
        """The other's rows after this one's, with labels that go on from its number."""
        n = self.rows.count()
        return self._with(self.rows.unionByName(other.rows.withColumn(self.vec_id, (F.col(other.vec_id) + n).cast(self.rows.schema[self.vec_id].dataType))))

    def add(self, rows: DataFrame, order: str) -> FlatIndex:
        """Append rows with dense labels, in the order of a column."""
        n = self.rows.count()
        return self._with(self.rows.unionByName(labelled(rows, order, self.vec_id, n).select(*self.rows.columns)))

    def remove(self, ids: DataFrame) -> tuple[FlatIndex, DataFrame]:
        """Without the labels in ``ids`` and densely labelled anew; and one row with the number removed."""
        gone = ids.select(F.col(self.vec_id).alias("__ts_gone")).distinct()
        left = self.rows.join(gone, self.rows[self.vec_id] == gone["__ts_gone"], "left_anti")
        count = self.rows.join(gone, self.rows[self.vec_id] == gone["__ts_gone"], "left_semi").agg(F.count(F.lit(1)).alias("removed"))
        return self._with(labelled(left, self.vec_id, self.vec_id)), count


def distances(q, x, metric: str, p: float):
    """Of every row of q to every row of x, in numpy."""
    import numpy as np

    if metric == "inner_product":
        return q @ x.T
    if metric == "cosine":
        with np.errstate(invalid="ignore", divide="ignore"):
            return 1 - (q @ x.T) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1))
    if metric == "l2":
        return np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1) - 2 * (q @ x.T), 0)
    if metric == "jensen_shannon" and all((y >= 0).all() and y.sum(1).max(initial=0) <= SHARES for y in (q, x)):
        return divergences(q, x)
    out = np.empty((len(q), len(x)))
    for i, v in enumerate(q):
        a = np.abs(x - v)
        with np.errstate(invalid="ignore", divide="ignore"):
            if metric == "l1":
                out[i] = a.sum(1)
            elif metric == "linf":
                out[i] = a.max(1)
            elif metric == "lp":
                out[i] = (a**p).sum(1)
            elif metric == "canberra":
                out[i] = np.nan_to_num(a / (np.abs(x) + np.abs(v))).sum(1)
            elif metric == "bray_curtis":
                out[i] = a.sum(1) / np.abs(x + v).sum(1)
            elif metric == "jaccard":
                out[i] = np.minimum(x, v).sum(1) / np.maximum(x, v).sum(1)
            else:
                m = (x + v) / 2
                out[i] = 0.5 * (np.where(x > 0, x * np.log(x / m), 0) + np.where(v > 0, v * np.log(v / m), 0)).sum(1)
    return out


def k_best(d, ids, k: int, descending: bool):
    """The k best of each row with their ids, ties to the smaller id, NaN last: only what reaches the k-th distance is sorted."""
    import numpy as np

    key = -d if descending else d
    if d.shape[1] > k:
        i, j = np.divmod(np.flatnonzero(~(key > np.partition(key, k - 1, axis=1)[:, k - 1 : k])), d.shape[1])
        order = np.lexsort((ids[i, j], key[i, j], i))
        order = order[np.arange(len(i)) - np.searchsorted(i, i) < k].reshape(len(d), k)  # rows keep their places in i
        return d[i[order], j[order]], ids[i[order], j[order]]
    order = np.lexsort((ids, key), axis=1)
    return np.take_along_axis(d, order, 1), np.take_along_axis(ids, order, 1)


def divergences(q, x):
    """Jensen-Shannon of small vectors without negative entries, by one logarithm an entry of a pair: the sums of each side's own x ln(x) are known."""
    import numpy as np

    def own(y):
        return (y * np.log(np.where(y > 0, y, 1))).sum(1) + y.sum(1) * np.log(2)

    of_x, of_q, out = own(x), own(q), np.empty((len(q), len(x)))
    for i, v in enumerate(q):
        both = x + v
        out[i] = of_x + of_q[i] - (both * np.log(np.where(both > 0, both, 1) if (both == 0).any() else both)).sum(1)
    return np.maximum(out / 2, 0)


def labelled(rows: DataFrame, order: str, name: str, first: int = 0) -> DataFrame:
    """Dense labels from ``first`` on in the order of a column, without a window over all rows. Rows that are equal in it are labelled in any order."""
    out = running(rows.withColumn("__ts_key", F.col(order)), [], ["__ts_key"], F.lit(1).cast("long"), "__ts_label")
    kind = rows.schema[name].dataType if name in rows.columns else "long"
    return out.withColumn(name, (F.col("__ts_label") + first).cast(kind)).drop("__ts_key", "__ts_label")


def make_index(rows: DataFrame, descriptor: str = "Flat", metric: str = "l2", p: float = 3.0):
    """An index by its descriptor: ``Flat``, or ``IVF<n>,Flat`` for n trained cells (train() and build() come before a search)."""
    from tessera.operators.cell_index import CellIndex

    if descriptor == "Flat":
        return FlatIndex(rows, metric, p)
    cells = re.fullmatch(r"IVF([1-9][0-9]*),Flat", descriptor)
    if not cells:
        raise ValueError(f"unsupported index descriptor {descriptor}")
    return CellIndex(rows, int(cells[1]), metric)
