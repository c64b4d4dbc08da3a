"""Next-fit batches of a whole table: the same as one pass over all rows in order, whatever the partitions.

With running sums S, the batch that begins at row i ends before the first later row whose sum passes S of the row before i plus the limit. So every
row knows where the next batch would begin; which rows do begin one is the chain of these pointers from the first row. Rows lie in runs
of bounded size: inside a run the chain is followed in memory, from the few rows where it can enter; between runs, pointers are doubled until they
reach the end, so the number of rounds grows with the logarithm of the number of runs.

A row joins the open batch while the sum stays within the limit (equality fits), else it begins the next. Batches count from 0; a first row
above the limit begins batch 1 and leaves 0 empty, as in a fold over an array. Null counts are 0. Rows with equal order keys come in any order, but the same
in all steps. An empty table gives no rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.tokens import BATCH_LIMIT
from tessera.plans.ranking import running
from tessera.plans.staging import recorded, remove, staged

#: Rows of a run.
RUN = 8_192


def batched(rows: DataFrame, order: list[str], count: Column, limit: int = BATCH_LIMIT, name: str = "batch") -> DataFrame:
    """``rows`` with the number of each row's batch."""
    spark, columns = rows.sparkSession, [c for c in rows.columns if c != name]
    tokens = F.greatest(F.coalesce(count.cast("long"), F.lit(0)), F.lit(0))
    with recorded() as made:
        placed = running(rows.select(*columns, tokens.alias("__ts_n")), [], order, F.lit(1).cast("long"), "__ts_at")
        placed = staged(running(placed, [], ["__ts_at"], F.col("__ts_n"), "__ts_before", F.floor(F.col("__ts_at") / RUN)), "placed")
        pointers = staged(following(placed.select("__ts_at", "__ts_n", "__ts_before"), limit), "pointers")
        numbers = staged(numbered(pointers), "batches")
        out = placed.join(numbers, "__ts_at")
        out = staged(out.select(*columns, (F.col("__ts_batch") + first_is_long(pointers, limit)).cast("int").alias(name)), "batched")
    remove(spark, made[:-1])
    return out


def first_is_long(pointers: DataFrame, limit: int) -> int:
    return pointers.where((F.col("at") == 0) & (F.col("n") > limit)).count()


def following(rows: DataFrame, limit: int) -> DataFrame:
    """Rows (at, n, next): the row where the next batch begins, if one begins at ``at``. The number of rows whose sum does not pass a bound is
    a running count over sums and bounds in one order."""
    sums = rows.select((F.col("__ts_before") + F.col("__ts_n")).alias("x"), F.lit(0).alias("asks"), F.col("__ts_at").alias("at"), F.col("__ts_n").alias("n"))
    bounds = rows.select((F.col("__ts_before") + limit).alias("x"), F.lit(1).alias("asks"), F.col("__ts_at").alias("at"), F.col("__ts_n").alias("n"))
    counted = running(sums.unionByName(bounds), [], ["x", "asks", "at"], (1 - F.col("asks")).cast("long"), "next")
    return counted.where("asks = 1").select("at", "n", F.greatest("next", F.col("at") + 1).alias("next"))


def numbered(pointers: DataFrame) -> DataFrame:
    """Rows (__ts_at, __ts_batch) from rows (at, next)."""
    run = lambda c: F.floor(F.col(c) / RUN)
    with_run = pointers.withColumn("run", run("at"))
    n = pointers.count()
    # a chain enters a run at rows that a pointer from another run names
    crossing = with_run.where((F.col("run") != run("next")) & (F.col("next") < n)).select(F.col("next").alias("entry")).union(pointers.where("at = 0").select("at")).distinct()
    entries = staged(crossing, "entries")

    def through(rows: pa.Table, entry: pa.Table) -> pa.Table:
        import numpy as np

        rows = rows.sort_by("at")
        first, after = rows.column("at")[0].as_py() if rows.num_rows else 0, rows.column("next").to_numpy()
        leaves, hops = after.copy(), np.ones(len(after), np.int64)
        for i in range(len(after) - 1, -1, -1):  # from the end: the next row's way is known
            j = after[i] - first
            if j < len(after):
                leaves[i], hops[i] = leaves[j], hops[j] + 1
        own = np.sort(entry.column("entry").to_numpy()) if rows.num_rows else np.empty(0, np.int64)
        return pa.table({"entry": pa.array(own, pa.int64()), "leaves": pa.array(leaves[own - first], pa.int64()), "hops": pa.array(hops[own - first], pa.int64())})

    through.__annotations__ = {"rows": pa.Table, "entry": pa.Table, "return": pa.Table}
    jumps = with_run.select("run", "at", "next").groupBy("run").cogroup(entries.withColumn("run", run("entry")).groupBy("run")).applyInArrow(through, "entry long, leaves long, hops long")
    jumps = staged(jumps, "jumps")
    reached = entries.where("entry = 0").select(F.col("entry").alias("at"), F.lit(0).cast("long").alias("batch"))
    size = reached.count()
    while True:  # after k rounds all entries within 2**k runs are reached
        ahead = reached.join(jumps, F.col("at") == F.col("entry")).where(F.col("leaves") < n).select(F.col("leaves").alias("at"), (F.col("batch") + F.col("hops")).alias("batch"))
        reached = staged(reached.union(ahead).distinct(), "reached")
        now = reached.count()
        if now == size:
            break
        size = now
        other = jumps.select(F.col("entry").alias("o_entry"), F.col("leaves").alias("o_leaves"), F.col("hops").alias("o_hops"))
        jumps = staged(jumps.join(other, F.col("leaves") == F.col("o_entry"), "left").select("entry", F.coalesce("o_leaves", "leaves").alias("leaves"), (F.col("hops") + F.coalesce("o_hops", F.lit(0))).alias("hops")), "jumps")

    def along(rows: pa.Table, entry: pa.Table) -> pa.Table:
        import numpy as np

        rows = rows.sort_by("at")
        at, after = rows.column("at").to_numpy(), rows.column("next").to_numpy()
        begins = np.zeros(len(at), np.int64)
        number = np.full(len(at), -1, np.int64)
        if len(at) and entry.num_rows:
            i, batch = int(entry.column("at").to_numpy().min()) - at[0], int(entry.column("batch").to_numpy().min())
            number[:i] = batch - 1
            begins[i] = 1
            start = i
            while i < len(at):
                begins[i] = 1
                i = after[i] - at[0]
            number[start:] = batch - 1 + np.cumsum(begins[start:])
        return pa.table({"__ts_at": pa.array(at, pa.int64()), "__ts_batch": pa.array(number, pa.int64(), mask=number < 0) if len(at) else pa.array([], pa.int64())})

    along.__annotations__ = {"rows": pa.Table, "entry": pa.Table, "return": pa.Table}
    known = with_run.select("run", "at", "next").groupBy("run").cogroup(reached.withColumn("run", run("at")).groupBy("run")).applyInArrow(along, "__ts_at long, __ts_batch long")
    # a run without a beginning lies in the batch before it: the last one that begins in an earlier run, a row a run
    known = known.withColumn("__ts_run", run("__ts_at"))
    last = Window.partitionBy(F.lit(0)).orderBy("r_run")
    lasts = known.groupBy(F.col("__ts_run").alias("r_run")).agg(F.max("__ts_batch").alias("r_last")).withColumn("r_last", F.max("r_last").over(last))
    return known.join(lasts, F.col("__ts_run") == F.col("r_run")).select("__ts_at", F.coalesce("__ts_batch", "r_last").alias("__ts_batch"))
