"""Vector search and index maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.models import letter_vector
from tessera.functions.vectors import METRICS, cosine_distance
from tessera.operators.label_bitmaps import relabelled
from tessera.operators.vector_index import FlatIndex, make_index
from tessera.plans.ranking import percentiles, running, with_next
from tessera.plans.staging import staged
from tessera.queries import collector, table

QUERIES, ORACLES, query = collector()

ZIP = "list_zip(a.v, b.v)"


def summed(term: str, pairs: str = ZIP) -> str:
    return f"list_sum(list_transform({pairs}, lambda z: {term}))"


X, Y = "z[1]", "z[2]"
#: Each metric in SQL, over double arrays a.v and b.v.
SQL = {
    "l2": summed(f"({X} - {Y}) * ({X} - {Y})"),
    "inner_product": summed(f"{X} * {Y}"),
    "l1": summed(f"abs({X} - {Y})"),
    "linf": f"list_max(list_transform({ZIP}, lambda z: abs({X} - {Y})))",
    "lp": summed(f"pow(abs({X} - {Y}), 3)"),
    "canberra": summed(f"CASE WHEN abs({X}) + abs({Y}) = 0 THEN 0 ELSE abs({X} - {Y}) / (abs({X}) + abs({Y})) END"),
    "bray_curtis": f"{summed(f'abs({X} - {Y})')} / {summed(f'abs({X} + {Y})')}",
    "cosine": f"1 - {summed(f'{X} * {Y}')} / (sqrt({summed('z[1] * z[2]', 'list_zip(a.v, a.v)')}) * sqrt({summed('z[1] * z[2]', 'list_zip(b.v, b.v)')}))",
    "jaccard": f"{summed(f'least({X}, {Y})')} / {summed(f'greatest({X}, {Y})')}",
    "jensen_shannon": "0.5 * " + summed(f"CASE WHEN {X} > 0 THEN {X} * ln({X} / (({X} + {Y}) / 2)) ELSE 0 END + CASE WHEN {Y} > 0 THEN {Y} * ln({Y} / (({X} + {Y}) / 2)) ELSE 0 END"),
}
#: Counts of the small letters of t.
LETTERS = "list_transform(string_split('a,b,c,d,e,f,g,h,i,j,k,l,m,n,o,p,q,r,s,t,u,v,w,x,y,z', ','), lambda c: CAST(length(t) - length(replace(t, c, '')) AS DOUBLE))"
PLAIN = "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"
SHARES = "SELECT vec_id, list_transform(w, lambda x: x / list_sum(w)) AS v FROM (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: abs(x)) AS w FROM embeddings)"


def shares(df: DataFrame) -> DataFrame:
    """Vectors without signs, as shares of their sum."""
    positive = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    return df.withColumn("w", positive).withColumn("s", F.aggregate("w", F.lit(0.0), lambda s, x: s + x)).withColumn("embedding", F.transform("w", lambda x: x / F.col("s"))).drop("w", "s")


def first_vector(df: DataFrame) -> list[float]:
    row = df.orderBy("vec_id").limit(1).select("embedding").first()
    return list(row.embedding) if row else []


@query("knn_l2_top4", f"WITH e AS ({PLAIN}), d AS (SELECT a.vec_id, round({SQL['l2']}, 9) AS x FROM e a, (SELECT v FROM e ORDER BY vec_id LIMIT 1) b) SELECT CAST(row_number() OVER (ORDER BY x, vec_id) AS INT) AS rank, vec_id, round(x, 6) AS distance FROM d ORDER BY x, vec_id LIMIT 4")
def knn_l2_top4(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return FlatIndex(e).search(first_vector(e)).select("rank", "vec_id", F.round("distance", 6).alias("distance"))


@query("knn_l2_threshold", f"WITH e AS ({PLAIN}), d AS (SELECT a.vec_id, round({SQL['l2']}, 9) AS x FROM e a, (SELECT v FROM e ORDER BY vec_id LIMIT 1) b), t AS (SELECT * FROM d ORDER BY x, vec_id LIMIT 4) SELECT vec_id, round(x, 6) AS distance FROM t WHERE x < 1.3")
def knn_l2_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four nearest first, then those near enough of them."""
    e = table(spark, sf_dir, "embeddings")
    return FlatIndex(e).search(first_vector(e), keep=F.col("distance") < 1.3).select("vec_id", F.round("distance", 6).alias("distance"))


def batch_sql(metric: str, rows: str) -> str:
    order = "DESC" if METRICS[metric][1] else "ASC"
    return f"""WITH e AS ({rows}), d AS (SELECT b.vec_id AS query_id, a.vec_id, round({SQL[metric]}, 9) AS x FROM e a, e b WHERE b.vec_id % 50 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY x {order}, vec_id) AS rank FROM d) SELECT query_id, CAST(rank AS INT) AS rank, vec_id, round(x, 6) + 0 AS distance FROM r WHERE rank <= 4"""


def batch_query(metric: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = table(spark, sf_dir, "embeddings")
        e = shares(e) if metric in ("jaccard", "jensen_shannon") else e
        queries = e.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
        return make_index(e, "Flat", metric).search_batch(queries).withColumn("distance", F.round("distance", 6) + 0.0)

    return run


for _metric in METRICS:
    _rows = SHARES if _metric in ("jaccard", "jensen_shannon") else PLAIN
    query("knn_batch" if _metric == "l2" else f"knn_{_metric}", batch_sql(_metric, _rows))(batch_query(_metric))


@query("index_trained_batch", batch_sql("l2", PLAIN))
def index_trained_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same questions as knn_batch, from cells that are trained on all vectors."""
    e = table(spark, sf_dir, "embeddings")
    queries = e.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    return make_index(e, "IVF32,Flat").train().build().search_batch(queries).withColumn("distance", F.round("distance", 6) + 0.0)


@query("knn_join", f"WITH e AS ({PLAIN}), d AS (SELECT b.vec_id AS query_id, a.vec_id, round({SQL['l2']}, 9) AS x FROM e a, e b), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY x, vec_id) AS rank FROM d) SELECT query_id, CAST(rank AS INT) AS rank, vec_id, round(x, 6) + 0 AS distance FROM r WHERE rank <= 4")
def knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four nearest of every vector, all against all."""
    e = table(spark, sf_dir, "embeddings")
    index = make_index(e, "IVF32,Flat").train().build()
    return index.nearest_join(e.withColumnRenamed("vec_id", "query_id")).withColumn("distance", F.round("distance", 6) + 0.0)


def letter_index(spark: SparkSession, sf_dir: str):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), letter_vector(F.col("text")).alias("embedding"))
    vectors = staged(docs, "letters")
    return vectors, make_index(vectors, "IVF64,Flat", "cosine").train().build()


@query(
    "knn_join_documents",
    f"""WITH w AS (SELECT doc_id AS vec_id, {LETTERS} AS v FROM (SELECT doc_id, lower(text) AS t FROM documents)), e AS (SELECT vec_id, list_transform(v, lambda x: x / n) AS v FROM (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM w) WHERE n > 0),
 d AS (SELECT b.vec_id AS query_id, a.vec_id, round(1 - list_inner_product(a.v, b.v), 9) AS x FROM e a, e b), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY x, vec_id) AS rank FROM d) SELECT query_id, CAST(rank AS INT) AS rank, vec_id, round(x, 6) + 0 AS distance FROM r WHERE rank <= 3""",
)
def knn_join_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest documents of every document by their letters: clustered vectors, of which most cells are never compared."""
    vectors, index = letter_index(spark, sf_dir)
    return index.nearest_join(vectors.withColumnRenamed("vec_id", "query_id"), 3).withColumn("distance", F.round("distance", 6) + 0.0)


@query("index_stats", "SELECT count(*) AS ntotal, CAST(max(len(embedding)) AS BIGINT) AS dimension FROM embeddings")
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FlatIndex(table(spark, sf_dir, "embeddings")).ntotal()


HALVES = "h AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label < 5 ORDER BY vec_id) - 1 AS own, label >= 5 AS late FROM embeddings)"


@query("index_merge", f"WITH {HALVES} SELECT own + CASE WHEN late THEN (SELECT count(*) FROM h WHERE NOT late) ELSE 0 END AS vec_id, label, vec_id AS old_id FROM h")
def index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two indexes of the lower and the upper labels, each densely labelled, as one."""
    from tessera.operators.vector_index import labelled

    e = table(spark, sf_dir, "embeddings").withColumn("old_id", F.col("vec_id"))
    low, high = (FlatIndex(labelled(e.where(c), "vec_id", "vec_id")) for c in ("label < 5", "label >= 5"))
    return low.merge(high).rows.select("vec_id", "label", "old_id")


@query("index_remove_ids", "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS vec_id, vec_id AS old_id, (SELECT count(*) FROM embeddings WHERE label = 3) AS removed FROM embeddings WHERE label <> 3")
def index_remove_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").withColumn("old_id", F.col("vec_id"))
    left, removed = FlatIndex(e).remove(e.where("label = 3").select("vec_id"))
    return left.rows.crossJoin(removed).select("vec_id", "old_id", "removed")  # one row on the right


@query("index_remove_by_bitmap", "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS vec_id, vec_id AS old_id, len(embedding) AS size, (SELECT count(*) FROM embeddings WHERE label % 3 = 1) AS removed FROM embeddings WHERE label % 3 <> 1 OR label IS NULL")
def index_remove_by_bitmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As index_remove_ids, without moving the vectors: their new labels are counted from bits."""
    e = table(spark, sf_dir, "embeddings").withColumn("old_id", F.col("vec_id"))
    left, removed = relabelled(e, e.where("label % 3 = 1").select("vec_id"), "vec_id")
    return left.crossJoin(removed).select("vec_id", "old_id", F.size("embedding").cast("long").alias("size"), "removed")  # one row on the right


@query("index_add", "SELECT vec_id, label FROM embeddings UNION ALL SELECT (SELECT count(*) FROM embeddings) + row_number() OVER (ORDER BY vec_id) - 1, label + 100 FROM embeddings")
def index_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return FlatIndex(e).add(e.withColumn("label", F.col("label") + 100), "vec_id").rows.select("vec_id", "label")


NEXT = f"n AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, lead(CAST(embedding AS DOUBLE[])) OVER (PARTITION BY label ORDER BY vec_id) AS w FROM embeddings), g AS (SELECT vec_id, label, round({SQL['cosine'].replace('a.v', 'v').replace('b.v', 'w')}, 9) AS distance FROM n)"


#: Labels of an index are dense: runs of them spread the rows of any group.
def id_run() -> Column:
    return F.floor(F.col("vec_id") / 4096)


def with_distance(e: DataFrame) -> DataFrame:
    after = with_next(e, ["label"], ["vec_id"], "embedding", "after", id_run())
    return after.withColumn("distance", F.round(cosine_distance(F.col("embedding"), F.col("after")), 9)).drop("after")


@query("adjacent_distance", f"WITH {NEXT} SELECT vec_id, label, round(distance, 6) AS distance FROM g")
def adjacent_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_distance(table(spark, sf_dir, "embeddings")).select("vec_id", "label", F.round("distance", 6).alias("distance"))


@query("semantic_breakpoints", f"WITH {NEXT}, t AS (SELECT label, round(quantile_cont(distance, 0.8), 9) AS t FROM g GROUP BY label), b AS (SELECT vec_id, g.label, CASE WHEN distance > t THEN 1 ELSE 0 END AS brk FROM g JOIN t ON g.label = t.label) SELECT vec_id, label, CAST(coalesce(sum(brk) OVER (PARTITION BY label ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS chunk_id FROM b")
def semantic_breakpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a table rather than a document's array: chunks of each label's vectors, in the order of their ids."""
    d = staged(with_distance(table(spark, sf_dir, "embeddings")).select("vec_id", "label", "distance"), "distances")  # read three times
    limits = percentiles(d, ["label"], "distance", 0.8, "t", F.floor(F.col("distance") * 10_000)).withColumn("t", F.round("t", 9))
    broken = F.when(F.col("distance") > F.col("t"), F.lit(1)).otherwise(0).cast("long")
    return running(d.join(limits, "label"), ["label"], ["vec_id"], broken, "chunk_id", id_run()).select("vec_id", "label", "chunk_id")


@query("distance_threshold_std", f"WITH {NEXT} SELECT label, round(avg(distance) + 0.5 * stddev_pop(distance), 6) AS threshold FROM g GROUP BY label")
def distance_threshold_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_distance(table(spark, sf_dir, "embeddings")).groupBy("label").agg(F.round(F.avg("distance") + 0.5 * F.stddev_pop("distance"), 6).alias("threshold"))
