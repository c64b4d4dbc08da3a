"""The catalog, the key-value store, URLs and listings."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import urls as U
from tessera.operators import catalog as C
from tessera.queries import collector, table
from tessera.sources import files as S

QUERIES, ORACLES, query = collector()


@query(
    "resource_catalog",
    """WITH o AS (SELECT 'd' || doc_id AS dir, f AS file, to_timestamp(doc_id)::TIMESTAMP AS birthtime FROM labels, (SELECT unnest(['docstore.json', 'faiss.index']) AS f) WHERE f = 'docstore.json' OR quality = 1),
 w AS (SELECT dir, min(birthtime) AS birthtime FROM o GROUP BY dir HAVING count(DISTINCT file) = 2)
 SELECT dir AS filename, birthtime, true AS embedding FROM w UNION ALL SELECT 'd' || doc_id, to_timestamp(doc_id)::TIMESTAMP, false FROM documents WHERE 'd' || doc_id NOT IN (SELECT dir FROM o)""",
)
def resource_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents have an output folder, which is whole if their quality is 1."""
    name, born = F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.timestamp_seconds("doc_id")
    docs = table(spark, sf_dir, "documents").select(name.alias("filename"), born.alias("birthtime"))
    files = F.explode(F.when(F.col("quality") == 1, F.array(*map(F.lit, C.MARKERS))).otherwise(F.array(F.lit(C.MARKERS[0]))))
    found = C.resources(docs, table(spark, sf_dir, "labels").select(name.alias("dir"), files.alias("file"), born.alias("birthtime")))
    return found.withColumn("birthtime", F.col("birthtime").cast("timestamp_ntz"))


STORE = "s AS (SELECT CAST(doc_id AS VARCHAR) AS key, CAST(quality AS VARCHAR) AS value FROM labels)"


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("key"), F.col("quality").cast("string").alias("value"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("lang = 'fr'").select(F.col("doc_id").cast("string").alias("key"), F.col("source").alias("value"))


CHANGES = "c AS (SELECT CAST(doc_id AS VARCHAR) AS key, source AS value FROM documents WHERE lang = 'fr')"


@query("kv_upsert", f"WITH {STORE}, {CHANGES} SELECT * FROM c UNION ALL SELECT * FROM s WHERE key NOT IN (SELECT key FROM c)")
def kv_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.upserted(store(spark, sf_dir), changes(spark, sf_dir))


@query("insert_if_absent", f"WITH {STORE}, {CHANGES} SELECT * FROM s UNION ALL SELECT * FROM c WHERE key NOT IN (SELECT key FROM s)")
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.inserted_if_absent(store(spark, sf_dir), changes(spark, sf_dir))


@query("delete_key", f"WITH {STORE}, {CHANGES} SELECT * FROM s WHERE key NOT IN (SELECT key FROM c)")
def delete_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.without_keys(store(spark, sf_dir), changes(spark, sf_dir).select("key"))


@query("kv_prefixed", "SELECT doc_id, '@tessera/' || source AS key, '@tessera/' || source AS again FROM documents")
def kv_prefixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = C.prefixed(F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", once.alias("key"), C.prefixed(once).alias("again"))


@query("config_choice", "SELECT doc_id, CASE WHEN toxic = 1 THEN 'p' WHEN quality = 1 THEN NULL ELSE 'p' END AS proxy, CASE WHEN quality = 1 THEN 'chat' ELSE 'own' END AS api_key FROM labels")
def config_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    enabled = F.when(F.col("toxic") == 1, True).when(F.col("quality") == 1, False)
    own = F.when(F.col("quality") == 1, "").otherwise("own")
    return table(spark, sf_dir, "labels").select("doc_id", C.proxy(enabled, F.lit("p")).alias("proxy"), C.embedding_config(own, F.lit(""), F.lit("chat"), F.lit("u"))["api_key"].alias("api_key"))


#: What a valid URL is, with repetitions nested, as RE2 may have them.
URL_SQL = r"(?i)^(https?://)?(([a-z\d]([a-z\d-]*[a-z\d])?\.)+[a-z]{2,}|((\d{1,3}\.){3}\d{1,3}))(:\d{2,5})?(/[-a-z\d%_.~+]*)*(\?[;&a-z\d%_.~+=-]*)?(#[-a-z\d_]*)?$"


@query("url_valid", f"SELECT page_id, regexp_matches(url, '{URL_SQL}') AS valid, regexp_matches(url, '^https?') AS remote, starts_with(url, 'https://github.com') AS code_host FROM pages")
def url_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", U.is_url(u).alias("valid"), U.is_remote(u).alias("remote"), U.is_code_host(u).alias("code_host"))


@query("url_parts", r"SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '[^/]*$') AS file_name FROM pages")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.parse_url("url", F.lit("PATH"))
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(path, F.lit("")).alias("path"), U.file_name(F.coalesce(path, F.lit(""))).alias("file_name"))


ENCODE = "replace(replace(replace(replace(replace(url_encode({}), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*')"


@query("url_encode", f"SELECT page_id, {ENCODE.format('u')} AS encoded, u AS back FROM (SELECT page_id, url || ' (a+b)!~*é' AS u FROM pages)")
def url_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    enc = U.encoded(F.concat("url", F.lit(" (a+b)!~*é")))
    return table(spark, sf_dir, "pages").select("page_id", enc.alias("encoded"), U.decoded(enc).alias("back"))


@query("node_ids", f"SELECT doc_id, {ENCODE.format('source')} || '/' || {ENCODE.format('lang')} AS id, source AS path FROM documents")
def node_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = U.node_id(F.array("source", "lang"))
    return table(spark, sf_dir, "documents").select("doc_id", made.alias("id"), U.node_path(made).alias("path"))


@query("repo_ref", "SELECT doc_id, source AS author, lang AS repository, 'main' AS branch, 'main' AS root_name_0, 'src/main/f' || doc_id AS res_path, 'https://api.github.com/repos/' || source || '/' || lang || '/contents/' AS url_prefix, '?ref=main' AS url_postfix FROM documents")
def repo_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A branch name that stands in the path again does no harm."""
    url = F.concat(F.lit("https://github.com/"), F.col("source"), F.lit("/"), F.col("lang"), F.lit("/tree/main/src/main/f"), F.col("doc_id").cast("string"))
    r = U.repository(url)
    return table(spark, sf_dir, "documents").select("doc_id", *(r[c].alias(c) for c in ("author", "repository", "branch")), F.lit("main").alias("root_name_0"), *(r[c].alias(c) for c in ("res_path", "url_prefix", "url_postfix")))


@query("base_urls", "SELECT u AS url, m AS models, n AS normal FROM (VALUES ('https://api.openai.com/', 'https://api.openai.com/models', 'https://api.openai.com/v1'), ('https://api.openai.com/v1', 'https://api.openai.com/v1/models', 'https://api.openai.com/v1'), ('http://x.y//', 'http://x.y//models', 'http://x.y//')) t(u, m, n)")
def base_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([("https://api.openai.com/",), ("https://api.openai.com/v1",), ("http://x.y//",)], "url string")
    return rows.select("url", U.models_url(F.col("url")).alias("models"), U.normal_base(F.col("url")).alias("normal"))


@query("file_tree", """WITH p AS (SELECT DISTINCT source, lang, doc_id FROM documents) SELECT '/' || source AS filepath, CAST(NULL AS VARCHAR) AS parent, source AS filename, 'dir' AS type, CAST(1 AS INT) AS depth FROM p GROUP BY source
 UNION ALL SELECT '/' || source || '/' || lang, '/' || source, lang, 'dir', 2 FROM p GROUP BY source, lang UNION ALL SELECT '/' || source || '/' || lang || '/' || doc_id || '.py', '/' || source || '/' || lang, doc_id || '.py', 'file', 3 FROM p""")
def file_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/"), F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".py"))
    return S.file_tree(table(spark, sf_dir, "documents").select(path.alias("path")))


@query("zip_entries", "SELECT * FROM (VALUES ('one.zip', 'repo/a.py', 'x = 1'), ('one.zip', 'repo/sub/b.ts', 'let y'), ('broken.zip', NULL, NULL)) t(path, entry_path, text)")
def zip_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive made here, opened on the executors, its root folder renamed; one that cannot be read, and one that is missing."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("root-main/a.py", "x = 1")
        z.writestr("root-main/sub/b.ts", "let y")
    archives = spark.createDataFrame([("one.zip", bytearray(out.getvalue())), ("broken.zip", bytearray(b"PK no archive")), ("none.zip", None)], "path string, content binary")
    return S.zip_entries(archives, "repo").select("path", "entry_path", F.decode("content", "UTF-8").alias("text"))
