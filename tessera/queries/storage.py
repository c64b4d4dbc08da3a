"""Files, stores, repositories and services: what is written is read back, outside services are pure functions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import models as M
from tessera.functions import text as T
from tessera.functions import urls as U
from tessera.operators import call_graph, catalog, embedding
from tessera.operators.vector_index import make_index
from tessera.plans.dealing import dealt
from tessera.plans.staging import scratch
from tessera.queries import collector, table
from tessera.sources import code, connectors, remote, store
from tessera.sources import files as S

QUERIES, ORACLES, query = collector()


def text_of(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def folder(spark: SparkSession, label: str) -> str:
    """A new folder as a URI that writers outside Spark know too."""
    path = scratch(spark, label)
    return path if "://" in path else "file://" + path.removeprefix("file:")


@query("chunk_metadata", "SELECT text AS page_content, 'd/' || doc_id || '.txt' AS source, CAST(doc_id AS VARCHAR) AS doc_id FROM documents")
def chunk_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files as chunks with a map of metadata."""
    rows = table(spark, sf_dir, "documents").select(text_of("d/", F.col("doc_id"), ".txt").alias("source"), "doc_id", F.col("text").alias("content"))
    return S.as_chunks(rows).select("page_content", F.col("metadata")["source"].alias("source"), F.col("metadata")["doc_id"].alias("doc_id"))


@query("display_names", "SELECT doc_id, source || ' 中 é.txt' AS name FROM documents")
def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = U.encoded(T.escaped_cjk(text_of(F.col("source"), " 中 é.txt")))
    return table(spark, sf_dir, "documents").select("doc_id", catalog.display_name(stored).alias("name"))


@query("source_links", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source WHEN doc_id % 3 = 1 THEN lang END AS link FROM documents")
def source_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source if there is one, else the path, else none; empty ones do not count."""
    k = F.col("doc_id") % 3
    meta = F.create_map(F.lit("source"), F.when(k == 0, F.col("source")).otherwise(""), F.lit("file_path"), F.when(k < 2, F.col("lang")))
    return table(spark, sf_dir, "documents").select("doc_id", catalog.source_link(meta).alias("link"))


@query("complete_settings", "SELECT doc_id, quality = 1 AND toxic = 1 AS complete FROM labels")
def complete_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, url = F.when(F.col("quality") == 1, "k").otherwise(""), F.when(F.col("toxic") == 1, "u")
    return table(spark, sf_dir, "labels").select("doc_id", catalog.config_complete(key, url).alias("complete"))


@query("first_match", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey) = 1")
def first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return call_graph.first_of(rows, ["l_orderkey"], [F.desc("l_quantity"), F.asc("l_linenumber"), F.asc("l_partkey")]).drop("l_quantity")


@query("definition_members", "SELECT o_orderkey AS node, o_custkey AS file, o_orderkey % 40 AS line, o_orderkey % 3 AS \"column\" FROM orders o WHERE EXISTS (SELECT 1 FROM customer c WHERE c_custkey = o_custkey AND c_custkey % 40 = o_orderkey % 40 AND c_nationkey % 3 = o_orderkey % 3)")
def definition_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes at whose line and column a definition of their file starts."""
    nodes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"), F.col("o_custkey").alias("file"), (F.col("o_orderkey") % 40).alias("line"), (F.col("o_orderkey") % 3).alias("column"))
    defs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file"), (F.col("c_custkey") % 40).alias("line"), (F.col("c_nationkey") % 3).cast("long").alias("column"))
    return call_graph.is_definition(nodes, defs).select("node", "file", "line", "column")


@query("batch_answers", "SELECT p_partkey AS batch, CAST(i AS INT) AS pos, CASE i WHEN 0 THEN p_name ELSE p_brand END AS text, CASE i WHEN 0 THEN CAST(p_size AS DOUBLE) ELSE p_retailprice END AS value FROM part, (SELECT unnest([0, 1]) AS i)")
def batch_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a service put back beside their texts by place."""
    p = table(spark, sf_dir, "part")
    requests = p.select(F.col("p_partkey").alias("batch"), F.array("p_name", "p_brand").alias("texts"))
    responses = p.select(F.col("p_partkey").alias("batch"), F.array(F.array(F.col("p_size").cast("double")), F.array("p_retailprice")).alias("data"))
    return embedding.reassociated(requests, responses).select("batch", "pos", "text", F.get("embedding", F.lit(0)).alias("value"))


@query("task_runs", "SELECT c_custkey, CAST((row_number() OVER (ORDER BY c_custkey) - 1) // 7 AS INT) AS run, CAST((row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) // 3 AS INT) AS own_run FROM customer")
def task_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embedding.task_batches(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey", 7, "run")
    return embedding.task_batches(rows, "c_custkey", 3, "own_run", ["c_nationkey"]).select("c_custkey", "run", "own_run")


@query("literal_newlines", "SELECT doc_id, replace(text, chr(10), '') AS joined FROM documents")
def literal_newlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    escaped = F.replace("text", F.lit("\n"), F.lit("\\n"))
    return table(spark, sf_dir, "documents").select("doc_id", T.without_literal_newlines(escaped).alias("joined"))


@query("source_slices", "SELECT doc_id, substr(text, CAST(doc_id % 11 + 1 AS INT), CAST(doc_id % 5 AS INT)) AS code FROM documents")
def source_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = (F.col("doc_id") % 11).cast("int")
    return table(spark, sf_dir, "documents").select("doc_id", T.function_source(F.col("text"), start, start + (F.col("doc_id") % 5).cast("int")).alias("code"))


@query("suffix_readers", "SELECT 'd' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.py' ELSE '.ts' END AS path, CASE WHEN doc_id % 3 = 0 THEN 'python' END AS kind, CASE WHEN doc_id % 3 = 1 THEN upper(lang) END AS tag FROM documents WHERE doc_id % 3 < 2")
def suffix_readers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two readers by suffix, one after another; a suffix without a reader is left out."""
    k = F.col("doc_id") % 3
    rows = table(spark, sf_dir, "documents").select(text_of("d", F.col("doc_id"), F.when(k == 0, ".py").when(k == 1, ".ts").otherwise(".md")).alias("path"), "lang")
    readers = {".py": lambda df: df.select("path", F.lit("python").alias("kind")), ".ts": lambda df: df.select("path", F.upper("lang").alias("tag"))}
    return S.by_suffix(rows, readers)


@query("document_ids", "SELECT doc_id, sha256(doc_id || chr(31) || text) AS id FROM documents")
def document_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", embedding.document_id("doc_id", "text").alias("id"))


@query("service_vectors", "SELECT doc_id, CAST(length(text) AS DOUBLE) AS size FROM documents")
def service_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch service, tried again when it fails, whose vectors are the texts' lengths."""
    chunks = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("page_content"))
    service = M.retrying(lambda texts: [[float(len(t))] for t in texts])
    return embedding.embedded(chunks, service, limit=3000).select("doc_id", F.get("embedding", F.lit(0)).cast("double").alias("size"))


@query("store_round_trip", "SELECT vec_id, label, true AS refused, false AS gone FROM embeddings WHERE label < 5")
def store_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two resources are saved, a name is refused when it comes again, one is deleted, the other loaded."""
    e, path = table(spark, sf_dir, "embeddings"), scratch(spark, "store")
    store.save(e.where("label < 5"), path, "low")
    store.save(e.where("label >= 5"), path, "high")
    try:
        store.save(e, path, "low")
        refused = False
    except FileExistsError:
        refused = True
    store.delete(spark, path, "high")
    return store.load(spark, path, "low").select("vec_id", "label", F.lit(refused).alias("refused"), F.lit(store.exists(spark, path, "high")).alias("gone"))


@query("index_bytes", "SELECT vec_id, label, true AS trained FROM embeddings WHERE label = 1")
def index_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small index as bytes and back."""
    index = make_index(store.from_bytes(spark, store.to_bytes(table(spark, sf_dir, "embeddings").where("label = 1")))).train()
    return index.rows.select("vec_id", "label", F.lit(index.is_trained).alias("trained"))


@query("stored_settings", "SELECT 'k' || doc_id AS key, CASE WHEN doc_id % 2 = 0 THEN 'new' ELSE source END AS value FROM documents")
def stored_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), scratch(spark, "settings")
    rows = docs.select(text_of("k", F.col("doc_id")).alias("key"), F.col("source").alias("value"), "doc_id")
    store.put_settings(spark, path, rows)
    store.put_settings(spark, path, rows.where("doc_id % 2 = 0").withColumn("value", F.lit("new")))
    return store.settings(spark, path)


SUPPLIERS = "CASE s_suppkey % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' ELSE '.txt' END"


def supplier_files(spark: SparkSession, sf_dir: str, label: str) -> str:
    """A folder with a file for each supplier, in subfolders: Python, TypeScript and text."""
    path, k = folder(spark, label), F.col("s_suppkey") % 3
    name = text_of("n", F.col("s_nationkey"), "/s", F.col("s_suppkey"), F.when(k == 0, ".py").when(k == 1, ".ts").otherwise(".txt"))
    S.written(table(spark, sf_dir, "supplier").select(name.alias("path"), F.encode("s_name", "UTF-8").alias("content")), path).count()
    return path


@query("code_tree", f"SELECT 's' || s_suppkey || {SUPPLIERS} AS file_name, {SUPPLIERS} AS suffix, s_name AS content FROM supplier WHERE s_suppkey % 3 < 2")
def code_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are written by executors, then read as a code tree."""
    return S.documents(spark, supplier_files(spark, sf_dir, "code"), "code").select("file_name", "suffix", "content")


@query("folder_files", f"SELECT 'n' || s_nationkey || '/r' || s_suppkey % 2 AS folder, 's' || s_suppkey || {SUPPLIERS} AS name, octet_length(encode(s_name)) AS size, s_name AS content FROM supplier WHERE s_nationkey BETWEEN 10 AND 19 AND s_suppkey % 3 = 0")
def folder_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree that a sink with a commit wrote, read by folder: only the folders below n1... are listed, only files of one ending are read."""
    connectors.register(spark)
    target = folder(spark, "tree")
    name = text_of("n", F.col("s_nationkey"), "/r", F.col("s_suppkey") % 2, "/s", F.col("s_suppkey"), F.element_at(F.array(*map(F.lit, (".py", ".ts", ".txt"))), (F.col("s_suppkey") % 3 + 1).cast("int")))
    table(spark, sf_dir, "supplier").select(name.alias("path"), F.encode("s_name", "UTF-8").alias("content")).write.format("whole_files").mode("append").save(target)
    found = spark.read.format("file_tree").load(target).where("folder like 'n1%' and folder not like 'n1/%' and name like '%.py'")
    return found.select("folder", "name", "size", F.decode("content", "UTF-8").alias("content"))


@query("relayed_answers", "SELECT CAST(doc_id AS VARCHAR) AS stream_id, CAST(i AS BIGINT) AS seq, CASE i WHEN 0 THEN 'answer ' WHEN 1 THEN source || ' ' ELSE lang END AS chunk, i = 2 AS last FROM documents, (SELECT unnest([0, 1, 2]) AS i) WHERE source IS NOT NULL AND lang IS NOT NULL")
def relayed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of a model's pieces to prompts that come in two lots, handed on by a sink that commits; the query stops in between."""
    connectors.register(spark, lambda prompt: ("answer ", *re.findall(r".*? |.+", prompt)))
    here = folder(spark, "relay")
    prompts = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("stream_id"), text_of(F.col("source"), " ", F.col("lang")).alias("prompt"), F.col("doc_id") % 2).where("prompt is not null")
    for lot in (0, 1):
        prompts.where(F.col("(doc_id % 2)") == lot).select("stream_id", "prompt").write.parquet(f"{here}/prompts/lot={lot}")
        pieces = spark.readStream.format("model_deltas").load(f"{here}/prompts")
        pieces.writeStream.format("relay").option("path", f"{here}/said").option("checkpointLocation", f"{here}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("stream_id string, seq long, chunk string, last boolean").json(f"{here}/said").drop("batch")


@query("text_tree", "SELECT 's' || s_suppkey || '.txt' AS file_name, s_name AS content FROM supplier WHERE s_suppkey % 3 = 2")
def text_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.text_files(spark, supplier_files(spark, sf_dir, "text")).select("file_name", "content")


@query("whole_tree", f"SELECT 'n' || s_nationkey || '/s' || s_suppkey || {SUPPLIERS} AS path, length(s_name) AS size FROM supplier")
def whole_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.all_files(spark, supplier_files(spark, sf_dir, "all"))
    return rows.select(F.regexp_extract("source", "(n[0-9]+/s[0-9]+[.][a-z]+)$", 1).alias("path"), F.length("content").cast("long").alias("size"))


@query("pdf_pages", "SELECT 'n' || n_nationkey || '.pdf' AS file_name, CAST(i AS VARCHAR) AS page_label, CASE i WHEN 1 THEN n_name ELSE 'region ' || n_regionkey END AS text FROM nation, (SELECT unnest([1, 2]) AS i)")
def pdf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by an injected reader: here a form feed stands between them."""
    path = folder(spark, "pdf")
    content = F.encode(text_of(F.col("n_name"), "\f", "region ", F.col("n_regionkey")), "UTF-8")
    S.written(table(spark, sf_dir, "nation").select(text_of("n", F.col("n_nationkey"), ".pdf").alias("path"), content.alias("content")), path).count()
    return S.pdf_pages(spark, path, reader=lambda raw: [(str(k + 1), t) for k, t in enumerate(raw.decode().split("\f"))]).select("file_name", "page_label", "text")


def host_listing(url: str) -> list[dict] | dict:
    """A code host with a folder of three folders, each with two files, one of them in a further folder."""
    path = url.split("/contents/")[1].split("?")[0]
    if path == "lib":
        return [{"path": f"lib/d{k}", "type": "dir"} for k in range(3)] + [{"path": "lib/top.py", "type": "file", "download_url": "raw/lib/top.py"}, {"path": "lib/link", "type": "symlink"}]
    if path.endswith("/in"):
        return {"path": f"{path}/deep.ts", "type": "file", "download_url": f"raw/{path}/deep.ts"}
    return [{"path": f"{path}/a.py", "type": "file", "download_url": f"raw/{path}/a.py"}, {"path": f"{path}/in", "type": "dir"}]


@query("repository_tree", "SELECT * FROM (VALUES ('top.py', 'raw/lib/top.py'), ('d0/a.py', 'raw/lib/d0/a.py'), ('d1/a.py', 'raw/lib/d1/a.py'), ('d2/a.py', 'raw/lib/d2/a.py'), ('d0/in/deep.ts', 'raw/lib/d0/in/deep.ts'), ('d1/in/deep.ts', 'raw/lib/d1/in/deep.ts'), ('d2/in/deep.ts', 'raw/lib/d2/in/deep.ts')) t(path, content)")
def repository_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of a repository, listed level by level and fetched."""
    found = remote.repository_files(spark, "https://github.com/me/it/tree/main/lib", host_listing, str.encode, lambda url: "main")
    return found.select("path", F.decode("content", "UTF-8").alias("content"))


@query("default_branches", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'dev' ELSE 'branch of https://api.github.com/repos/' || source || '/' || lang END AS branch FROM documents")
def default_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The host is asked where a URL names no branch."""
    url = text_of("https://github.com/", F.col("source"), "/", F.col("lang"), F.when(F.col("doc_id") % 2 == 0, "/tree/dev").otherwise(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", url.alias("url"))
    return remote.resolved(rows, lambda prefix: f"branch of {prefix}").select("doc_id", F.col("repo.branch").alias("branch"))


@query("server_models", "SELECT 'https://h' || n_nationkey || '/v1' AS base_url, 'gpt-' || n_regionkey AS id FROM nation")
def server_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models that servers list; only those with a known prefix stay."""
    bases = table(spark, sf_dir, "nation").select(text_of("https://h", F.col("n_nationkey"), "/v1").alias("base_url"), "n_regionkey")
    regions = {f"https://h{r.n_nationkey}/v1/models": r.n_regionkey for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").collect()}  # 25 rows
    found = remote.models(bases, lambda url: (200, {"data": [{"id": f"gpt-{regions[url]}"}, {"id": "other"}]}))
    return M.with_prefix(found, ("gpt",))


@query("json_emitted", """SELECT n_regionkey AS grp, '[' || string_agg('{"page_content":"' || n_name || '"}', ',' ORDER BY n_nationkey) || ']' AS payload FROM nation GROUP BY n_regionkey""")
def json_emitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("grp"), F.col("n_nationkey").alias("chunk_no"), F.col("n_name").alias("page_content"))
    return S.to_json_chunks(rows, "grp")


@query("json_equal", "SELECT event_id, true AS same, event_id % 2 = 0 AS other FROM events")
def json_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same object with its keys in two orders, and one whose list differs for odd ids."""
    key, kind = F.col("event_id").cast("string"), F.col("event_type")
    a = F.concat(F.lit('{"id": '), key, F.lit(', "of": {"x": null, "t": "'), kind, F.lit('"}, "l": [1, 2]}'))
    b = F.concat(F.lit('{"l":[1,'), F.lit("{}"), F.lit('],"of":{"t":"'), kind, F.lit('","x":null},"id":'), key, F.lit("}"))
    last = F.when(F.col("event_id") % 2 == 0, "2").otherwise("3")
    return table(spark, sf_dir, "events").select("event_id", T.same_json(a, F.replace(b, F.lit("{}"), F.lit("2"))).alias("same"), T.same_json(a, F.replace(b, F.lit("{}"), last)).alias("other"))


@query("model_deltas", "SELECT CAST(doc_id AS VARCHAR) AS stream_id, CAST(i AS BIGINT) AS seq, CASE i WHEN 0 THEN 'answer ' WHEN 1 THEN source || ' ' ELSE lang END AS chunk FROM documents, (SELECT unnest([0, 1, 2]) AS i)")
def model_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's answer as it comes, piece by piece."""
    prompts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("stream_id"), text_of(F.col("source"), " ", F.col("lang")).alias("prompt"))
    return M.deltas(prompts, lambda text: iter(["answer ", text.split(" ")[0] + " ", text.split(" ")[1]]))


@query("provider_choice", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN upper(source) || '!' ELSE lower(source) || '?' END AS answer FROM documents")
def provider_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    makers = {"loud": lambda mark: lambda text: text.upper() + mark, "quiet": lambda mark: lambda text: text.lower() + mark}
    loud, quiet = M.provider("loud", makers, mark="!"), M.provider("quiet", makers, mark="?")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", loud(F.col("source")).alias("a"), quiet(F.col("source")).alias("b"))
    return docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("a")).otherwise(F.col("b")).alias("answer"))


@query("callbacks_left_out", "SELECT 'f' || p_partkey || '.js' AS filepath, unnest(['own' || p_partkey, 'bound' || p_partkey]) AS name FROM part")
def callbacks_left_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions that are arguments of a call are no definitions."""
    text = "list.map(function (x) { return x; });\nfunction own~(a) { a.forEach((b) => { b(); }); go(function named() { return 1; }, async (c) => c); }\nconst bound~ = (x) => x;\n"
    key = F.col("p_partkey").cast("string")
    parts = dealt(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey")
    rows = parts.select(text_of("f", key, ".js").alias("source"), F.lit(".js").alias("suffix"), F.replace(F.lit(text), F.lit("~"), key).alias("content"))
    return code.code_definitions(rows).select("filepath", "name")
