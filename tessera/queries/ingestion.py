"""From files and texts to chunks and token batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import tokens as K
from tessera.functions.urls import file_name, is_supported, suffix
from tessera.operators import chunking, trigram_index
from tessera.operators.token_batching import batched
from tessera.queries import collector, table

QUERIES, ORACLES, query = collector()

#: Sentences of a text, in SQL: RE2 has no look-behind, so a mark is put where a sentence ends.
SPLIT = r"string_split(regexp_replace(text, '([.。?？!！])[\s\p{Z}\x{85}\x1c-\x1f]+', '\1' || chr(1), 'g'), chr(1))"
MERGE = "list_reduce(s, lambda acc, x: CASE WHEN length(acc.cur || x.cur) < 50 THEN {'out': acc.out, 'cur': acc.cur || x.cur} ELSE {'out': list_append(acc.out, acc.cur || x.cur), 'cur': ''} END, {'out': CAST([] AS VARCHAR[]), 'cur': ''})"
MERGED = f"p AS (SELECT doc_id, list_transform({SPLIT}, lambda x: {{'out': CAST([] AS VARCHAR[]), 'cur': x}}) AS s FROM documents), f AS (SELECT doc_id, {MERGE} AS r FROM p), m AS (SELECT doc_id, CASE WHEN r.cur <> '' THEN list_append(r.out, r.cur) ELSE r.out END AS pieces FROM f)"


@query("sentence_split", f"WITH s AS (SELECT doc_id, {SPLIT} AS l FROM documents) SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INT) AS pos, unnest(l) AS sentence FROM s")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))


@query("sentence_merge", f"WITH {MERGED} SELECT doc_id, CAST(generate_subscripts(pieces, 1) - 1 AS INT) AS pos, unnest(pieces) AS piece FROM m")
def sentence_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.split_sentences(F.col("text"))).alias("pos", "piece"))


GROUPED = "g AS (SELECT doc_id, pieces, list_transform(range(1, len(pieces) + 1), lambda i: CASE WHEN i > 1 THEN pieces[i - 1] ELSE '' END || pieces[i] || CASE WHEN i < len(pieces) THEN pieces[i + 1] ELSE '' END) AS groups FROM m)"


@query("sentence_groups", f"WITH {MERGED}, {GROUPED} SELECT doc_id, CAST(generate_subscripts(groups, 1) - 1 AS INT) AS pos, unnest(groups) AS combined FROM g")
def sentence_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = table(spark, sf_dir, "documents").select("doc_id", T.split_sentences(F.col("text")).alias("p"))
    return pieces.select("doc_id", F.posexplode(chunking.sentence_groups(F.col("p"))).alias("pos", "combined"))


LETTER = "list_transform(string_split('a,b,c,d,e,f,g,h,i,j,k,l,m,n,o,p,q,r,s,t,u,v,w,x,y,z', ','), lambda c: CAST(length(t) - length(replace(t, c, '')) AS DOUBLE))"
CHUNKS = f"""WITH {MERGED}, {GROUPED},
 e AS (SELECT doc_id, pieces, unnest(groups) AS grp, generate_subscripts(groups, 1) AS i FROM g),
 v AS (SELECT doc_id, i, {LETTER} AS v FROM (SELECT doc_id, i, lower(grp) AS t FROM e)),
 u AS (SELECT doc_id, i, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM v),
 d AS (SELECT doc_id, i, v, n, lead(v) OVER w AS v2, lead(n) OVER w AS n2 FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
 c AS (SELECT doc_id, i, round(CASE WHEN n > 0 AND n2 > 0 THEN 1 - list_sum(list_transform(list_zip(v, v2), lambda z: z[1] * z[2])) / (n * n2) ELSE 0 END, 9) AS d FROM d WHERE v2 IS NOT NULL),
 t AS (SELECT doc_id, round(quantile_cont(d, 0.8), 9) AS t FROM c GROUP BY doc_id),
 b AS (SELECT e.doc_id, e.i, pieces[e.i] AS s, coalesce(sum(CASE WHEN d > t THEN 1 ELSE 0 END) OVER (PARTITION BY e.doc_id ORDER BY e.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM e LEFT JOIN c ON e.doc_id = c.doc_id AND e.i = c.i LEFT JOIN t ON e.doc_id = t.doc_id),
 j AS (SELECT doc_id, k, regexp_replace(string_agg(s, '' ORDER BY i), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS page_content FROM b GROUP BY doc_id, k)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INT) AS chunk_no, page_content FROM j WHERE page_content <> ''"""


@query("semantic_chunks", CHUNKS)
def semantic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunked(table(spark, sf_dir, "documents").select("doc_id", "text"))


SAMPLE = "中 A 中 英文 x y 中 7"


@query("mixed_script_spacing", f"SELECT doc_id, regexp_replace(left(text, 200) || ' {SAMPLE}', '([\\x{{4e00}}-\\x{{9fff}}]) ([\\p{{L}}\\p{{N}}_])|([a-zA-Z]) ([\\x{{4e00}}-\\x{{9fff}}])', '\\1\\2\\3\\4', 'g') AS closed FROM documents".replace("left(text, 200)", "text"))
def mixed_script_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.close_up_scripts(F.concat("text", F.lit(f" {SAMPLE}"))).alias("closed"))


@query("nonblank_docs", r"SELECT doc_id FROM documents WHERE regexp_matches(text, '[^\s\p{Z}]')")
def nonblank_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(T.not_blank(F.col("text"))).select("doc_id")


NAMES = "CASE doc_id % 5 WHEN 0 THEN 'src/a.py' WHEN 1 THEN 'x/y.d.ts' WHEN 2 THEN 'README' WHEN 3 THEN 'z/.env' ELSE 'b.java' END"


@query("suffix_filter", f"SELECT doc_id, p AS path, regexp_extract(p, '[^/]*$') AS file_name, CASE WHEN regexp_matches(regexp_extract(p, '[^/]*$'), '.\\.[^.]*$') THEN regexp_extract(p, '\\.[^./]*$') ELSE '' END AS suffix FROM (SELECT doc_id, {NAMES} AS p FROM documents) WHERE regexp_matches(p, '\\.(py|php|js|ts|go|cpp|java|rb|cs)$')")
def suffix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = table(spark, sf_dir, "documents").select("doc_id", F.expr(NAMES).alias("path"))
    return paths.where(is_supported(F.col("path"))).select("doc_id", "path", file_name(F.col("path")).alias("file_name"), suffix(F.col("path")).alias("suffix"))


@query("token_count", "SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents")
def token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", K.approximate_tokens(F.col("text")).alias("tokens"))


BATCH = "list_reduce(list_transform(pieces, lambda x: {'b': 0, 'u': CAST(ceil(length(x) / 4.0) AS BIGINT), 'o': CAST([] AS INT[])}), lambda acc, x: CASE WHEN acc.u + x.u > 200 THEN {'b': acc.b + 1, 'u': x.u, 'o': list_append(acc.o, acc.b + 1)} ELSE {'b': acc.b, 'u': acc.u + x.u, 'o': list_append(acc.o, acc.b)} END, {'b': 0, 'u': CAST(0 AS BIGINT), 'o': CAST([] AS INT[])})"


@query("token_batches", f"WITH {MERGED}, r AS (SELECT doc_id, {BATCH}.o AS o FROM m) SELECT doc_id, CAST(generate_subscripts(o, 1) - 1 AS INT) AS pos, unnest(o) AS batch FROM r")
def token_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of a document's pieces within 200 tokens each."""
    counts = table(spark, sf_dir, "documents").select("doc_id", F.transform(T.split_sentences(F.col("text")), K.approximate_tokens).alias("n"))
    return counts.select("doc_id", F.posexplode(K.batches(F.col("n"), 200)).alias("pos", "batch"))


@query("token_prefix", "SELECT doc_id, substring(text, 1, 100) AS prefix FROM documents")
def token_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each letter is counted by itself, so a hundred tokens are a hundred letters."""
    return table(spark, sf_dir, "documents").select("doc_id", K.prefix_within(F.col("text"), 100).alias("prefix"))


@query("model_limits", "SELECT m AS model, CASE m WHEN 'gpt-4' THEN 8192 WHEN 'gpt-3.5-turbo-16k' THEN 16385 WHEN 'text-embedding-ada-002' THEN 8191 ELSE -1 END AS max_tokens FROM (SELECT unnest(['gpt-4', 'gpt-3.5-turbo-16k', 'text-embedding-ada-002', 'other']) AS m)")
def model_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([("gpt-4",), ("gpt-3.5-turbo-16k",), ("text-embedding-ada-002",), ("other",)], "model string")
    return K.with_limit(rows, "model")


@query("text_find", "SELECT doc_id, CAST((length(t) - length(replace(t, 'the', ''))) / 3 AS INT) AS matches, CASE WHEN contains(t, 'the') THEN CAST(instr(t, 'the') AS INT) END AS first_at FROM (SELECT doc_id, lower(text) AS t FROM documents)")
def text_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.find_count(text, F.lit("THE")).alias("matches"), F.get(T.find_positions(text, F.lit("THE")), 0).alias("first_at"))


@query("text_find_indexed", "SELECT w AS wanted, doc_id, CAST((length(t) - length(replace(t, lower(w), ''))) / length(w) AS INT) AS matches, CAST(instr(t, lower(w)) AS INT) AS first_at FROM (SELECT doc_id, lower(text) AS t FROM documents), (VALUES ('THE'), ('er'), ('z'), ('tion of'), ('ing the ')) v(w) WHERE contains(t, lower(w))")
def text_find_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted texts in all documents, from an index of trigrams; no text is read after it is written."""
    index = trigram_index.build(table(spark, sf_dir, "documents"))
    return trigram_index.counted(index, ["THE", "er", "z", "tion of", "ing the "]).withColumnRenamed("key", "doc_id")


LINES = "l AS (SELECT doc_id, generate_subscripts(s, 1) - 1 AS pos, unnest(s) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))"


@query(
    "token_batches_table",
    f"""WITH RECURSIVE {LINES}, n AS (SELECT doc_id, pos, CAST(ceil(length(line) / 4.0) AS BIGINT) AS n FROM l), s AS (SELECT doc_id, pos, n, row_number() OVER o AS i, sum(n) OVER o AS s FROM n WINDOW o AS (ORDER BY doc_id, pos ROWS UNBOUNDED PRECEDING)),
 u AS (SELECT s, max(i) AS i FROM s GROUP BY s), p AS MATERIALIZED (SELECT y.i, greatest(coalesce(u.i, 0) + 1, y.i + 1) AS nx FROM s y ASOF LEFT JOIN u ON y.s - y.n + 8191 >= u.s),
 r AS (SELECT CAST(1 AS BIGINT) AS i, 0 AS k UNION ALL SELECT nx, k + 1 FROM r JOIN p ON p.i = r.i WHERE nx <= (SELECT count(*) FROM s))
 SELECT doc_id, CAST(pos AS INT) AS pos, max(r.k) OVER (ORDER BY s.i ROWS UNBOUNDED PRECEDING) + CAST((SELECT max(n) FROM s WHERE i = 1) > 8191 AS INT) AS batch FROM s LEFT JOIN r ON s.i = r.i""",
)
def token_batches_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of all lines of all documents, as one pass over the table in order gives them."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return batched(lines.withColumn("n", K.approximate_tokens(F.col("line"))).drop("line"), ["doc_id", "pos"], F.col("n")).select("doc_id", "pos", "batch")


@query("unicode_escape", r"SELECT doc_id, replace(replace(text || ' 中文', '中', '\u4e2d'), '文', '\u6587') AS escaped, text || ' 中文' AS back FROM documents")
def unicode_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", T.escaped_cjk(F.concat("text", F.lit(" 中文"))).alias("escaped"))
    return rows.withColumn("back", T.unescaped(F.col("escaped")))


@query("json_chunks", "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, 'data: {\"result\":\"' || event_type || '\"}' AS chunk, event_type AS result FROM events")
def json_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers out of JSON, and results out of a server's events."""
    e = table(spark, sf_dir, "events")
    chunk = F.concat(F.lit('data: {"result":"'), F.col("event_type"), F.lit('"}'))
    return e.select("event_id", F.from_json("props", "k int")["k"].alias("k"), chunk.alias("chunk"), F.get(T.sse_results(chunk), 0).alias("result"))


@query("line_positions", "SELECT doc_id, CAST(len(string_split(left(text, 100), chr(10))) AS INT) AS line, CAST(length(string_split(left(text, 100), chr(10))[-1]) + 1 AS INT) AS col FROM documents")
def line_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line and column of the hundredth position of each text."""
    at = T.line_and_column(F.col("text"), F.lit(100))
    return table(spark, sf_dir, "documents").select("doc_id", at["line"].alias("line"), at["column"].alias("col"))
