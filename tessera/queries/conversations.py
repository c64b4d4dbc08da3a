"""From conversations and stored texts to prompts and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.models import letter_vector
from tessera.operators import answering as A
from tessera.queries import collector, table
from tessera.queries.retrieval import PLAIN, SQL
from tessera.streaming import deltas

QUERIES, ORACLES, query = collector()

PAIRS = "n AS (SELECT *, lead(role) OVER w AS r2, lead(text) OVER w AS t2, lag(role) OVER w AS r0 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), x AS (SELECT conv_id, turn, text AS question, t2 AS answer FROM n WHERE role = 'user' AND r2 = 'assistant')"
HISTORY = "h AS (SELECT conv_id, string_agg('Human: ' || question || chr(10) || 'Assistant: ' || answer, chr(10) ORDER BY turn) AS history FROM x GROUP BY conv_id)"


@query("history_render", f"WITH {PAIRS}, {HISTORY} SELECT conv_id, history FROM h")
def history_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.history(A.exchanges(table(spark, sf_dir, "conversations")))


@query("role_pairs", f"""WITH {PAIRS}, k AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place, count(*) OVER (PARTITION BY conv_id) AS n FROM n WHERE (role = 'user' AND (r2 = 'assistant' OR r2 IS NULL)) OR (role = 'assistant' AND r0 = 'user'))
 SELECT conv_id, place - n % 2 AS place, role, text FROM k UNION ALL SELECT conv_id, 0, 'user', '' FROM k WHERE place = 1 AND n % 2 = 0""")
def role_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.role_pairs(table(spark, sf_dir, "conversations"))


@query("last_ten", "SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, CASE WHEN role = 'user' THEN 1 ELSE 0 END) AS late FROM conversations) WHERE late <= 10")
def last_ten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.last_messages(table(spark, sf_dir, "conversations"))


@query("last_message", "SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id")
def last_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.last_messages(table(spark, sf_dir, "conversations"), 1).select("conv_id", "turn", "text")


TRIM = r"regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
ASKED = f"q AS (SELECT c.conv_id, replace({TRIM.format('arg_max(c.text, c.turn)')}, chr(10), ' ') AS question FROM conversations c WHERE c.role = 'user' GROUP BY c.conv_id), a AS (SELECT q.conv_id, question, coalesce(history, '') AS history FROM q LEFT JOIN h ON q.conv_id = h.conv_id)"
CONDENSE = "'Rewrite the follow-up as a question that stands alone.' || chr(10) || chr(10) || '<history>' || chr(10) || history || chr(10) || '</history>' || chr(10) || chr(10) || 'Follow-up: ' || question || chr(10) || 'Question:'"
ALONE = f"CASE WHEN history = '' THEN question ELSE 'answer ' || left(sha256({CONDENSE}), 12) END AS standalone"


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's last user message, with the exchanges of the conversation as its history."""
    c = table(spark, sf_dir, "conversations")
    last = c.where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("question"))
    return last.join(A.history(A.exchanges(c)), "conv_id", "left")


@query("standalone_question", f"WITH {PAIRS}, {HISTORY}, {ASKED} SELECT conv_id, {ALONE} FROM a")
def standalone_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.functions.text import sanitised_question

    return asked(spark, sf_dir).select("conv_id", A.standalone_question(sanitised_question(F.col("question")), F.col("history")).alias("standalone"))


NEAR = f"e AS ({PLAIN}), d AS (SELECT b.vec_id AS query_id, a.vec_id, round({SQL['l2']}, 9) AS x FROM e a, e b WHERE b.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY x, vec_id) AS rank FROM d), n AS (SELECT query_id, rank, text FROM r JOIN documents ON doc_id = vec_id WHERE rank <= 4)"


def near_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of each query vector's four nearest."""
    from tessera.operators.vector_index import FlatIndex

    e = table(spark, sf_dir, "embeddings")
    near = FlatIndex(e).search_batch(e.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"))
    return table(spark, sf_dir, "documents").select("text", F.col("doc_id").alias("vec_id")).join(near, "vec_id").select("query_id", "rank", "text")


@query("context_budget", f"WITH {NEAR}, s AS (SELECT query_id, rank, text, sum(CAST(ceil(length(text) / 4.0) AS BIGINT)) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) < 4096 - 200 AS ok FROM n) SELECT query_id, coalesce(string_agg(CASE WHEN ok THEN chr(10) || text END, '' ORDER BY rank), '') AS context, count(*) FILTER (WHERE ok) AS n_sources FROM s GROUP BY query_id")
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.packed_context(near_texts(spark, sf_dir), "query_id", "rank", "text", A.budget("gpt-3.5-turbo"))


@query("context_char_cut", f"WITH {NEAR} SELECT query_id, left(string_agg(text, chr(10) ORDER BY rank), 5000) AS context FROM n GROUP BY query_id")
def context_char_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.cut_context(near_texts(spark, sf_dir), "query_id", "rank", "text", 5000)


LETTER = "list_transform(string_split('a,b,c,d,e,f,g,h,i,j,k,l,m,n,o,p,q,r,s,t,u,v,w,x,y,z', ','), lambda c: CAST(length(t) - length(replace(t, c, '')) AS DOUBLE))"
UNIT = "list_transform(v, lambda x: CASE WHEN n > 0 THEN x / n ELSE 0 END)"
PROMPT = "'Answer from the context only; say so if it does not hold the answer.' || chr(10) || chr(10) || '<context>' || context || chr(10) || '</context>' || chr(10) || chr(10) || '<history>' || chr(10) || history || chr(10) || '</history>' || chr(10) || chr(10) || 'Question: ' || standalone || chr(10) || 'Answer in markdown:'"


def vectors(rows: str, key: str) -> str:
    """SQL of unit letter vectors of rows (key, t)."""
    return f"SELECT {key}, {UNIT} AS v FROM (SELECT {key}, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM (SELECT {key}, {LETTER} AS v FROM ({rows})))"


@query(
    "rag_end_to_end",
    f"""WITH {PAIRS}, {HISTORY}, {ASKED}, s AS (SELECT *, {ALONE} FROM a WHERE conv_id % 50 = 0),
 qv AS ({vectors("SELECT conv_id, lower(replace(standalone, chr(10), ' ')) AS t FROM s", "conv_id")}), dv AS ({vectors("SELECT doc_id, lower(text) AS t FROM documents", "doc_id")}),
 d AS (SELECT conv_id, doc_id, round({SQL['l2']}, 9) AS x FROM dv a, qv b), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY x, doc_id) AS rank FROM d), k AS (SELECT conv_id, rank, r.doc_id, text FROM r JOIN documents ON r.doc_id = documents.doc_id WHERE rank <= 4 AND x < 0.6),
 o AS (SELECT conv_id, rank, doc_id, text, sum(CAST(ceil(length(text) / 4.0) AS BIGINT)) OVER (PARTITION BY conv_id ORDER BY rank ROWS UNBOUNDED PRECEDING) < 3896 AS ok FROM k),
 c AS (SELECT conv_id, coalesce(string_agg(CASE WHEN ok THEN chr(10) || text END, '' ORDER BY rank), '') AS context, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY rank) AS sources FROM o GROUP BY conv_id),
 p AS (SELECT s.conv_id, question, standalone, sources, CASE WHEN sources IS NOT NULL THEN {PROMPT} END AS prompt FROM s LEFT JOIN c ON s.conv_id = c.conv_id)
 SELECT conv_id AS query_id, question, standalone, coalesce(sources, '') AS sources, CASE WHEN prompt IS NULL THEN 'No matching context was found.' ELSE 'answer ' || left(sha256(prompt), 12) END AS answer, prompt FROM p""",
)
def rag_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions: the last user message of every fiftieth conversation. Store: all documents by their letters."""
    questions = asked(spark, sf_dir).where("conv_id % 50 = 0").withColumnRenamed("conv_id", "query_id")
    store = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("page_content"), letter_vector(F.col("text")).alias("embedding"))
    return A.answered(questions, store)


@query("answer_prompt", ORACLES["rag_end_to_end"].replace("question, standalone, coalesce(sources, '') AS sources, CASE WHEN prompt", "CASE WHEN prompt").replace("END AS answer, prompt FROM p", "END AS answer FROM p"))
def answer_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rag_end_to_end(spark, sf_dir).select("query_id", "answer")


DELTAS = "SELECT CAST(conv_id AS VARCHAR) AS stream_id, turn AS seq, text AS chunk FROM conversations"


@query("stream_accumulate", f"SELECT stream_id, string_agg(chunk, '' ORDER BY seq) AS content, count(*) AS chunks FROM ({DELTAS}) GROUP BY stream_id")
def stream_accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's turns as deltas, through a stream that ends when all of the table was read."""
    return _through_stream(spark, sf_dir, deltas.accumulated, "complete")


@query("stream_first_chunk", f"SELECT stream_id, arg_min(chunk, seq) AS chunk FROM ({DELTAS}) GROUP BY stream_id")
def stream_first_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _through_stream(spark, sf_dir, deltas.first_chunks, "complete")


@query("stream_joined", f"SELECT stream_id, coalesce(string_agg(chunk, '' ORDER BY seq), '') AS content, count(*) AS chunks, CAST(stream_id AS BIGINT) % 5 <> 0 AND min(seq) = 0 AND max(seq) + 1 = count(*) AS ended FROM ({DELTAS}) GROUP BY stream_id")
def stream_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's turns as deltas that come twice and late turns first; a fifth of the streams never gets its end mark and is given up
    after the query was stopped and started again."""
    from tessera.plans.staging import scratch
    from tessera.streaming import sessions

    out = scratch(spark, "joined")
    turns = table(spark, sf_dir, "conversations")
    ends = turns.groupBy("conv_id").agg(F.max("turn").alias("end"))
    sent = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn"))
    marked = F.when(F.col("conv_id") % 5 != 0, F.col("turn") == F.col("end")).otherwise(False)
    rows = turns.join(ends, "conv_id").select(F.col("conv_id").cast("string").alias("stream_id"), F.col("turn").alias("seq"), F.col("text").alias("chunk"), marked.alias("last"), sent.alias("sent_at"))
    nobody = spark.range(1).select(*(F.lit(None).cast(t).alias(c) for c, t in (("stream_id", "string"), ("seq", "long"), ("chunk", "string"), ("last", "boolean"))), F.timestamp_seconds(F.lit(1_800_000_000)).alias("sent_at"))
    setting, store = "spark.sql.streaming.stateStore.providerClass", sessions.STATE_STORE
    before = spark.conf.get(setting)
    spark.conf.set(setting, store)
    try:
        for part in (rows.where("seq % 2 = 1"), rows, nobody):
            part.write.mode("append").parquet(f"{out}/deltas")
            whole = sessions.joined(deltas.watched(spark, f"{out}/deltas", sessions.ENDED_DELTA, files_per_batch=8), "1 day")
            deltas.relayed(whole, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/rows/batch={n}"), f"{out}/checkpoint", "append").awaitTermination()
    finally:
        spark.conf.set(setting, before)
    return spark.read.parquet(f"{out}/rows").drop("batch")


@query("dir_watch", "SELECT conv_id, turn, role FROM conversations")
def dir_watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's files as they are found by a file stream."""
    return _through_stream(spark, sf_dir, None, "append")


def _through_stream(spark: SparkSession, sf_dir: str, step, mode: str) -> DataFrame:
    from tessera.plans.staging import scratch
    from tessera.schemas import MESSAGE

    out = scratch(spark, "stream")
    # written as a pattern, which a stream takes for a file and for a folder alike
    source = deltas.watched(spark, f"{sf_dir}/[c]onversations.parquet", MESSAGE)
    rows = source.select("conv_id", "turn", "role") if step is None else step(source.select(F.col("conv_id").cast("string").alias("stream_id"), F.col("turn").alias("seq"), F.col("text").alias("chunk")))
    write = lambda df, _: df.write.mode("overwrite" if step else "append").parquet(f"{out}/rows")
    deltas.relayed(rows, write, f"{out}/checkpoint", mode).awaitTermination()
    return spark.read.parquet(f"{out}/rows")
