"""From a question and its conversation to a prompt and an answer with sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.models import echo, letter_vector
from tessera.functions.text import sanitised_question, without_newlines
from tessera.functions.tokens import CHARACTER_LIMIT, MODEL_LIMITS, RESERVE, approximate_tokens
from tessera.operators.vector_index import DEFAULT_K, MAX_DISTANCE, FlatIndex

MEMORY = 10
NOTHING_FOUND = "No matching context was found."


def history(pairs: DataFrame, conversation: str = "conv_id", order: str = "turn", question: str = "question", answer: str = "answer") -> DataFrame:
    """One row (conversation, history): each exchange as two labelled lines, in order."""
    turn = F.concat(F.lit("Human: "), F.coalesce(F.col(question), F.lit("")), F.lit("\nAssistant: "), F.coalesce(F.col(answer), F.lit("")))
    return pairs.groupBy(conversation).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), turn.alias("t")))), lambda x: x["t"]), "\n").alias("history"))


def exchanges(messages: DataFrame, conversation: str = "conv_id", order: str = "turn") -> DataFrame:
    """User messages that an assistant's follows at once: rows (conversation, turn, question, answer)."""
    w = Window.partitionBy(conversation).orderBy(order)
    return messages.withColumn("__ts_role", F.lead("role").over(w)).withColumn("__ts_text", F.lead("text").over(w)).where("role = 'user' and __ts_role = 'assistant'").select(conversation, order, F.col("text").alias("question"), F.col("__ts_text").alias("answer"))


def role_pairs(messages: DataFrame, conversation: str = "conv_id", order: str = "turn") -> DataFrame:
    """Messages as an alternating sequence that ends with the user's: exchanges stay, and the last message if it is the user's.
    If that leaves an even number, an empty user message is put before. Rows (conversation, place, role, text), place from 0."""
    w = Window.partitionBy(conversation).orderBy(order)
    after, before = F.lead("role").over(w), F.lag("role").over(w)
    kept = messages.withColumn("__ts_next", after).withColumn("__ts_before", before)
    kept = kept.where("(role = 'user' and (__ts_next = 'assistant' or __ts_next is null)) or (role = 'assistant' and __ts_before = 'user')")
    n, at = F.count(F.lit(1)).over(Window.partitionBy(conversation)), F.row_number().over(w)
    kept = kept.withColumn("__ts_n", n).withColumn("__ts_at", at)
    empty = F.struct(F.lit(0).cast("long").alias("place"), F.lit("user").alias("role"), F.lit("").alias("text"))
    own = F.struct((F.col("__ts_at") - F.col("__ts_n") % 2).cast("long").alias("place"), F.col("role"), F.col("text"))
    rows = F.when((F.col("__ts_at") == 1) & (F.col("__ts_n") % 2 == 0), F.array(empty, own)).otherwise(F.array(own))
    return kept.select(conversation, F.inline(rows))


def last_messages(messages: DataFrame, n: int = MEMORY, conversation: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last n of each conversation; equal times keep people before the assistant."""
    late = Window.partitionBy(conversation).orderBy(F.desc(order), F.when(F.col("role") == "user", 1).otherwise(0))
    return messages.withColumn("__ts_late", F.row_number().over(late)).where(F.col("__ts_late") <= n).drop("__ts_late")


def condense_prompt(history_text: Column, question: Column) -> Column:
    return F.concat(F.lit("Rewrite the follow-up as a question that stands alone.\n\n<history>\n"), history_text, F.lit("\n</history>\n\nFollow-up: "), question, F.lit("\nQuestion:"))


def answer_prompt(context: Column, history_text: Column, question: Column) -> Column:
    return F.concat(F.lit("Answer from the context only; say so if it does not hold the answer.\n\n<context>"), context, F.lit("\n</context>\n\n<history>\n"), history_text, F.lit("\n</history>\n\nQuestion: "), question, F.lit("\nAnswer in markdown:"))


def comment_prompt(code: Column) -> Column:
    """Asks for comments on a function."""
    return F.concat(F.lit("Explain this code and return it with comments:\n\n"), code)


def standalone_question(question: Column, history_text: Column, model: Callable[[Column], Column] = echo) -> Column:
    """The question as it is while there is no history, else what the model makes of both."""
    past = F.coalesce(history_text, F.lit(""))
    return F.when(past == "", question).otherwise(model(condense_prompt(past, question)))


def packed_context(found: DataFrame, question: str, rank: str, content: str, limit: Column | int, counter: Callable[[Column], Column] = approximate_tokens) -> DataFrame:
    """One row (question, context, n_sources): contents by rank while their summed tokens stay strictly below ``limit``, each after
    a line break. The first that does not fit ends it, though a later one might. Groups are as small as the search's k."""
    upto = Window.partitionBy(question).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    fit = found.withColumn("__ts_sum", F.sum(counter(F.col(content))).over(upto)).withColumn("__ts_fits", F.col("__ts_sum") < limit)
    parts = F.sort_array(F.collect_list(F.when(F.col("__ts_fits"), F.struct(F.col(rank).alias("r"), F.col(content).alias("c")))))
    return fit.groupBy(question).agg(F.array_join(F.transform(parts, lambda x: F.concat(F.lit("\n"), x["c"])), "").alias("context"), F.count_if("__ts_fits").alias("n_sources"))


def cut_context(found: DataFrame, question: str, rank: str, content: str, limit: int = CHARACTER_LIMIT) -> DataFrame:
    """One row (question, context): contents joined by line breaks and cut to ``limit`` characters."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(content).alias("c")))), lambda x: x["c"])
    return found.groupBy(question).agg(F.substring(F.array_join(parts, "\n"), 1, limit).alias("context"))


def budget(model: str) -> int:
    """Tokens for context: the model's window less a reserve. An unknown model has -1, so nothing fits."""
    return MODEL_LIMITS.get(model, -1) - RESERVE


def answered(questions: DataFrame, store: DataFrame, model_name: str = "gpt-3.5-turbo", k: int = DEFAULT_K, max_distance: float = MAX_DISTANCE, embed: Callable[[Column], Column] = letter_vector, model: Callable[[Column], Column] = echo, vec_id: str = "vec_id", content: str = "page_content") -> DataFrame:
    """Answers to questions (query_id, question, history) from a store of vectors ``embedding`` with contents.

    The standalone question is searched and answered; the k nearest are found first and filtered by distance then. Rows (query_id,
    question, standalone, sources, answer, prompt); without sources the answer says so.
    """
    asked = questions.withColumn("question", sanitised_question(F.col("question"))).withColumn("history", F.coalesce("history", F.lit("")))
    asked = asked.withColumn("standalone", standalone_question(F.col("question"), F.col("history"), model))
    vectors = asked.select("query_id", embed(without_newlines(F.col("standalone"))).alias("embedding"))
    near = FlatIndex(store, vec_id=vec_id).search_batch(vectors, k).where(F.col("distance") < max_distance)
    texts = store.select(F.col(vec_id).alias("vec_id"), F.col(content).alias("content"))
    found = texts.join(F.broadcast(near), "vec_id") if k * vectors.count() <= 100_000 else texts.join(near, "vec_id")
    context = packed_context(found, "query_id", "rank", "content", budget(model_name)).join(near.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "vec_id"))), lambda x: x["vec_id"].cast("string")), ",").alias("sources")), "query_id")
    out = asked.join(context, "query_id", "left").withColumn("prompt", F.when(F.col("sources").isNotNull(), answer_prompt(F.col("context"), F.col("history"), F.col("standalone"))))
    return out.select("query_id", "question", "standalone", F.coalesce("sources", F.lit("")).alias("sources"), F.coalesce(model(F.col("prompt")), F.lit(NOTHING_FOUND)).alias("answer"), "prompt")
