"""Preference formatting: the common prompt of a chosen and a rejected conversation, and their masked completions.

Turns are first reduced to hashes of role and text: these meet by (pair, turn), and the first turn at which they differ, or one side
has none, ends the common prefix. What stands before is rendered once as prompt, what follows is each side's completion. Then every text
meets its fate in one join on (pair, turn), so texts are shuffled once and no long conversation is a hot key. Only what an assistant
says in a completion is to be learned: [mask_from, mask_to) are its code points in the rendered segment.

formatted() gives one row for each segment, so that a conversation of any length is never gathered into one row; paired() gathers
each pair that differs into one row of prompt and completions, for pairs that fit one. Null pairs and turns are no turns. Null roles and
texts are rendered as empty and are equal to each other. Of rows that repeat a turn, the one with the smallest hash counts. Pairs
whose sides are equal have a prompt only. The two texts of a turn are compared by 63 bits of XXH64.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.staging import staged

#: How a turn is written.
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
CHOSEN, REJECTED = 0, 1


def _said(turns: DataFrame) -> DataFrame:
    """Rows (pair, turn, hash, role, text). A hash is odd where an assistant speaks."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    told = turns.where("pair is not null and turn is not null").select("pair", "turn", role.alias("role"), text.alias("text"))
    return told.withColumn("hash", F.xxhash64("role", "text").bitwiseAND(F.lit(-2)).bitwiseOR((F.col("role") == "assistant").cast("long")))


def _light(turns: DataFrame) -> DataFrame:
    """Rows (pair, turn, hash): what is said at each turn, without its text."""
    return _said(turns).groupBy("pair", "turn").agg(F.min("hash").alias("hash"))


def _use(side: int, turn: Column) -> Column:
    return F.struct(F.lit(side).alias("side"), turn.alias("at"))


def _segments(stored: DataFrame, uses: DataFrame, key: list[str]) -> DataFrame:
    """Rendered segments. ``stored``: _said() rows; ``uses``: rows (key, hash, side, at) of what each of them stands for."""
    uses = staged(uses, "uses")
    said = lambda side: F.max(F.when(F.col("side") == side, F.col("hash")))
    by_turn = uses.groupBy("pair", "at").agg(said(CHOSEN).alias("chosen"), said(REJECTED).alias("rejected"))
    parting = by_turn.where(~F.col("chosen").eqNullSafe(F.col("rejected"))).groupBy(F.col("pair").alias("of")).agg(F.min("at").alias("parting"))
    common = F.col("parting").isNull() | (F.col("at") < F.col("parting"))
    part = F.when(F.col("side") == CHOSEN, F.when(common, "prompt").otherwise("chosen")).when(~common, "rejected")
    told = uses.join(parting, uses["pair"] == parting["of"], "left").select(*(uses[c].alias(f"f_{c}") for c in key), part.alias("part"), "at").where("part is not null")
    texts = stored.groupBy(*key).agg(F.min(F.struct("hash", "role", "text")).alias("s"))
    met = texts.join(told, [texts[c] == told[f"f_{c}"] for c in key])
    rows = met.select("pair", "s.role", "s.text", "part", "at")
    head = F.concat(F.lit(OPEN), F.col("role"), F.lit(MIDDLE))
    learned = (F.col("part") != "prompt") & (F.col("role") == "assistant")
    return rows.select(
        "pair", "part", F.col("at").alias("turn"), "role", F.concat(head, F.col("text"), F.lit(CLOSE)).alias("rendered"),
        F.when(learned, F.length(head)).otherwise(0).alias("mask_from"), F.when(learned, F.length(head) + F.length("text")).otherwise(0).alias("mask_to"),
    )


def formatted(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """From turns (pair, turn, role, text) of both sides: rows (pair, part, turn, role, rendered, mask_from, mask_to)."""
    sides = ((chosen, CHOSEN), (rejected, REJECTED))
    uses = [_light(turns).withColumns({"store": F.lit(side), "side": F.lit(side), "at": F.col("turn")}) for turns, side in sides]
    stored = [_said(turns).withColumn("store", F.lit(side)) for turns, side in sides]
    return _segments(stored[0].unionByName(stored[1]), uses[0].unionByName(uses[1]), ["pair", "store", "turn"])


def self_formatted(turns: DataFrame) -> DataFrame:
    """formatted() for conversations without a rejected side: there the last answer is replaced by the first one, or missing if it is the
    only one. Each text still moves once."""
    light = _light(turns)
    answers = light.where(F.col("hash").bitwiseAND(F.lit(1)) == 1).groupBy(F.col("pair").alias("of")).agg(F.min("turn").alias("first"), F.max("turn").alias("last"))
    known = light.join(answers, light["pair"] == answers["of"], "left")
    turn, first, last = F.col("turn"), F.col("first"), F.col("last")
    uses = F.array(_use(CHOSEN, turn), F.when(last.isNull() | (turn != last), _use(REJECTED, turn)), F.when((turn == first) & (first < last), _use(REJECTED, last)))
    used = known.select("pair", "turn", "hash", F.inline(F.filter(uses, lambda u: u.isNotNull())))
    return _segments(_said(turns), used, ["pair", "turn"])


def paired(segments: DataFrame) -> DataFrame:
    """Rows (pair, prompt, chosen, rejected, chosen_masks, rejected_masks), one for each pair whose sides differ; masks are ranges of
    code points in the completion's text. A pair is gathered here: its texts must fit one row."""
    rows = segments.groupBy("pair").agg(F.array_sort(F.collect_list(F.struct("turn", "part", "rendered", "mask_from", "mask_to"))).alias("all"))

    def joined(part: str) -> Column:
        return F.array_join(F.transform(F.filter("all", lambda s: s["part"] == part), lambda s: s["rendered"]), "")

    def masks(part: str) -> Column:
        state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("out"))
        step = lambda acc, s: F.struct((acc["at"] + F.length(s["rendered"])).alias("at"), F.when(s["mask_to"] > s["mask_from"], F.concat(acc["out"], F.array(F.struct((acc["at"] + s["mask_from"]).alias("start"), (acc["at"] + s["mask_to"]).alias("stop"))))).otherwise(acc["out"]).alias("out"))
        return F.aggregate(F.filter("all", lambda s: s["part"] == part), state, step)["out"]

    return rows.where(F.exists("all", lambda s: s["part"] != "prompt")).select("pair", joined("prompt").alias("prompt"), joined("chosen").alias("chosen"), joined("rejected").alias("rejected"), masks("chosen").alias("chosen_masks"), masks("rejected").alias("rejected_masks"))
