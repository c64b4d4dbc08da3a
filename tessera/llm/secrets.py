"""Secret scans with corpus-wide ownership frequency.

The base patterns give their spans whatever the corpus says. Beside them, other long tokens of mixed letters and digits and values
under further names are candidates. The values of all spans are hashed and counted by distinct owners and repositories over the whole
corpus: what more than LIVE_OWNERS owners or LIVE_REPOSITORIES repositories hold is a copied example; the rest looks live. A live
candidate is added as a span of kind ``live``, a copied one is not. Every span, base ones included, carries its class and counts.

Positions are code points; the end is exclusive. Null texts are empty. Null owners and repositories are values of their own.
Repeated rows are scanned each by itself and count as one owner. Texts are scanned once; what the scan finds is written. Any number of
spans in one text takes work about in proportion.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import before, let
from tessera.plans.staging import staged

#: The base patterns, and the characters that a match (``assign``: its second group) must have.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HEAD = r"""^[A-Za-z_]+["']?\x20*[:=]\x20*["']?"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
MIN_ASSIGN = 12
#: Further candidates: runs of these characters with a digit, a capital and a small letter; values of 12 characters or more with a digit
#: and a letter under these names.
MIXED = r"[A-Za-z0-9+/_-]{20,}"
NAMED = r"""([Pp][Ww][Dd]|[Pp][Aa][Ss][Ss][Pp][Hh][Rr][Aa][Ss][Ee]|[Cc][Rr][Ee][Dd][Ee][Nn][Tt][Ii][Aa][Ll]|[Bb][Ee][Aa][Rr][Ee][Rr]|(?:[Pp][Rr][Ii][Vv][Aa][Tt][Ee]|[Aa][Cc][Cc][Ee][Ss][Ss]|[Aa][Uu][Tt][Hh])_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{12,})"""
#: Distinct owners and repositories up to which a value looks live.
LIVE_OWNERS, LIVE_REPOSITORIES = 1, 4
KINDS = ("assign", "access", "hex", "live")
SPAN = "array<struct<start:int,stop:int,kind:int,value:string>>"


def _spans(text: Column, pattern: str, kind: int) -> Column:
    """All matches, leftmost and not overlapping, as structs with positions: what stands between them gives their places."""
    between, found = F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(gaps: Column, hits: Column) -> Column:
        steps = F.transform(hits, lambda x, k: F.length(x) + F.length(F.get(gaps, k)))
        starts = F.transform(before(steps, F.lit(0), lambda x, y: x + y), lambda at, k: at + F.length(F.get(gaps, k)))
        return let(starts, lambda at: F.transform(hits, lambda x, k: F.struct(F.get(at, k).alias("start"), (F.get(at, k) + F.length(x)).alias("stop"), F.lit(kind).alias("kind"), x.alias("value"))))

    hits = let(between, lambda gaps: let(found, lambda h: placed(gaps, h)))
    return F.when(text.rlike(pattern), hits).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    """Spans of the base patterns, by start, then kind as listed."""
    text = F.coalesce(text, F.lit(""))
    assign = F.filter(_spans(text, ASSIGN, 0), lambda s: F.length(F.regexp_replace(s["value"], ASSIGN_HEAD, "")) >= MIN_ASSIGN)
    return _in_order(F.concat(assign, _spans(text, ACCESS, 1), _spans(text, HEX, 2)))


def with_candidates(rows: DataFrame, text: str, base: str, name: str) -> DataFrame:
    """``rows`` with further candidates that no base span touches; a named value gives way to mixed runs."""
    content = F.coalesce(F.col(text), F.lit(""))
    has = lambda c, *patterns: functools.reduce(lambda x, y: x & y, (c.rlike(p) for p in patterns))
    mixed = F.filter(_spans(content, MIXED, 3), lambda s: has(s["value"], "[0-9]", "[A-Z]", "[a-z]"))
    named = F.filter(_spans(content, NAMED, 3), lambda s: has(F.regexp_replace(s["value"], ASSIGN_HEAD, ""), "[0-9]", "[A-Za-z]"))
    columns = rows.columns
    rows = apart(rows.withColumn("__ts_mixed", mixed), "__ts_mixed", base)
    rows = apart(apart(rows.withColumn("__ts_named", named), "__ts_named", base), "__ts_named", "__ts_mixed")
    return rows.select(*columns, F.concat("__ts_mixed", "__ts_named").alias(name))


def apart(rows: DataFrame, spans: str, others: str) -> DataFrame:
    """``rows`` whose ``spans`` are those that none of the others touches. In one order of starts, the furthest end before a span and the next
    start after it decide. Each step is a column, as their expressions are long."""
    marked = lambda c, other: F.transform(c, lambda s: F.struct(s["start"].alias("start"), F.lit(other).alias("other"), s["stop"].alias("stop"), s["kind"].alias("kind"), s["value"].alias("value")))
    columns, far, none = rows.columns, F.lit(2**31 - 1), F.slice(F.array(F.lit(0)), 1, 0)
    meet = (F.size(spans) > 0) & (F.size(others) > 0)
    rows = rows.withColumn("__ts_all", F.when(meet, F.sort_array(F.concat(marked(spans, 1), marked(others, 0)))))
    of_others = lambda field, else_: F.transform("__ts_all", lambda s: F.when(s["other"] == 0, s[field]).otherwise(else_))
    rows = rows.withColumn("__ts_ends", F.when(meet, before(of_others("stop", 0), F.lit(0), F.greatest)).otherwise(none))
    rows = rows.withColumn("__ts_nexts", F.when(meet, F.reverse(before(F.reverse(of_others("start", far)), far, F.least))).otherwise(none))
    alone = lambda e, n: F.filter("__ts_all", lambda s, k: (s["other"] == 1) & (F.get(e, k) <= s["start"]) & (F.get(n, k) >= s["stop"]))
    kept = let(F.struct(F.col("__ts_ends").alias("e"), F.col("__ts_nexts").alias("n")), lambda x: alone(x["e"], x["n"]))
    kept = F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"), s["value"].alias("value")))
    return rows.withColumn(spans, F.when(meet, kept).otherwise(F.col(spans))).select(*columns)


def _in_order(spans: Column) -> Column:
    keyed = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"), s["value"].alias("value"))))
    return F.transform(keyed, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"), s["value"].alias("value")))


def secret_hash(span: Column) -> Column:
    """Of the secret itself: a value without its name."""
    return F.sha2(F.regexp_replace(span["value"], ASSIGN_HEAD, ""), 256)


def ownership(found: DataFrame) -> DataFrame:
    """Rows (secret, n_owners, n_repositories) from rows (secret, owner, repository): distinct pairs first, so that a value
    that everyone copies is small before it meets."""
    pairs = found.groupBy("secret", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    owners = pairs.groupBy("secret", "owner").agg(F.count(F.lit(1)).alias("repositories"))
    return owners.groupBy("secret").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repositories").alias("n_repositories"))


def spotted(docs: DataFrame, keep: list[str], owner: str, repository: list[str], text: str) -> DataFrame:
    """Columns ``keep``, then __ts_row, __ts_owner, __ts_repository, __ts_base and __ts_more (candidates), written once."""
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    rows = docs.select(*keep, key(owner).alias("__ts_owner"), F.concat_ws("\x1f", *(key(c) for c in repository)).alias("__ts_repository"), base_spans(F.col(text)).alias("__ts_base"), F.col(text).alias("__ts_text"))
    rows = with_candidates(rows, "__ts_text", "__ts_base", "__ts_more").drop("__ts_text")
    return staged(rows.withColumn("__ts_row", F.monotonically_increasing_id()), "candidates")


def classed(rows: DataFrame, live_owners: int = LIVE_OWNERS, live_repositories: int = LIVE_REPOSITORIES) -> DataFrame:
    """Rows (__ts_of, __ts_spans) of spotted() rows with spans: base and live ones in order, each with its class and counts."""
    each = rows.select("__ts_row", F.col("__ts_owner").alias("owner"), F.col("__ts_repository").alias("repository"), F.explode(F.concat("__ts_base", "__ts_more")).alias("s")).withColumn("secret", secret_hash(F.col("s")))
    owned = ownership(each.select("secret", "owner", "repository"))
    live = (F.col("n_owners") <= live_owners) & (F.col("n_repositories") <= live_repositories)
    told = each.join(owned, "secret").where(live | (F.col("s.kind") < 3)).select("__ts_row", "s", live.alias("live"), "n_owners", "n_repositories")
    return told.groupBy(F.col("__ts_row").alias("__ts_of")).agg(F.sort_array(F.collect_list(F.struct("s.start", "s.kind", "s.stop", "s.value", "live", "n_owners", "n_repositories"))).alias("__ts_spans"))


def scanned(docs: DataFrame, keep: list[str], owner: str = "source", repository: list[str] = ("source", "lang"), text: str = "text") -> DataFrame:
    """Columns ``keep``, then __ts_base (base spans) and __ts_spans (all spans with their class), one row for each of ``docs``."""
    rows = spotted(docs, keep, owner, repository, text)
    found = classed(rows)
    out = rows.join(found, rows["__ts_row"] == found["__ts_of"], "left")
    empty = F.array().cast("array<struct<start:int,kind:int,stop:int,value:string,live:boolean,n_owners:bigint,n_repositories:bigint>>")
    return out.select(*keep, "__ts_base", F.coalesce("__ts_spans", empty).alias("__ts_spans"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def with_masks(rows: DataFrame, text: str, spans: str, name: str, mask: str = "[SECRET]") -> DataFrame:
    """``rows`` with the text in which each stretch of touching or overlapping spans is replaced. A span that begins after all ends before it begins a
    stretch, and ends the one before. The text is taken apart in about sqrt(n) parts first, as a cut reads all that is before it in its part."""
    columns = [c for c in rows.columns if c != name]
    some = F.size(spans) > 0
    rows = rows.withColumn("__ts_ends", F.when(some, before(F.transform(spans, lambda s: s["stop"]), F.lit(-1), F.greatest)))
    begins = let(F.col("__ts_ends"), lambda e: F.filter(F.transform(spans, lambda s, k: F.struct(s["start"].alias("start"), F.get(e, k).alias("end"))), lambda s: s["end"] < s["start"]))
    rows = rows.withColumn("__ts_begins", begins).withColumn("__ts_last", F.array_max(F.transform(spans, lambda s: s["stop"])))
    known = F.struct(F.col("__ts_begins").alias("b"), F.col("__ts_last").alias("last"), F.length(text).alias("size"))
    rows = rows.withColumn("__ts_cuts", let(known, lambda x: F.transform(x["b"], lambda s, k: F.struct(s["start"].alias("start"), F.coalesce(F.get(x["b"], k + 1)["end"], x["last"]).alias("stop"), F.coalesce(F.get(x["b"], k + 1)["start"], x["size"]).alias("next")))))
    share = lambda c: F.ceil(F.sqrt(F.size(c))).cast("int")
    dealt = lambda c: F.transform(F.sequence(F.lit(0), F.floor((F.size(c) - 1) / share(c)).cast("int")), lambda k: F.slice(c, k * share(c) + 1, share(c)))
    rows = rows.withColumn("__ts_parts", F.when(some, let(F.col("__ts_cuts"), dealt)))
    whole = lambda own: F.substring(text, F.get(own, 0)["start"] + 1, F.element_at(own, -1)["next"] - F.get(own, 0)["start"])
    rows = rows.withColumn("__ts_parts", F.transform("__ts_parts", lambda own: F.struct(own.alias("cuts"), F.get(own, 0)["start"].alias("first"), whole(own).alias("whole"))))
    cut = lambda p: F.array_join(F.transform(p["cuts"], lambda s: F.concat(F.lit(mask), F.substring(p["whole"], s["stop"] - p["first"] + 1, s["next"] - s["stop"]))), "")
    new = F.concat(F.substring(text, F.lit(1), F.get("__ts_cuts", 0)["start"]), F.array_join(F.transform("__ts_parts", cut), ""))
    return rows.withColumn(name, F.when(some, new).otherwise(F.col(text))).select(*columns, name)


def redacted(docs: DataFrame, owner: str = "source", repository: list[str] = ("source", "lang"), text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span masked; ``n_chars`` then has the new length of changed texts. Texts without candidates are never
    shuffled."""
    columns = docs.columns
    rows = spotted(docs, columns, owner, repository, text)
    touched = (F.size("__ts_base") > 0) | (F.size("__ts_more") > 0)
    found = classed(rows.where(touched))
    out = rows.where(touched).join(found, F.col("__ts_row") == F.col("__ts_of"), "left")
    out = with_masks(out, text, "__ts_spans", "__ts_new")
    if n_chars in columns:
        out = out.withColumn(n_chars, F.when(F.col("__ts_spans").isNotNull(), F.length("__ts_new").cast(docs.schema[n_chars].dataType)).otherwise(F.col(n_chars)))
    return rows.where(~touched).select(*columns).unionByName(out.withColumn(text, F.col("__ts_new")).select(*columns))
