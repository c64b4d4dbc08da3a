"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Each document's ratios (in ten-thousandths, integers) are counted in buckets that keep a number's ten leading bits: sketches
whose merge is a sum, whose ranks are exact and values off by a 512th part at most, and which do not depend on order, tasks or
attempts. There is one sketch for each language, source and measure; a language and source of under MIN_DOCS documents takes
its language's, merged, and a language of so few takes everything's. With so few in all, only the base rule judges.

A ratio may be SPREAD narrower quarters (median to lower or upper quartile) from its group's median, so that junk cannot widen
the bounds until it is a quarter of the group. Ratios of few words scatter more by chance: the distance grows with the square root
of the group's median number of words over the document's own. A source is not judged more strictly than its language's usual one (the
median of the sources' quarters), since copies may fill half of a source; a ratio without any spread judges nothing. No cutoff is fixed.

Documents then meet the thresholds of their group in a join: broadcast if their counted rows are few, else shuffled. Null texts have
no words and fail the base rule; null languages and sources are groups of their own. Repeated rows count each time. Windows of words
are compared by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.words import let, words_of
from tessera.plans.staging import staged

#: Ratios, in ten-thousandths: characters a word; ASCII marks a character of a word; words of up to three characters.
RATIOS = ("word_length", "marks", "short_words")
#: ASCII marks, and those that count as symbols.
MARKS, SYMBOLS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", "#*$%&|<>"
MIN_DOCS, SPREAD, WINDOW, SHORT, SCALE, BITS = 200, 10, 5, 3, 10_000, 10
#: Rows of thresholds up to which they are broadcast.
BROADCAST_ROWS = 100_000
MIN_WORDS, MAX_REPEATED = 10, 20


def _repeated(hashes: Column) -> Column:
    """Words inside windows that occur twice or more."""
    windows = F.when(F.size(hashes) < WINDOW, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(WINDOW))))
    )

    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda n, x: n + x)

    def double(ordered: Column) -> Column:
        same = F.filter(ordered, lambda e, k: F.coalesce(F.get(ordered, k - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(ordered, k + 1)["h"] == e["h"], F.lit(False)))
        return let(F.sort_array(F.transform(same, lambda e: e["i"])), covered)

    return let(
        windows,
        lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(let(F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), double)),
    )


def measures(text: Column) -> Column:
    """struct(n_words, word_chars, n_short, n_repeat_words, n_dup_lines, n_symbols, n_marks) of a text."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    by_words = let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda n, x: n + F.length(x)).alias("word_chars"),
            F.aggregate(w, F.lit(0).cast("long"), lambda n, x: n + (F.length(x) <= SHORT).cast("int")).alias("n_short"),
            let(F.transform(w, lambda x: F.xxhash64(x)), _repeated).cast("long").alias("n_repeat_words"),
        ),
    )
    without = lambda characters: (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")
    return F.struct(by_words.alias("w"), let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), without(SYMBOLS).alias("n_symbols"), without(MARKS).alias("n_marks"))


def measured(docs: DataFrame, keep: list[str], lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """Columns ``keep``, then __ts_raw (measures), __ts_m (words and ratios), __ts_base (the base verdict), and the group's keys
    __ts_lang, __ts_source (never null). Measures are written, so that each text is measured once whatever reads them."""
    key = lambda c: F.coalesce(F.concat(F.lit("="), docs[c].cast("string")), F.lit(""))
    rows = staged(docs.select(*(docs[c] for c in keep), measures(docs[text]).alias("__ts_raw"), key(lang).alias("__ts_lang"), key(source).alias("__ts_source")), "measures")
    raw = F.col("__ts_raw")
    n, chars, short, repeats = (raw["w"][c] for c in ("n_words", "word_chars", "n_short", "n_repeat_words"))
    share = lambda part, whole: F.floor(part * SCALE / F.greatest(whole, F.lit(1))).cast("long")
    ratios = F.struct(n.alias("words"), share(chars, n).alias("word_length"), share(raw["n_marks"], chars).alias("marks"), share(short, n).alias("short_words"))
    return rows.withColumns({"__ts_m": ratios, "__ts_base": (n < MIN_WORDS) | (100 * repeats > MAX_REPEATED * n)})


def bucket(value: Column, bits: int) -> Column:
    """A number with so many leading bits only."""
    drop = F.greatest(F.length(F.bin(value)) - bits, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def sketches(rows: DataFrame) -> DataFrame:
    """Rows (__ts_lang, __ts_source, measure, bucket, n): one sketch for each language, source and measure."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("measure"), bucket(F.col(f"__ts_m.{k}"), BITS).alias("bucket")) for k in ("words", *RATIOS))))
    return rows.select("__ts_lang", "__ts_source", each.alias("e")).groupBy("__ts_lang", "__ts_source", "e.measure", "e.bucket").agg(F.count(F.lit(1)).alias("n"))


def _quartiles(sketch: DataFrame, keys: list[str], name: str) -> DataFrame:
    """One row for each key: documents, and a map of each measure's median and narrower quarter."""
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    order = Window.partitionBy(*keys, "measure")  # the buckets of one sketch: their number is bounded
    merged = merged.withColumn("all", F.sum("n").over(order)).withColumn("upto", F.sum("n").over(order.orderBy("bucket")))
    quantile = lambda k: F.min(F.when(4 * F.col("upto") >= k * F.col("all"), F.col("bucket")))
    found = merged.groupBy(*keys, "measure").agg(F.max("all").alias("docs"), *(quantile(k).alias(f"q{k}") for k in (1, 2, 3)))
    middle = F.struct(F.col("q2").alias("median"), F.least(F.col("q3") - F.col("q2"), F.col("q2") - F.col("q1")).alias("quarter"))
    return found.select(*keys, "docs", "measure", middle.alias("middle")).groupBy(*keys).agg(F.max("docs").alias(f"{name}_docs"), F.map_from_entries(F.collect_list(F.struct("measure", "middle"))).alias(name))


def thresholds(sketch: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Rows (__ts_t_lang, __ts_t_source, __ts_limits): struct of the median number of words and each ratio's (median, reach), from the
    narrowest group with enough documents; null if there is none."""
    own, lang = _quartiles(sketch, ["__ts_lang", "__ts_source"], "own"), _quartiles(sketch, ["__ts_lang"], "by_lang")
    every = _quartiles(sketch.withColumn("__ts_all", F.lit(1)), ["__ts_all"], "by_all").first()  # one row
    by_all = F.lit(None)
    if every is not None:
        by_all = F.when(F.lit(every.by_all_docs >= min_docs), F.create_map(*(c for k, x in every.by_all.items() for c in (F.lit(k), F.struct(F.lit(x.median).cast("long").alias("median"), F.lit(x.quarter).cast("long").alias("quarter"))))))
    usual = lambda k: F.expr(f"percentile_disc(0.5) within group (order by own['{k}'].quarter desc)").cast("long").alias(k)
    usual_source = own.where(F.col("own_docs") >= min_docs).groupBy(F.col("__ts_lang").alias("of")).agg(F.struct(*(usual(k) for k in RATIOS)).alias("usual"))
    joined = own.join(lang, "__ts_lang").join(usual_source, F.col("__ts_lang") == F.col("of"), "left")
    group = F.when(F.col("own_docs") >= min_docs, F.col("own")).when(F.col("by_lang_docs") >= min_docs, F.col("by_lang")).otherwise(by_all)
    joined = joined.select(F.col("__ts_lang").alias("__ts_t_lang"), F.col("__ts_source").alias("__ts_t_source"), group.alias("g"), "usual")
    reach = lambda k: (SPREAD * F.greatest(F.col("g")[k]["quarter"], F.col("usual")[k])).cast("long")
    limits = F.struct(F.col("g")["words"]["median"].alias("words"), *(F.struct(F.col("g")[k]["median"].alias("median"), reach(k).alias("reach")).alias(k) for k in RATIOS))
    return joined.select("__ts_t_lang", "__ts_t_source", F.when(F.col("g").isNotNull(), limits).alias("__ts_limits"))


def judged(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """``rows`` with __ts_kept: the base rule holds, and every ratio is as near to its group's median as the group allows."""
    limits = staged(limits, "thresholds")
    if limits.count() <= BROADCAST_ROWS:
        limits = F.broadcast(limits)
    joined = rows.join(limits, (rows["__ts_lang"] == limits["__ts_t_lang"]) & (rows["__ts_source"] == limits["__ts_t_source"]), "left")
    inside, words = F.lit(True), F.col("__ts_m.words")
    for k in RATIOS:
        limit = F.col("__ts_limits")[k]
        off, reach = (F.col(f"__ts_m.{k}") - limit["median"]).cast("double"), limit["reach"].cast("double")
        inside = inside & F.coalesce((reach == 0) | (off * off * words <= reach * reach * F.greatest(words, F.col("__ts_limits.words"))), F.lit(True))
    return joined.withColumn("__ts_kept", ~F.col("__ts_base") & inside).drop("__ts_t_lang", "__ts_t_source", "__ts_limits")


def verdicts(docs: DataFrame, doc_id: str = "doc_id", lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """Rows (doc_id, measures, base_failed, kept), one for each row of ``docs``."""
    named = docs.select(docs[doc_id].alias("doc_id"), docs[lang].alias("lang"), docs[source].alias("source"), docs[text].alias("text"))
    rows = measured(named, ["doc_id"])
    raw = F.col("__ts_raw")
    numbers = [raw["w"][c].alias(c) if c in ("n_words", "word_chars", "n_repeat_words") else raw[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return judged(rows, thresholds(sketches(rows))).select("doc_id", *numbers, F.col("__ts_base").alias("base_failed"), F.col("__ts_kept").alias("kept"))


def filtered(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept. The rows are written once with their measures, and read again to be judged."""
    rows = measured(docs, docs.columns, lang, source, text)
    return judged(rows, thresholds(sketches(rows))).where("__ts_kept").select(*docs.columns)
