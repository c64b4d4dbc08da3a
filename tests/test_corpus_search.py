"""The trigram index against the texts, and table-wide batches against one pass."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import token_batching, trigram_index
from tessera.sources import code

TEXTS = [(1, "aAaa"), (2, ""), (3, None), (4, "the cat, the THE end"), (5, "xthex the"), (None, "the"), (6, "é😀the😀"), (7, "ab"), (8, "a"), (9, "abcabcab"), (9, "zzabc"), (10, "the " * 5000)]


def spots(text, wanted):
    low, w = text.lower(), wanted.lower()
    return [i for i in range(len(low)) if w and low.startswith(w, i)]


def brute(wanted):
    out = {}
    for w in wanted:
        for key, text in TEXTS:
            if key is not None and text is not None and spots(text, w):
                out[w, key] = sorted({*out.get((w, key), []), *spots(text, w)})
    return out


WANTED = ["the", "THE", "a", "ab", "aa", "abcab", "cat, the", "😀", "é😀t", "zz", "q", "", "e", " ", "the the the "]


def test_places_are_those_of_the_texts(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("gram", "key", "at", "wanted")})
    index = trigram_index.build(docs)
    got = {(r.wanted, r.key): r.starts for r in trigram_index.found(index, WANTED).collect()}
    assert got == brute(WANTED)
    for r in trigram_index.counted(index, WANTED).collect():
        if r.key != 9:
            text = next(t for k, t in TEXTS if k == r.key).lower()
            assert (r.matches, r.first_at) == (text.count(r.wanted.lower()), text.index(r.wanted.lower()) + 1)
    assert trigram_index.found(index, []).count() == 0 == trigram_index.found(trigram_index.build(docs.limit(0)), ["the"]).count()


def test_few_trigrams_open_few_row_groups(spark, real_docs):
    index = trigram_index.build(real_docs)
    few = trigram_index.read(index, trigram_index.asked(spark, ["tion of"]))
    assert "PushedFilters: [In(gram" in few._jdf.queryExecution().toString() and few.count() < index.count() / 20
    everything = trigram_index.FILTERED
    trigram_index.FILTERED = 0
    try:
        unfiltered = {tuple(r) for r in trigram_index.counted(index, ["tion of", "er"]).collect()}
    finally:
        trigram_index.FILTERED = everything
    assert {tuple(r) for r in trigram_index.counted(index, ["tion of", "er"]).collect()} == unfiltered


def test_gaps_come_back():
    numbers = np.array([0, 1, 127, 128, 16_383, 16_384, (1 << 21) - 1, 1 << 21, (1 << 28) - 1, 1 << 28, (1 << 31) - 1, 0])
    data, ends = trigram_index.packed(numbers)
    assert trigram_index.unpacked(data).tolist() == numbers.tolist() and np.diff(ends, prepend=0).tolist() == [1, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 1]


@pytest.mark.parametrize("size", [1, 30, 200])
def test_places_are_the_same_in_blocks_of_any_size(spark, size, monkeypatch):
    monkeypatch.setattr(trigram_index, "BLOCK", size)
    index = trigram_index.build(spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(2))
    assert {(r.wanted, r.key): r.starts for r in trigram_index.found(index, WANTED).collect()} == brute(WANTED)


def test_rows_of_one_key_are_searched_each_by_itself(spark):
    index = trigram_index.build(spark.createDataFrame([(1, "abc.."), (1, "..cde"), (1, "-abcde")], "doc_id long, text string"))
    assert [tuple(r) for r in trigram_index.found(index, ["abcde"]).collect()] == [("abcde", 1, [1])]


def test_the_index_has_few_small_rows(spark, real_docs, tmp_path):
    letters = real_docs.select(F.sum(F.length("text"))).first()[0]
    index = trigram_index.build(real_docs, str(tmp_path / "index"))
    assert index.count() < letters / 20 and sum(f.stat().st_size for f in (tmp_path / "index").glob("*.parquet")) < 2.1 * letters


@pytest.fixture(scope="module")
def real_docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def one_pass(counts, limit):
    out, number, used = [], 0, 0
    for n in counts:
        if used + n > limit:
            number, used = number + 1, 0
        used += n
        out.append(number)
    return out


@pytest.mark.parametrize("run", [1, 16, 10_000])
def test_batches_are_those_of_one_pass(spark, run, monkeypatch):
    monkeypatch.setattr(token_batching, "RUN", run)
    rng = random.Random(run)
    mixed = [rng.choice([0, 0, 1, 2, 3, 9, 10, 11, 30]) for _ in range(120)]
    for counts in {1: [[11, 1], [0] * 9], 16: [mixed, [3, 20, 3, 10, 1] + [0] * 50], 10_000: [[], mixed]}[run]:
        df = spark.createDataFrame(list(enumerate(counts)), "i int, n int").withColumns({c: F.lit("clash") for c in ("at", "next", "run", "entry", "batch")})
        for parts in (1, 8) if run == 16 and counts is mixed else (3,):
            got = {r.i: r.batch for r in token_batching.batched(df.repartition(parts), ["i"], F.col("n"), 10).collect()}
            assert [got[i] for i in range(len(counts))] == one_pass(counts, 10)


@pytest.mark.parametrize("methods", [3, 49, 50, 51, 500])
def test_members_of_a_class_of_any_size(methods):
    body = "\n".join(f"  m{i}() {{ return {i}; }}" for i in range(methods))
    found = code.definitions_in(f"class K {{\n{body}\n  go = (a) => {{ return a; }};\n}}\nconst out = (b) => b;\n", ".ts")
    assert [(d["type"], d["name"]) for d in found if d["name"].endswith(("go", "out"))] == [("Method", "K.go"), ("Function", "out")]


def test_pieces_after_much_white_space():
    blanks = " " * 250
    pieces = code.top_level_parts(f"const a = 1 +{blanks}\n  2;\nfunction f() {{{blanks}\n  return 1;\n}}\nlet b\n{blanks}{blanks}.c = 2\n", ".js")
    assert any(p.startswith("const a") and p.endswith("2;") for p in pieces)
    assert any(p.startswith("let b") and p.endswith(".c = 2") for p in pieces)


def test_brackets_left_open_end_with_what_is_around_them():
    pairs = code.brackets("{ ( [ { ( }")
    assert pairs[0] == 11 or pairs[6] == 10
    assert code.brackets("( [ [ [ [ )")[0] == 10
