import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import hard_negatives, phrases, toxicity

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_phrases(docs, least, longest=5, top=2000):
    f, n = defaultdict(Counter), Counter()
    for r in docs:
        lang = "und" if r.lang is None else r.lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (r.text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        gone = {q[i : i + k] for q, b in found.items() for k in range(2, len(q)) for i in range(len(q) - k + 1) if 100 * b >= 100 * c[q[i : i + k]]}
        rows = []
        for p, a in found.items():
            if p not in gone:
                score, _, left, right = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return out


@pytest.mark.parametrize("least", [2, 20])
def test_phrases_equal_brute_force(docs, least):
    got = [tuple(r) for r in phrases.collocations(docs, least).collect()]
    assert Counter(got) == Counter(brute_phrases(docs.collect(), least))


def test_phrases_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SPLIT_BYTES", 40)
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("a B c d,e é\tf ,g. h\x1ci \x0b".split(" ")) for _ in range(rng.randrange(60))), rng.choice([None, "und", "en"])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    for top in (2000, 7):
        got = [tuple(r) for r in phrases.collocations(docs, 3, 4, top).collect()]
        assert Counter(got) == Counter(brute_phrases(docs.collect(), 3, 4, top)) and got
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    scores = spark.range(5000).select(F.lit("en").alias("lang"), (F.col("id") % 700).alias("score"), F.lit(1).alias("a"), F.col("id").cast("string").alias("phrase"))
    monkeypatch.setattr(phrases, "RANK_BUCKET", 300)
    assert sorted(map(tuple, phrases.first_of(scores, order, 40, 5000).collect())) == sorted(map(tuple, phrases.first_of(scores, order, 40, 1).collect()))


def test_a_block_of_lists_round_trips():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 9, 50)
    at = np.concatenate([np.sort(rng.choice(10_000, n, False)) for n in lengths])
    assert (phrases.unpacked(phrases.packed(at, lengths), lengths) == at).all()
    assert len(phrases.unpacked(b"", np.empty(0, int))) == 0


def test_scores_pass_64_bits(spark):
    big = 4_000_000_000_000_000
    found = spark.createDataFrame([("en", "a b", big, [big], [big + 7])], "lang string, phrase string, a long, before array<long>, after array<long>")
    totals = spark.createDataFrame([("en", 9 * big)], "lang string, n long")
    assert phrases.scored(found, totals).first().score == 1000 * big * 9 * big // (big * (big + 7))


def toxic_text(rng, toxic, n=40):
    mild = ["lorem", "ipsum", "dolor", "amet", "sit", "nunc", "vita", "sed"]
    return " ".join(rng.choice(["grubble", "skranx"]) + rng.choice(["o", "en", "ar"]) if toxic and rng.random() < 0.1 else rng.choice(mild) + rng.choice(mild) for _ in range(n))


def test_toxic_texts_are_told_from_others(spark):
    """Held-out accuracy; toxic words have ends that the training rows do not show."""
    rng = random.Random(3)
    rows = [(i, toxic_text(rng, i % 5 == 0, rng.randrange(30, 400)), int(i % 5 == 0)) for i in range(600)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r.toxicity for r in toxicity.scored(docs, labels).collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 100 and all((got[i] >= 0.3) == bool(y) for i, y in held)
    assert {r.doc_id for r in docs.where(toxicity.is_held_out(F.col("doc_id"))).collect()} == {i for i, _ in held}
    flipped = labels.withColumn("toxic", F.when(toxicity.is_held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r.doc_id: r.toxicity for r in toxicity.scored(docs, flipped).collect()} == got  # held-out labels are never read


def test_toxicity_of_edge_rows(spark, docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (6, 0), (7, 0), (7, None), (None, 1), (8, 1), (12, 0)], "doc_id long, toxic int")
    for y in (labels, labels.limit(0), labels.where("toxic = 0")):
        got = toxicity.scored(docs.drop("score"), y, name="score")
        assert got.columns == [*docs.drop("score").columns, "score"]
        rows = got.collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if not (r.text or "").strip()}) <= 1


def test_grams_by_hand():
    def brute(text):
        words, out = text.lower().split(), Counter()
        for w in words:
            w = f" {w} "
            for n in toxicity.LENGTHS:
                out.update(w[i : i + n] for i in range(len(w) - n + 1))
        return out

    text = "Ab ÀÉ😀 x  idiotic\tIDIOT b" + "c" * 50
    counts = sorted(Counter(np.concatenate(list(toxicity.grams(text)[0])).tolist()).values())
    assert counts == sorted(brute(text).values())
    whole, parts = list(toxicity.grams(text * 3)[0]), toxicity.CHARACTERS
    toxicity.CHARACTERS = 10
    try:
        assert sorted(np.concatenate(list(toxicity.grams(text * 3)[0])).tolist()) == sorted(np.concatenate(whole).tolist())
    finally:
        toxicity.CHARACTERS = parts


def test_regression_is_the_minimum():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(80, 4)), rng.integers(0, 2, 80).astype(float)
    of, columns = np.divmod(np.arange(320), 4)
    w, b = toxicity.regression(columns, of, x.ravel(), y, np.ones(80), 4)
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.abs(x.T @ (p - y) + toxicity.PENALTY * w).max() < 0.05 and abs((p - y).sum()) < 0.05


def brute_negatives(rows, step=50):
    def ok(v):
        return v is not None and all(x is not None and np.isfinite(x) for x in v)

    rows = sorted({(i, y, tuple(int(np.floor(256 * float(x))) for x in v)) for i, y, v in rows if i is not None and y is not None and ok(v)})
    out = set()
    for a, label, v in rows:
        if a % step:
            continue
        near = {(-sum(p * q for p, q in zip(v, w)), i, y) for i, y, w in rows if i != a and len(w) == len(v)}
        positives = sorted({(s, i) for s, i, y in near if y == label})[:5]
        for s, i in positives:
            fit = sorted({(t, j) for t, j, y in near if y != label and 50 * -s <= 100 * -t <= 95 * -s})[:3]
            out |= {(a, i, k, j, -s, -t) for k, (t, j) in enumerate(fit, 1)}
    return out


def mined(df, step=50):
    return {tuple(r) for r in hard_negatives.mined(hard_negatives.usable(df, F.col("label")), F.col("id") % step == 0).collect()}


SCHEMA = "vec_id long, label int, embedding array<float>"


@pytest.mark.parametrize("kind", ["spread", "near", "copies", "axis"])
def test_negatives_equal_brute_force(spark, kind, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ROW_SLICE", 64)
    monkeypatch.setattr(hard_negatives, "ANCHOR_SLICE", 5)
    rng = np.random.default_rng(len(kind))
    x = rng.normal(size=(400, 12))
    if kind == "near":
        x = rng.normal(size=12) + 0.2 * x
    if kind == "copies":
        x[::2] = x[0]
    if kind == "axis":
        x = x * 0.5 ** np.arange(12)
    rows = [(i, int(rng.integers(0, 4)), [float(np.float32(v)) for v in x[i]]) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert mined(df, 10) == brute_negatives(rows, 10)


def test_negatives_in_blocks_of_anchors(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 9)
    rng = np.random.default_rng(2)
    rows = [(i, int(rng.integers(0, 3)), [float(np.float32(v)) for v in rng.normal(size=5)]) for i in range(200)]
    assert mined(spark.createDataFrame(rows, SCHEMA), 5) == brute_negatives(rows, 5)


def test_negatives_of_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.5]), (0, 1, [1.0, 0.5]), (0, 2, [0.25, 0.5]), (1, 1, [1.0, 0.75]), (2, 1, [1.0, 0.75]), (3, 2, [0.75, 0.5]), (4, 2, [0.75, 0.5]), (4, 2, [0.75, 0.5]), (5, 3, [0.5, 0.5]), (6, 3, None), (7, None, [1.0, 1.0]),
            (None, 2, [0.75, 0.5]), (8, 2, [nan, 1.0]), (9, 2, [inf, 1.0]), (10, 2, [None, 1.0]), (11, 2, []), (50, 1, []), (12, 1, [1.0]), (13, 2, [0.8]), (100, 1, [0.9]), (150, 4, [1.0, 1.0]), (200, 5, [-1.0, -1.0]), (201, 5, [1.0, 1.0])]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("id", "v", "anchor", "slot", "rank", "score", "d")})
    assert mined(df) == brute_negatives(rows) and mined(df.limit(0)) == set()
    huge = spark.createDataFrame([(0, 1, [3e38, 1.0]), (50, 1, [1.0, 1.0]), (51, 1, [1.0, 1.0]), (52, 2, [0.8, 0.8])], SCHEMA)
    assert {r[0] for r in mined(huge)} == {50}


def test_pairs_are_dropped_early():
    """Where leading axes tell, few pairs reach the integer products."""
    rng = np.random.default_rng(4)
    x = np.floor(256 * rng.normal(size=(500, 32)) * 0.7 ** np.arange(32)).astype(np.int64)
    turn = np.linalg.eigh((x.T @ x).astype(float))[1][:, ::-1]
    both = hard_negatives.Rotated(x, turn)
    exact = x @ x.T
    low = np.sort(exact, 1)[:, -5].astype(float)
    i, j = hard_negatives.survivors(both, both, low)
    found = set(zip(i.tolist(), j.tolist()))
    assert {(a, b) for a, b in zip(*np.nonzero(exact >= low[:, None]))} <= found and len(found) < 2600
