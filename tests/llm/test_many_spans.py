"""Secret scans of texts with very many spans."""

import random

from test_documents import brute_candidates, brute_spans
from tests_llm_brute import masked

from tessera.llm import secrets
from tessera.llm.words import before
from pyspark.sql import functions as F


def test_folds_before_each_entry(spark):
    rows = [([],), ([5],), (list(range(10)),), ([3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5],), (list(range(1000)),)]
    df = spark.createDataFrame(rows, "v array<int>")
    for r in df.select("v", before(F.col("v"), F.lit(0), lambda x, y: x + y).alias("sums"), before(F.col("v"), F.lit(-1), F.greatest).alias("most")).collect():
        assert r.sums == [sum(r.v[:i]) for i in range(len(r.v))] and r.most == [max(r.v[:i], default=-1) for i in range(len(r.v))]


def test_many_spans_in_one_text(spark):
    rng = random.Random(2)
    mark = lambda: rng.choice(["%020x" % rng.getrandbits(80), "".join(rng.choice("abXY12é ") for _ in range(26)), "AKIA" + "Q1" * 8, "pwd = abc123def456Gh", "token: " + "aZ9" * 6, "private_key: " + "f0" * 9, "\n", "ü, "])
    texts = [" ".join(mark() for _ in range(n)) for n in (1, 7, 60, 900)] + ["".join(mark() for _ in range(400))]
    df = spark.createDataFrame([(i, t, "s", "en") for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string")
    spotted = {r.doc_id: r for r in secrets.spotted(df, ["doc_id"], "source", ["source", "lang"], "text").collect()}
    redacted = {r.doc_id: r.text for r in secrets.redacted(df).collect()}
    for i, text in enumerate(texts):
        base = brute_spans(text)
        assert [(s.start, s.kind, s.stop) for s in spotted[i]["__ts_base"]] == [tuple(x[:3]) for x in base]
        more = brute_candidates(text, base)
        assert sorted((s.start, s.kind, s.stop) for s in spotted[i]["__ts_more"]) == sorted(tuple(x[:3]) for x in more)
        assert redacted[i] == masked(text, sorted((x[0], x[2]) for x in [*base, *more]))
