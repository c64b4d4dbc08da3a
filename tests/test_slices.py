"""Arrow batches become Python objects a few rows at a time."""

import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from tessera.functions import models, text

LONG = ["A sentence of some length that ends here. And \\u4e2d more. " * 100] * 2000  # 12 MB


def peak(run):
    texts = pa.array([None, *LONG, "", None])
    tracemalloc.start()
    out = run(texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, most


def test_texts_of_a_batch_are_not_all_python_objects(monkeypatch):
    back, most = peak(text._unescape)
    assert most < 6e6 and back.to_pylist() == [None, *(t.replace("\\u4e2d", "中") for t in LONG), "", None]
    monkeypatch.setattr(text.F, "arrow_udf", lambda run, kind: lambda column: run)
    pieces, most = peak(text.split_sentences("text"))
    assert most < 6e6 and len(pieces) == len(LONG) + 3
    assert pieces[0].as_py() is None is pieces[len(pieces) - 1].as_py() and pieces[len(pieces) - 2].as_py() == [] and "".join(pieces[1].as_py()) == LONG[0].replace(". ", ".")
    assert text._unescape(pa.array([], pa.string())).to_pylist() == []


def test_memory_of_the_parts_is_given_back(monkeypatch):
    texts, held, pool = pa.array(LONG), [], pa.default_memory_pool()
    before = pool.bytes_allocated()

    class Pool:
        def release_unused(self):
            held.append(pool.bytes_allocated() - before)
            pool.release_unused()

    monkeypatch.setattr(text.pa, "default_memory_pool", Pool)
    out = text.by_slices(texts, lambda part: part, pa.string())
    assert out.equals(texts) and len(held) == 1 and held[0] < 1.2 * out.nbytes


def test_an_embedder_is_given_bounded_lists(spark):
    counted = models.Embedder(lambda texts: [[float(len(texts)), float(len(t))] for t in texts])
    df = spark.range(0, 3000, 1, 1).select("id", F.concat(F.lit("a"), F.col("id").cast("string")).alias("t"))
    each = F.when(F.col("id") % 7 > 0, F.array("t", F.lit("b"), F.lit(None).cast("string")))
    rows = df.select("t", counted(F.col("t")).alias("one"), counted.each(each).alias("all"), each.alias("texts")).collect()
    assert max(r.one[0] for r in rows) <= models.TEXTS and max(v[0] for r in rows for v in r["all"] or []) <= 3 * text.SLICE
    for r in rows:
        assert r.one[1] == len(r.t) and [v[1] for v in r["all"] or []] == [len(t or "") for t in r.texts or []] and (r["all"] is None) == (r.texts is None)
