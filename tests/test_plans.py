import os
import random
import subprocess
import sys
import types

import pytest
from pyspark.sql import functions as F

from tessera.plans import components, ranking, staging


def test_ranks_have_no_gaps(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice([None, "a", "a", "a", "b"]), rnd.getrandbits(62), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, h long, i int")
    n = ranking.bucket_count(3000)
    got = ranking.ranked(df, ["g"], F.floor(F.shiftright("h", 31) * n / F.lit(float(1 << 31))), [F.col("h"), F.col("i")], "rank").collect()
    by = {}
    for r in got:
        by.setdefault(r.g, []).append((r["rank"], r.h))
    assert sorted(map(len, by.values())) == sorted(sum(x[0] == g for x in rows) for g in (None, "a", "b"))
    for own in by.values():
        own.sort()
        assert [k for k, _ in own] == list(range(len(own))) and [h for _, h in own] == sorted(h for _, h in own)
    assert ranking.ranked(df.limit(0), [], F.lit(0), [F.col("h")], "rank").count() == 0


def test_components(spark):
    rnd = random.Random(9)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + k) for k in range(1, 40)] + [(rnd.randrange(200, 300), rnd.randrange(200, 300)) for _ in range(60)] + [(7, 7), (-5, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {x: find(x) for x in root if find(x) != x}
    got = {r.node: r.root for r in components.roots(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == want
    assert components.roots(spark.createDataFrame([], "u long, v long")).count() == 0


def test_staged_tables_lie_in_the_shared_folder(spark):
    df = staging.staged(spark.range(5).withColumn("x", F.lit(None).cast("string")), "five")
    assert df.count() == 5 and all(staging.shared_folder(spark).split(":")[-1] in f for f in df.inputFiles())
    assert staging.shared_folder(spark) == (spark.conf.get("spark.checkpoint.dir", None) or staging.shared_folder(spark))


def test_a_session_without_the_setting_has_its_own_folder(tmp_path):
    code = "from pyspark.sql import SparkSession as S; from tessera.plans import staging as g; s = S.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate(); print('N', g.staged(s.range(3), 'x').count(), 'tessera-' in g.shared_folder(s))"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    run = lambda code: subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": root, "SPARK_CONF_DIR": str(tmp_path)})
    said = run(code)
    assert "N 3 True" in said.stdout, said.stderr[-2000:]


def test_a_cluster_without_the_setting_is_refused():
    """A stand-in session: only its settings and master are asked."""
    unset = types.SimpleNamespace(get=lambda name, default=None: default)
    session = lambda master: types.SimpleNamespace(conf=unset, sparkContext=types.SimpleNamespace(getConf=lambda: unset, master=master, applicationId="test-app"))
    for master in ("local-cluster[1,1,1024]", "spark://host:7077", "yarn", "k8s://https://host"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            staging.shared_folder(session(master))
    named = session("yarn")
    named.conf = types.SimpleNamespace(get=lambda name, default=None: "hdfs:///shared")
    assert staging.shared_folder(named) == "hdfs:///shared"


def test_written_tables_can_go(spark):
    with staging.recorded() as made:
        kept, gone = staging.staged(spark.range(3), "kept"), staging.staged(spark.range(4), "gone")
    after = staging.staged(spark.range(1), "after")
    assert len(made) == 2 and made[1] in gone.inputFiles()[0].replace("file:///", "file:/").replace("file:/", "/") or made[1] in gone.inputFiles()[0]
    staging.remove(spark, made[1:])
    assert kept.count() == 3 and after.count() == 1
    with pytest.raises(Exception, match="(?i)not.*exist|FILE_NOT_EXIST"):
        gone.collect()


def series(groups=(None, "a", "b"), n=400):
    """One group holds most rows; one key is far from all others."""
    rnd = random.Random(8)
    keys = rnd.sample(range(10 * n), n) + [1 << 60]
    return [(groups[1] if rnd.random() < 0.8 else rnd.choice(groups), k, rnd.choice([None, rnd.random()])) for k in keys]


def by_group(rows):
    out = {}
    for g, k, x in sorted(rows, key=lambda r: r[1]):
        out.setdefault(g, []).append((k, x))
    return out


def test_neighbours_and_running_sums(spark):
    rows = series()
    df = spark.createDataFrame(rows, "g string, k long, x double")
    after = {r.k: (r.y is None, r.y) for r in ranking.with_next(df, ["g"], ["k"], "x", "y").collect()}
    sums = {r.k: r.s for r in ranking.running(df, ["g"], ["k"], F.col("k") % 7, "s").collect()}
    assert len(after) == len(sums) == len(rows)
    for own in by_group(rows).values():
        total = 0
        for (k, _), follow in zip(own, [*own[1:], (None, None)]):
            assert after[k][1] == follow[1] and sums[k] == total
            total += k % 7
    assert ranking.with_next(df.limit(0), ["g"], ["k"], "x", "y").count() == ranking.running(df.limit(0), [], ["k"], F.lit(1), "s").count() == 0
    labels = sorted((r.k, r.s) for r in ranking.running(df, [], ["k"], F.lit(1), "s").collect())
    assert [s for _, s in labels] == list(range(len(rows)))


@pytest.mark.parametrize("share", [0.0, 0.3, 0.8, 1.0])
def test_percentiles_are_exact(spark, share):
    import numpy as np

    rows = series()
    got = {r.g: r.p for r in ranking.percentiles(spark.createDataFrame(rows, "g string, k long, x double"), ["g"], "x", share, "p").collect()}
    for g, own in by_group(rows).items():
        values = [x for _, x in own if x is not None]
        assert (not values and g not in got) or got[g] == pytest.approx(np.quantile(values, share))


def test_a_worker_keeps_the_tables_of_one_operator():
    """In a process of its own, as a worker is."""
    code = """
import gc
from tessera.functions.process_cache import kept, only, uncollected
made = []
build = lambda x: (made.append(x), x)[1]
assert kept("a", 1, lambda: build("a1")) == kept("a", 1, lambda: build("never")) == "a1"
assert kept("a", 2, lambda: build("a2")) == "a2" and made == ["a1", "a2"]
only("a", "b")
assert kept("a", 2, lambda: build("never")) == "a2"
only("b")
assert kept("a", 2, lambda: build("again")) == "again"
with uncollected():
    assert not gc.isenabled()
assert gc.isenabled()
try:
    with uncollected():
        raise KeyError
except KeyError:
    assert gc.isenabled()
print("good")
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, env=os.environ | {"PYTHONPATH": root})
    assert "good" in said.stdout, said.stderr[-2000:]
