"""Imports and names passed on, against walks in plain Python."""

import random

from pyspark.sql import functions as F

from tessera.operators import import_graph


def test_reached_files_and_steps(spark):
    rnd = random.Random(3)
    edges = [(f"f{rnd.randrange(40)}", f"f{rnd.randrange(40)}") for _ in range(50)] + [("f1", "f1"), ("f1", None), (None, "f2"), ("hub", "f0"), ("hub", "f0")]
    imports = spark.createDataFrame(edges, "file string, target string").withColumns({c: F.lit(1) for c in ("entry", "steps")})
    entries = spark.createDataFrame([("f1",), ("hub",), ("alone",), (None,), ("f1",)], "entry string")
    wanted = set()
    for entry in ("f1", "hub", "alone"):
        steps, edge = {entry: 0}, [entry]
        while edge:
            at = edge.pop(0)
            for t in {t for f, t in edges if f == at and t is not None} - set(steps):
                steps[t] = steps[at] + 1
                edge.append(t)
        wanted |= {(entry, f, k) for f, k in steps.items()}
    got = import_graph.reached(entries, imports)
    assert sorted(map(tuple, got.collect())) == sorted(wanted)
    calls = spark.createDataFrame([("f0", "x"), ("nowhere", "y"), (None, "z")], "file string, call string")
    assert [r.call for r in import_graph.in_scope(calls, got).collect()] == ["x"]
    assert import_graph.reached(entries.limit(0), imports).count() == 0
    assert {tuple(r) for r in import_graph.reached(entries, imports.limit(0)).collect()} == {(e, e, 0) for e in ("f1", "hub", "alone")}


def test_names_passed_on(spark):
    chain = [(f"c{k}", "n", f"c{k + 1}", "n") for k in range(37)]
    passed = chain + [("a", "x", "b", "y"), ("b", "y", "a", "x"), ("s", "s", "s", "s"), ("q", "x", "none", "x"), ("r", "z", "c5", "n"), ("d", "n", "e", "n"), ("d", "n", "c0", "n"), ("a", "x", "b", "y"), (None, "x", "a", "x"), ("w", None, "a", "x"), ("c37", "n", "a", "x")]
    defined = [("c37", "n"), ("e", "m"), ("e", "m"), (None, "n")]
    got = {(r.file, r.name): (r.def_file, r.def_name) for r in import_graph.defined_at(spark.createDataFrame(passed, "file string, name string, target string, target_name string").withColumn("done", F.lit(0)), spark.createDataFrame(defined, "file string, name string")).collect()}
    none = (None, None)
    wanted = {(f"c{k}", "n"): ("c37", "n") for k in range(38)} | {("a", "x"): none, ("b", "y"): none, ("s", "s"): none, ("q", "x"): none, ("r", "z"): ("c37", "n"), ("d", "n"): ("c37", "n"), ("e", "m"): ("e", "m")}
    assert got == wanted
