"""Sources and sinks in Python: pruned listings, files that are whole or absent, restarts of a stream."""

import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, StringEndsWith, StringStartsWith

from tessera.sources import connectors as C


def tree(root, names):
    for name in names:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(name)


NAMES = ["top.py", "a/x.py", "a/y.ts", "a/b/z.py", "ab/w.py", "c/d/e/v.py", "c/.git/q.py", "_temp/r.py"]


def listed(path, filters):
    """The folders that a query with these conditions lists, and its partitions."""
    seen = []
    reader = C.TreeReader(str(path), True)
    plain = reader.listed
    reader.listed = lambda system, root, folder: (seen.append(folder), plain(system, root, folder))[1]
    assert list(reader.pushFilters(filters)) == []
    found = [p.folder for p in reader.partitions()]
    return sorted(seen), found


def test_folders_that_no_condition_wants_are_never_listed(tmp_path):
    tree(tmp_path, NAMES)
    assert listed(tmp_path, []) == (["", "a", "a/b", "ab", "c", "c/d", "c/d/e"],) * 2
    assert listed(tmp_path, [EqualTo(("folder",), "a/b")]) == (["", "a", "a/b"], ["a/b"])
    assert listed(tmp_path, [In(("folder",), ("c/d", None, "x"))]) == (["", "c", "c/d"], ["c/d"])
    assert listed(tmp_path, [StringStartsWith(("folder",), "a")]) == (["", "a", "a/b", "ab"], ["a", "a/b", "ab"])
    assert listed(tmp_path, [StringStartsWith(("folder",), "a/")]) == (["", "a", "a/b"], ["a/b"])
    assert listed(tmp_path, [EqualTo(("folder",), "a"), EqualTo(("folder",), "c")]) == ([""], [])
    assert listed(tmp_path, [StringEndsWith(("name",), ".py"), EqualTo(("folder",), "")]) == ([""], [""])


def test_a_tree_is_read_with_conditions_as_without(spark, tmp_path):
    C.register(spark)
    tree(tmp_path, NAMES)
    files = spark.read.format("file_tree").load(str(tmp_path))
    every = {(r.folder, r.name, r.size, bytes(r.content).decode()) for r in files.collect()}
    assert every == {(os.path.dirname(n), os.path.basename(n), len(n), n) for n in NAMES[:6]}
    for test, condition in ((lambda f, n: f == "a", "folder = 'a'"), (lambda f, n: f.startswith("a"), "folder like 'a%'"), (lambda f, n: n.endswith(".ts"), "name like '%.ts'"), (lambda f, n: f in ("", "a/b"), "folder in ('', 'a/b')"), (lambda f, n: len(f) == 1 and n > "x.", "length(folder) = 1 and name > 'x.'"), (lambda f, n: f != "a", "folder <> 'a'")):
        got = {(r.folder, r.name) for r in files.where(condition).collect()}
        assert got == {(f, n) for f, n, _, _ in every if test(f, n)}, condition
    assert {r.content for r in spark.read.format("file_tree").option("content", "false").load(str(tmp_path)).collect()} == {None}


def written(spark, rows, path):
    C.register(spark)
    rows.write.format("whole_files").mode("append").save(str(path))


def below(path):
    return {os.path.relpath(os.path.join(d, n), path) for d, _, names in os.walk(path) for n in names if not n.endswith(".crc")}


def test_files_are_whole_and_counted(spark, tmp_path):
    rows = spark.createDataFrame([(f"d{i % 3}/f{i}", bytes([i]) * i) for i in range(1, 20)] + [("empty", None)], "path string, content binary").repartition(4)
    written(spark, rows, tmp_path / "out")
    assert below(tmp_path / "out") == {f"d{i % 3}/f{i}" for i in range(1, 20)} | {"empty", "_SUCCESS"}
    assert (tmp_path / "out/d2/f5").read_bytes() == b"\x05" * 5
    assert json.loads((tmp_path / "out/_SUCCESS").read_text()) == {"files": 20, "size": 190}
    written(spark, rows.limit(0), tmp_path / "none")
    assert below(tmp_path / "none") == {"_SUCCESS"}


def test_a_job_that_fails_takes_its_files_back(spark, tmp_path):
    out = tmp_path / "out"
    good = spark.range(200, numPartitions=8).select(F.concat(F.lit("f"), "id").alias("path"), F.encode(F.lit("x"), "UTF-8").alias("content"))
    bad = good.withColumn("path", F.when(F.col("path") == "f199", F.lit("../out-of-it")).otherwise(F.col("path")))
    with pytest.raises(Exception, match="no path inside"):
        written(spark, bad, out)
    assert below(out) == set() and not (tmp_path / "out-of-it").exists()


def test_a_task_that_fails_leaves_nothing(tmp_path):
    class Row:
        def __init__(self, path):
            self.path, self.content = path, b"x"

    def broken():
        yield Row("a/1")
        raise OSError("gone")

    writer = C.FilesWriter(str(tmp_path))
    with pytest.raises(OSError):
        writer.write(broken())
    assert not (tmp_path / "a").exists()
    done = writer.write(iter([Row("a/1"), Row("a/2")]))  # the second attempt
    writer.commit([done, None])
    assert below(tmp_path) == {"a/1", "a/2", "_SUCCESS"}


def relayed(spark, prompts, out, checkpoint):
    C.register(spark, lambda prompt: prompt.split())
    stream = spark.readStream.format("model_deltas").load(str(prompts))
    q = stream.writeStream.format("relay").option("path", str(out)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = [json.loads(line) for name in sorted(below(out)) if name.endswith(".json") and not name.startswith(".") for line in open(out / name)]
    return sorted((r["stream_id"], r["seq"], r["chunk"], r["last"]) for r in rows if r["chunk"] is not None), [r for r in rows if r["chunk"] is None]


def test_a_stream_that_stops_and_starts_gives_every_piece_once(spark, tmp_path):
    prompts, out, checkpoint = tmp_path / "p", tmp_path / "o", tmp_path / "c"
    frame = lambda rows: spark.createDataFrame(rows, "stream_id string, prompt string").coalesce(1)
    frame([("a", "one two é"), ("b", "")]).write.parquet(str(prompts / "n=1"))
    first = [("a", 0, "one", False), ("a", 1, "two", False), ("a", 2, "é", True)]
    got, silent = relayed(spark, prompts, out, checkpoint)
    assert got == first and [(r["stream_id"], r["last"]) for r in silent] == [("b", True)]
    assert relayed(spark, prompts, out, checkpoint)[0] == first
    frame([("c", "three"), ("d", None)]).write.parquet(str(prompts / "n=2"))
    got, silent = relayed(spark, prompts, out, checkpoint)
    assert got == [*first, ("c", 0, "three", True)] and len(silent) == 2
    commits = sorted(os.listdir(checkpoint / "commits"))
    last = max(c for c in commits if c.isdigit())
    for name in (last, f".{last}.crc"):  # the batch reached the sink, but the query died before it noted so
        os.remove(checkpoint / "commits" / name)
    assert relayed(spark, prompts, out, checkpoint)[0] == got


def test_a_commit_that_broke_off_is_made_anew(tmp_path):
    class Row:
        def asDict(self, recursive):
            return {"x": 1}

    writer = C.RelayWriter(str(tmp_path))
    (tmp_path / "batch=000000003").mkdir()
    (tmp_path / "batch=000000003" / "half.json").write_text("{")
    parts = [writer.write(iter([Row(), Row()])), writer.write(iter([]))]
    writer.commit(parts, 3)
    found = [n for n in below(tmp_path) if n.endswith("json")]
    assert len(found) == 1 and (tmp_path / found[0]).read_text() == '{"x": 1}\n' * 2
    again = writer.write(iter([Row()]))
    writer.commit([again], 3)
    lost = writer.write(iter([Row()]))
    writer.abort([lost, None], 4)
    assert [n for n in below(tmp_path) if n.endswith("json")] == found
