"""Streams that end: order, repeats, late chunks, streams that are given up, restarts, and what stays as state."""

import datetime
import json
import os

import pytest

from tessera.streaming import sessions

START = datetime.datetime(2024, 1, 1)


@pytest.fixture()
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, sessions.STATE_STORE)
    yield spark
    spark.conf.set(name, before)


def put(folder, name, rows):
    """Rows (stream, seq, chunk, last, minute) as one file, whose age follows from its name: a file stream takes the oldest first."""
    folder.mkdir(exist_ok=True)
    with open(folder / name, "w") as out:
        for s, seq, chunk, last, minute in rows:
            out.write(json.dumps({"stream_id": s, "seq": seq, "chunk": chunk, "last": last, "sent_at": (START + datetime.timedelta(minutes=minute)).isoformat()}) + "\n")
    os.utime(folder / name, (1_700_000_000 + int(name),) * 2)


def run(spark, tmp_path):
    """All that is there, a file a batch; the query's last report."""
    source = spark.readStream.schema(sessions.ENDED_DELTA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    out = sessions.joined(source, "1 minute", 300_000)
    q = out.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    reports = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    rows = {(r.stream_id, r.content, r.chunks, r.ended) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    return rows, reports


def test_chunks_in_any_order_with_repeats_late_ones_and_a_stream_that_stops(rocks, tmp_path):
    put(tmp_path / "in", "1", [("a", 2, "c", True, 0), ("a", 0, "a", False, 0), ("b", 0, "x", None, 0), ("e", 0, None, True, 0), ("n", None, "lost", False, 0)])
    put(tmp_path / "in", "2", [("a", 0, "A", False, 1), ("b", 2, "z", False, 1), (None, 0, "?", False, 1)])
    put(tmp_path / "in", "3", [("a", 1, "b", False, 2)])
    rows, _ = run(rocks, tmp_path)
    assert rows == {("a", "abc", 3, True), ("e", "", 1, True)}
    put(tmp_path / "in", "4", [("a", 1, "again", False, 3), ("a", 2, "again", True, 3)])  # after the end, and after a restart
    put(tmp_path / "in", "5", [(None, None, None, None, 60)])
    put(tmp_path / "in", "6", [("a", 0, "too late", True, 4), (None, None, None, None, 61)])
    rows, reports = run(rocks, tmp_path)
    assert rows == {("a", "abc", 3, True), ("e", "", 1, True), ("b", "xz", 2, False), ("n", "", 0, False)}
    assert reports[0] > 0 and reports[-1] == 0


def test_a_restart_between_chunks_gives_each_stream_once(rocks, tmp_path):
    put(tmp_path / "in", "1", [(f"s{i}", 1, "b", True, 0) for i in range(40)])
    assert run(rocks, tmp_path)[0] == set()
    put(tmp_path / "in", "2", [(f"s{i}", 0, str(i), False, 1) for i in range(40)])
    wanted = {(f"s{i}", f"{i}b", 2, True) for i in range(40)}
    assert run(rocks, tmp_path)[0] == wanted
    assert run(rocks, tmp_path)[0] == wanted and rocks.read.parquet(str(tmp_path / "out")).count() == 40
