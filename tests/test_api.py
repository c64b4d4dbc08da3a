import datetime

import pytest
from pyspark.sql import functions as F

from tessera import api
from tessera.operators import embedding


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("api")
    (root / "src").mkdir()
    (root / "src/a.py").write_text("def zebra():\n    return quick()\n\n\ndef quick():\n    return 'zzz zzz'\n")
    (root / "src/b.ts").write_text("function go(x) { return stop(x); }\nfunction stop(x) { return x; }\n")
    (root / "notes").mkdir()
    (root / "notes/n.txt").write_text("The quick brown fox jumps over the lazy dog again and again. " * 8 + "Zzz zzz zzz. " * 20)
    made = api.Engine(spark, str(root / "store"))
    made.here = str(root)
    return made


def test_ingest_ask_and_delete(engine, spark):
    assert engine.ingest(f"{engine.here}/src", "code") == 2
    assert engine.ingest(f"{engine.here}/notes", "notes", "text") >= 2
    with pytest.raises(FileExistsError):
        engine.ingest(f"{engine.here}/src", "code")
    out = engine.chat("notes", "zzz  zzz\n", max_distance=0.9)
    assert out["source_documents"] and "zz" in out["source_documents"][0]["page_content"].lower() and out["text"].startswith("answer ")
    assert engine.chat("notes", "qqqq", max_distance=0.0) == {"text": "No matching context was found.", "source_documents": []}
    assert engine.chat("notes", "more", [("a", "b")])["text"]
    docs = spark.createDataFrame([("new", datetime.datetime(2000, 1, 1)), ("code", datetime.datetime(2000, 1, 1))], "filename string, birthtime timestamp")
    assert [(r.filename, r.embedding) for r in engine.resources(docs).collect()][0] == ("new", False)
    assert {r.filename for r in engine.resources(docs).collect()} == {"new", "code", "notes"}
    cache = spark.createDataFrame([("code", "x"), ("notes", "y")], "key string, value string")
    assert [r.key for r in engine.delete("code", cache).collect()] == ["notes"]
    assert {r.filename for r in engine.resources().collect()} == {"notes"}


def test_graph(engine):
    graph = engine.call_graph(f"{engine.here}/src")
    assert sorted((r.head_label, r.tail_label) for r in graph["calls"].collect()) == [("go", "stop"), ("zebra", "quick")]
    assert graph["definitions"].count() == 4 and graph["dot"].count() == 2
    text = engine.search_calls(graph["calls"], "ZEB", 2).first().dot
    assert "zebra" in text and "stop" not in text
    assert engine.search_calls(graph["calls"], "none", 2).first().dot == "" and engine.search_calls(graph["calls"], "zeb", 0).first().dot == ""


def test_lookups(engine, spark):
    assert engine.file_content(f"{engine.here}/src/b.ts").startswith("function go")
    assert {r.filename for r in engine.file_tree(f"{engine.here}/src").where("type = 'file'").collect()} == {"a.py", "b.ts"}
    assert {r.suffix for r in engine.suffixes(f"{engine.here}/src").collect()} == {".py", ".ts"}
    assert engine.find(spark.createDataFrame([("aXa",)], "text string"), "A").first().positions == [1, 3]
    engine.set("proxy", "p")
    for k in range(4):
        engine.set("model", f"m{k}")
    other = api.Engine(spark, engine.root)
    assert other.get("proxy") == "p" and other.get("@tessera/model") == "m3" and engine.get("none", "d") == "d" and engine.cancel("none") == []
    turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 2, "user", "more")], "conv_id long, turn long, role string, text string")
    assert engine.code_chat(turns).first().prompt == "user: hi\nassistant: yo\nuser: more"


def test_other_kinds_of_resources(engine, spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("r/a.py", "def one():\n    return two()\n\n\ndef two():\n    return 2\n")
        z.writestr("r/readme.md", "no code")
    assert engine.ingest(str(tmp_path), "zipped", "zip") == 1
    (tmp_path / "pdf").mkdir()
    (tmp_path / "pdf/p.pdf").write_bytes(b"first page. \x0c second page.")
    engine.read_pdf = lambda content: [(str(k + 1), t) for k, t in enumerate(content.decode().split("\x0c"))]
    assert engine.ingest(str(tmp_path / "pdf"), "pages", "pdf") == 2
    tree = {"src": [{"path": "src/a.py", "type": "file", "download_url": "u1"}, {"path": "src/sub", "type": "dir"}], "src/sub": [{"path": "src/sub/b.ts", "type": "file", "download_url": "u2"}, {"path": "src/sub/n.md", "type": "file", "download_url": "u3"}]}
    contents = {"u1": b"def f(): pass\n", "u2": b"function g() { return 1; }\n", "u3": b"notes"}
    prefix = "https://api.github.com/repos/me/it/contents/"
    engine.host = {"listing": lambda url: tree[url.removeprefix(prefix).split("?")[0]], "fetch": contents.__getitem__, "default_branch": lambda url: "main"}
    assert engine.ingest("https://github.com/me/it/tree/main/src", "far", "remote") == 2
    assert sorted(map(tuple, engine.download("https://github.com/me/it/tree/main/src", f"file://{tmp_path}/down").collect())) == [("a.py", 14), ("sub/b.ts", 27), ("sub/n.md", 5)]
    assert {r.filename for r in engine.resources().collect()} >= {"zipped", "pages", "far"}
    with pytest.raises(ValueError, match="no code host"):
        api.Engine(spark, engine.root).repository("https://github.com/me/it")
    said = engine.say(spark.createDataFrame([("s", "a b")], "stream_id string, prompt string"), str.split)
    assert [r.chunk for r in said.orderBy("seq").collect()] == ["a", "b"]
    listed = engine.models(spark.createDataFrame([("https://x.y/v1",)], "base_url string"), lambda url: (200, {"data": [{"id": "gpt-9"}, {"id": "other"}]}))
    assert [r.id for r in listed.collect()] == ["gpt-9"]


def test_an_index_through_the_driver_is_measured(spark):
    from tessera.sources import store

    rows = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert store.from_bytes(spark, store.to_bytes(rows)).collect() == rows.collect()
    with pytest.raises(ValueError, match="does not pass"):
        store.to_bytes(rows, most=10)


def test_embedding_batches(spark):
    def embed(texts):
        assert sum(map(len, texts)) <= 10 or len(texts) == 1
        return [[float(len(t))] for t in texts]

    chunks = spark.createDataFrame([(i, "x" * n) for i, n in enumerate([3, 20, 5, 5, 1, 0])], "i int, page_content string").coalesce(1)
    got = embedding.embedded(chunks, embed, count=len, limit=10).orderBy("i").collect()
    assert [r.embedding for r in got] == [[3.0], [20.0], [5.0], [5.0], [1.0], [0.0]]
    assert embedding.embedded(chunks, embed, count=len, limit=10, concurrency=2).count() == 6
    with pytest.raises(Exception, match="another number"):
        embedding.embedded(chunks, lambda texts: [], count=len, limit=10).collect()
    requests = spark.createDataFrame([(0, ["a", "b"])], "batch int, texts array<string>")
    responses = spark.createDataFrame([(0, [[1.0], [2.0]])], "batch int, data array<array<double>>")
    assert [(r.text, r.embedding) for r in embedding.reassociated(requests, responses).orderBy("pos").collect()] == [("a", [1.0]), ("b", [2.0])]
    assert [r.batch for r in embedding.task_batches(chunks, "i", 4).orderBy("i").collect()] == [0, 0, 0, 0, 1, 1]
    assert embedding.oversized(chunks, limit=4).count() == 1
    assert chunks.select(embedding.document_id("i", "page_content").alias("d")).distinct().count() == 6
    own = api.embed_with(lambda texts: [[1.0] for _ in texts])
    assert chunks.select(own(F.col("page_content")).alias("e")).first().e == [1.0]
