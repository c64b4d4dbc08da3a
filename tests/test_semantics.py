"""Edge rows of the reference's own operators, against small restatements in Python."""

import datetime
import io
import json
import os
import re
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import models, tokens, urls, vectors
from tessera.functions import text as T
from tessera.operators import answering, call_graph, catalog, chunking, vector_index
from tessera.sources import code, files, remote, store
from tessera.streaming import deltas


def values(spark, rows, kind, expression):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r.y for r in df.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


TEXTS = ["", "no end", "One. Two! Three? Four", "中文。 好！　吗", "tail. ", "a.b c", "x" * 49 + ". " + "y" * 60, "a. b. c. " + "d" * 44 + ". " + "e" * 80, "é. 　\n ü.", "s" * 47 + ". t"]


def split(text):
    return re.split(r"(?<=[.。?？!！])\s+", text)


def merge(pieces):
    out, held = [], ""
    for p in pieces:
        held += p
        if len(held) >= 50:
            out.append(held)
            held = ""
    return [*out, held] if held else out


def test_sentences(spark):
    assert values(spark, TEXTS, "string", T.sentences) == [split(t) for t in TEXTS]
    assert values(spark, TEXTS, "string", T.split_sentences) == [merge(split(t)) for t in TEXTS]
    assert values(spark, TEXTS, "string", lambda c: T.merged_short(T.sentences(c))) == [merge(split(t)) for t in TEXTS]
    assert values(spark, [None], "string", T.split_sentences) == [None]


def test_scripts_close_up(spark):
    rows = ["中 A 中", "中 文", "x y", "中  A", "中 7", "中\nA", "中 A 中 英文 x y 中"]
    want = [re.sub(r"([一-鿿]) (\w)|([a-zA-Z]) ([一-鿿])", lambda m: (m[1] or m[3]) + (m[2] or m[4]), t) for t in rows]
    assert values(spark, rows, "string", T.close_up_scripts) == want


def test_escapes(spark):
    rows = ["一龥龦", "a中b", "plain \\u4e2d", "", "😀"]
    escaped = values(spark, rows, "string", T.escaped_cjk)
    assert escaped == ["\\u4e00\\u9fa5龦", "a\\u4e2db", "plain \\u4e2d", "", "😀"]
    assert values(spark, escaped, "string", T.unescaped) == ["一龥龦", "a中b", "plain 中", "", "😀"]
    assert values(spark, ["\\ud83d\\ude00", None, "\\u00e9x"], "string", T.unescaped) == ["😀", None, "éx"]


def test_trim_and_questions(spark):
    assert values(spark, ["　 a\nb \n", "\t"], "string", T.sanitised_question) == ["a b", ""]
    assert values(spark, ["x\\ny", "x\ny"], "string", T.without_literal_newlines) == ["xy", "x\ny"]


def test_events(spark):
    rows = ['data: {"result":"a"}', 'data: {"result":"a"}\n\ndata: {"result":"b"}\n\n', "plain", ""]
    assert values(spark, rows, "string", T.sse_results) == [["a"], ["a", "b"], ["plain"], [""]]


def test_find(spark):
    rows = ["aAaa", "", "xyz", "a.a"]
    assert values(spark, rows, "string", lambda c: T.find_count(c, F.lit("A"))) == [4, 0, 0, 2]
    assert values(spark, rows, "string", lambda c: T.find_positions(c, F.lit("a"))) == [[1, 2, 3, 4], [], [], [1, 3]]
    assert values(spark, ["a.b.c"], "string", lambda c: T.find_positions(c, F.lit("."), True)) == [[2, 4]]
    assert values(spark, rows, "string", lambda c: T.find_count(c, F.lit(""))) == [0, 0, 0, 0]


def test_lines(spark):
    assert [tuple(r) for r in values(spark, ["ab\ncd"], "string", lambda c: T.line_and_column(c, F.lit(4)))] == [(2, 2)]


def batch(counts, limit):
    out, number, used = [], 0, 0
    for n in counts:
        if used + n > limit:
            number, used = number + 1, 0
        used += n
        out.append(number)
    return out


def test_token_batches(spark):
    rows = [[], [5], [11], [11, 1], [4, 6, 1], [3, 20, 3], [10, 1], [0, 0, 10, 0]]
    assert values(spark, rows, "array<bigint>", lambda c: tokens.batches(c, 10)) == [batch(r, 10) for r in rows]


def test_token_prefix(spark):
    assert values(spark, ["abcd", "", "é😀x"], "string", lambda c: tokens.prefix_within(c, 2)) == ["ab", "", "é😀"]
    assert values(spark, ["abcd"], "string", lambda c: tokens.prefix_within(c, 0)) == ["a"]


def test_unknown_models_have_no_room(spark):
    assert answering.budget("gpt-4") == 7992 and answering.budget("other") == -201
    found = spark.createDataFrame([(1, 1, "abcd")], "q int, r int, c string")
    row = answering.packed_context(found, "q", "r", "c", answering.budget("other")).first()
    assert row.context == "" and row.n_sources == 0


def test_context_stops_at_the_first_that_does_not_fit(spark):
    rows = [(1, 1, "a" * 8), (1, 2, "b" * 40), (1, 3, "c"), (2, 1, "d" * 40), (3, 1, "e" * 36)]
    found = spark.createDataFrame(rows, "q int, r int, c string")
    got = {r.q: r.context for r in answering.packed_context(found, "q", "r", "c", 10).collect()}
    assert got == {1: "\n" + "a" * 8, 2: "", 3: "\n" + "e" * 36}
    cut = {r.q: r.context for r in answering.cut_context(found, "q", "r", "c", 10).collect()}
    assert cut[1] == "a" * 8 + "\nb"


def test_segmentation(spark):
    def chunked(pieces, distances):
        df = spark.createDataFrame([(pieces, distances)], "p array<string>, d array<double>")
        return df.select(chunking.chunks(F.col("p"), F.col("d")).alias("c")).first().c

    assert chunked([], []) == [""] and chunked(["a"], []) == ["a"] and chunked(["a", "b"], []) == ["a b"]
    assert chunked(["a", "b", "c"], [0.5, 0.5]) == ["abc"]
    d = [0.1, 0.2, 0.3, 0.9]
    assert chunked(list("abcde"), d) == ["abcd", "e"]
    rnd = np.random.default_rng(3)
    for _ in range(10):
        d = rnd.random(rnd.integers(1, 30)).round(6).tolist()
        p = [f"<{i}>" for i in range(len(d) + 1)]
        limit, want, now = round(float(np.percentile(d, 80)), 9), [], ""
        for i, s in enumerate(p):
            now += s
            if i < len(d) and d[i] > limit:
                want, now = [*want, now], ""
        assert chunked(p, d) == [*want, now]
    df = spark.createDataFrame([([1.0, 2.0, 6.0],)], "v array<double>")
    assert df.select(chunking.spread_threshold(F.col("v"), 0.5).alias("t")).first().t == pytest.approx(3 + 0.5 * np.std([1, 2, 6]))


def test_chunks_hold_the_whole_text(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    letters = lambda s: re.sub(r"\s", "", s)
    by = {}
    for r in chunking.chunked(docs).orderBy("doc_id", "chunk_no").collect():
        by[r.doc_id] = by.get(r.doc_id, "") + r.page_content
    for r in docs.collect():
        assert letters(by[r.doc_id]) == letters(r.text)


def test_code_is_packed():
    assert chunking.packed([], len) == [] and chunking.packed(["", "a"], len) == ["\na"]
    assert chunking.packed(["aaa", "bbb"], len, 5) == ["\naaa", "\nbbb"] and chunking.packed(["aa", "bb"], len, 5) == ["\naa\nbb"]
    assert chunking.packed(["x" * 12], len, 5) == ["\n" + "x" * 5, "\n" + "x" * 5, "\nxx"]
    assert "".join(chunking.packed(["ab", "c" * 30, "d"], lambda s: -(-len(s) // 4), 4)).replace("\n", "") == "ab" + "c" * 30 + "d"


def test_embedders_and_models_are_injected(spark):
    embed = models.Embedder(lambda texts: [[float(len(t))] for t in texts])
    assert values(spark, ["a", "abc", None], "string", embed) == [[1.0], [3.0], [0.0]]
    assert values(spark, [["a", None], [], None], "array<string>", embed.each) == [[[1.0], [0.0]], [], None]
    docs = spark.createDataFrame([(1, "One sentence here, of more than fifty letters in all, yes. " * 4, "clash"), (2, " ", "x"), (3, None, "x")], "doc_id int, text string, page_content string")
    assert {r.doc_id for r in chunking.chunked(docs, embed=embed).collect()} == {1}
    speak = models.language_model(lambda p: p.upper())
    assert values(spark, ["a", None], "string", speak) == ["A", None]
    assert isinstance(models.plain_error(type("ReadTimeout", (Exception,), {})("x")), TimeoutError)
    with pytest.raises(Exception, match="TimeoutError"):
        values(spark, ["a"], "string", models.language_model(lambda p: (_ for _ in ()).throw(TimeoutError("late"))))


@pytest.mark.parametrize("metric", sorted(vectors.METRICS))
def test_metrics_agree(spark, metric):
    rnd = np.random.default_rng(1)
    a, b = rnd.random((5, 6)), rnd.random((3, 6))
    index = vector_index.FlatIndex(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(a)], "vec_id long, embedding array<double>"), metric)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(b)], "query_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id): (r.rank, r.distance) for r in index.search_batch(queries, 9).collect()}
    assert len(got) == 15
    for q in range(3):
        one = index.search(b[q].tolist(), 9).collect()
        assert [(r.rank, r.vec_id) for r in one] == sorted((got[q, r.vec_id][0], r.vec_id) for r in one)
        for r in one:
            assert r.distance == pytest.approx(got[q, r.vec_id][1], abs=1e-8)


def test_search_limits(spark):
    rows = [(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.6**0.5, 0.0]), (4, None)]
    index = vector_index.make_index(spark.createDataFrame(rows[:4], "vec_id long, embedding array<double>"))
    assert [r.vec_id for r in index.search([0.0, 0.0], 10).collect()] == [0, 3, 1, 2]
    assert [r.vec_id for r in index.search([0.0, 0.0], 2).collect()] == [r.vec_id for r in index.search([0.0, 0.0], 3).collect()][:2]
    assert [r.vec_id for r in index.search([0.0, 0.0], 4, F.col("distance") < 0.6).collect()] == [0]
    assert index.search([9.0, 9.0], 4, F.col("distance") < 0.6).count() == 0
    queries = spark.createDataFrame([(7, [0.0, 0.0])], "query_id long, embedding array<double>")
    padded = index.search_batch(queries, 6, pad=True).orderBy("rank").collect()
    assert [r.vec_id for r in padded] == [0, 3, 1, 2, -1, -1]
    assert index.search_batch(queries.limit(0)).count() == 0
    assert index.is_trained and index.train() is index
    with pytest.raises(ValueError):
        vector_index.make_index(index.rows, "IVF16,Flat")
    with pytest.raises(ValueError):
        vector_index.make_index(index.rows, metric="hamming")


def test_labels_are_dense_whatever_the_ids(spark):
    ids = [-(2**63), 2**63 - 1, 0, 5, 6, -7]
    rows = spark.createDataFrame([(i, [float(k)]) for k, i in enumerate(ids)], "vec_id long, embedding array<double>")
    got = vector_index.labelled(rows, "vec_id", "label").orderBy("vec_id").collect()
    assert [r.label for r in got] == list(range(6)) and [r.vec_id for r in got] == sorted(ids)
    left, removed = vector_index.FlatIndex(rows).remove(rows.where("vec_id in (0, 5)").select("vec_id"))
    assert removed.first().removed == 2 and sorted(r.vec_id for r in left.rows.collect()) == [0, 1, 2, 3]


def test_role_pairs(spark):
    def pairs(roles):
        rows = [(1, i, r, f"{r}{i}") for i, r in enumerate(roles)]
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        got = sorted((r.place, r.role, r.text) for r in answering.role_pairs(df).collect())
        assert [g[0] for g in got] == list(range(len(got)))
        return [g[1:] for g in got]

    def brute(roles):
        kept = []
        for i in range(len(roles) - 1):
            if roles[i] == "user" and roles[i + 1] == "assistant":
                kept += [("user", f"user{i}"), ("assistant", f"assistant{i + 1}")]
        if roles[-1] == "user":
            kept.append(("user", f"user{len(roles) - 1}"))
        return kept if len(kept) % 2 else [("user", ""), *kept]

    for roles in (["user"], ["user", "user"], ["system", "user", "assistant", "user"], ["user", "assistant"], ["user", "user", "assistant", "assistant", "user"]):
        assert pairs(roles) == brute(roles)


def test_last_messages(spark):
    rows = [(c, t, "user" if t % 2 else "assistant", "x") for c, n in ((1, 9), (2, 10), (3, 11)) for t in range(n)] + [(4, 1, "user", "u"), (4, 1, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = answering.last_messages(df)
    assert {r.conv_id: r["count"] for r in got.groupBy("conv_id").count().collect()} == {1: 9, 2: 10, 3: 10, 4: 2}
    assert [r.role for r in answering.last_messages(df.where("conv_id = 4"), 1).collect()] == ["assistant"]


def test_answers_say_when_nothing_was_found(spark):
    shelf = spark.createDataFrame([(0, "aaaa"), (1, "zzzz")], "vec_id long, page_content string").withColumn("embedding", models.letter_vector(F.col("page_content")))
    asked = spark.createDataFrame([(1, " a\na ", None), (2, "qqq", ""), (3, "zz", "Human: x\nAssistant: y")], "query_id long, question string, history string")
    got = {r.query_id: r for r in answering.answered(asked, shelf).collect()}
    assert got[1].sources == "0" and got[1].standalone == "a a" and "aaaa" in got[1].prompt
    assert got[2].answer == answering.NOTHING_FOUND and got[2].prompt is None
    assert got[3].standalone.startswith("answer ")


def test_catalog(spark):
    t = datetime.datetime(2024, 1, 1)
    outputs = spark.createDataFrame([("whole", m, t) for m in catalog.MARKERS] + [("half", catalog.MARKERS[0], t)], "dir string, file string, birthtime timestamp")
    docs = spark.createDataFrame([("whole", t), ("half", t), ("new", t)], "filename string, birthtime timestamp")
    assert sorted((r.filename, r.embedding) for r in catalog.resources(docs, outputs).collect()) == [("new", False), ("whole", True)]
    assert values(spark, ["%E4%B8%AD+\\u6587"], "string", catalog.display_name) == ["中+文"]
    maps = spark.createDataFrame([({"source": "", "file_path": "p"},), ({"source": "s"},), ({},)], "m map<string,string>")
    assert [r.l for r in maps.select(catalog.source_link(F.col("m")).alias("l")).collect()] == ["p", "s", None]
    assert maps.select(catalog.without_key(F.col("m"), F.lit("source")).alias("m")).first().m == {"file_path": "p"}


def search(edges, keyword, level):
    low = keyword.lower()
    seeds = []
    for _, h, hl, t, tl in edges:
        seeds += [h] * (low in (hl or "").lower()) + [t] * (low in (tl or "").lower())
    out, now = [], list(dict.fromkeys(seeds))
    for k in range(1, level + 1):
        met = [(k, e) for i in now for e in edges if e[1] == i]
        out += met
        now = list(dict.fromkeys(e[3] for _, e in met))
    return out


@pytest.mark.parametrize("level", [0, 1, 2, 3])
def test_bounded_search(spark, level):
    edges = [(0, "a", "Alpha", "b", "Beta"), (1, "b", "Beta", "c", None), (2, "c", None, "a", "Alpha"), (3, "d", "x", "d", "x"), (4, "a", "Alpha", "b", "Beta"), (5, "e", "E", "f", "OnlyTail")]
    df = spark.createDataFrame(edges, "ord long, head_id string, head_label string, tail_id string, tail_label string")
    for keyword in ("alph", "ALPHA", "onlytail", "x", "none", ""):
        got = call_graph.search_calls(df, keyword, level).orderBy("level", "path").collect()
        assert [(r.level, (r.ord, r.head_id, r.head_label, r.tail_id, r.tail_label)) for r in got] == search(edges, keyword, level)


def test_dot(spark):
    kind = "ord long, head_id string, head_label string, tail_id string, tail_label string, attributes map<string,string>"
    rows = [(0, "b", "B", "a", "A", None), (1, "b", "B", "a", "A", {}), (2, "a", "A", "a", "A", {"color": "red", "a": "1"})]
    got = call_graph.dot(spark.createDataFrame(rows, kind), ["ord"]).first().dot
    assert got == call_graph.DOT_HEAD + '\n"b" ["label"="B"]\n"a" ["label"="A"]\n"b" -> "a"\n"b" -> "a"\n"a" -> "a" ["a"="1","color"="red",]\n}'
    assert [r.dot for r in call_graph.dot(spark.createDataFrame([], kind), ["ord"]).collect()] == [""]


def test_enclosing_and_positions(spark):
    defs = spark.createDataFrame([("f", "outer", 0, 2000), ("f", "inner", 600, 700), ("g", "other", 0, 9)], "file string, name string, start int, stop int")
    calls = spark.createDataFrame([("f", 650), ("f", 700), ("f", 599), ("f", 2000), ("h", 1)], "file string, pos int")
    got = {(r.file, r.pos): r.enclosing for r in call_graph.enclosing(calls, defs).collect()}
    assert got == {("f", 650): "inner", ("f", 700): "outer", ("f", 599): "outer", ("f", 2000): None, ("h", 1): None}
    nodes = spark.createDataFrame([("f", 1, 1), ("f", 2, 2)], "file string, line int, column int")
    assert call_graph.is_definition(nodes, nodes.where("line = 2")).count() == 1
    assert call_graph.first_of(defs, ["file"], [F.desc("start")]).where("file = 'f'").first().name == "inner"


def test_urls(spark):
    good = ["example.com", "https://a-b.example.org:8080/x/y?q=1#top", "127.0.0.1", "HTTP://EXAMPLE.COM"]
    bad = ["", "no dots", "ftp://example.com", "https://-a.com", "a.b-", "x" * 5000 + "!"]
    assert values(spark, good + bad, "string", urls.is_url) == [True] * len(good) + [False] * len(bad)
    rows = ["a b+c", "!~*'()", "中/é", "", "%"]
    from urllib.parse import quote

    assert values(spark, rows, "string", urls.encoded) == [quote(r, safe="!~*'()") for r in rows]
    assert values(spark, rows, "string", lambda c: urls.decoded(urls.encoded(c))) == rows
    assert values(spark, ["a/../b/./c", "/../x", "../y", "./a//b", "../../z/.."], "string", urls.normal_path) == ["b/c", "/x", "../y", "a/b", "../.."]
    assert values(spark, ["a/b.c.py", ".env", "x", "d.e/f"], "string", urls.suffix) == [".py", "", "", ""]
    assert values(spark, ["a/b/c", "x"], "string", urls.folder) == ["a/b", "."]
    assert values(spark, ["x/y.git", "x"], "string", urls.without_git) == ["x/y", "x"]


def test_repositories(spark):
    rows = ["https://github.com/o/r", "https://github.com/o/r/tree/dev", "https://github.com/o/r/tree/src/lib/src/x", "https://github.com/o/r.git", "https://github.com/o/r/blob/main/a.py"]
    got = values(spark, rows, "string", urls.repository)
    assert [(g.author, g.repository, g.branch, g.res_path, g.root_name) for g in got] == [("o", "r", None, "", "r"), ("o", "r", "dev", "", "dev"), ("o", "r", "src", "lib/src/x", "x"), ("o", "r", None, "", "r"), ("o", "r", "main", "a.py", "a.py")]
    asked = remote.resolved(spark.createDataFrame([(rows[0],), (rows[1],)], "url string"), lambda api: "trunk").orderBy("url").collect()
    assert [(r.repo.branch, r.repo.url_postfix) for r in asked] == [("trunk", "?ref=trunk"), ("dev", "?ref=dev")]


def test_remote_trees(spark):
    def listing(url):
        path = url.split("/contents/")[1].split("?")[0]
        if path == "src":
            return [{"path": "src/a.py", "type": "file", "download_url": "u/a"}, {"path": "src/sub", "type": "dir", "download_url": None}, {"path": "src/link", "type": "file", "download_url": None}]
        if path == "src/sub":
            return [{"path": "src/sub/b.py", "type": "file", "download_url": "u/b"}]
        return {"path": path, "type": "file", "download_url": "u/one"}

    fetch = lambda url: url.encode()
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("r-main/x.py", "1")
    content = out.getvalue()
    got = {u: sorted((r.path, bytes(r.content)) for r in remote.repository_files(spark, u, listing, fetch, lambda api: "main", lambda name: content).collect()) for u in ("https://github.com/o/r/tree/main/src", "https://github.com/o/r/blob/main/k.py", "https://github.com/o/r")}
    assert got["https://github.com/o/r/tree/main/src"] == [("a.py", b"u/a"), ("sub/b.py", b"u/b")]
    assert len(got["https://github.com/o/r/blob/main/k.py"]) == 1 and got["https://github.com/o/r"] == [("r/x.py", b"1")]
    bases = spark.createDataFrame([("http://x/",)], "base_url string")
    assert [r.id for r in remote.models(bases, lambda url: (200, {"data": [{"id": url}]})).collect()] == ["http://x/models"]
    with pytest.raises(Exception, match="status 404"):
        remote.models(bases, lambda url: (404, {})).collect()


def test_files(spark, tmp_path):
    (tmp_path / "p/sub").mkdir(parents=True)
    for name, content in {"p/a.py": "x = 1", "p/sub/b.ts": "let é", "p/.c.py": "no", "p/d.txt": "text", "p/e.txt": " \n", "p/f.md": "# no"}.items():
        (tmp_path / name).write_text(content)
    root = str(tmp_path / "p")
    assert sorted((r.file_name, r.suffix, r.content, r.source) for r in files.code_files(spark, root).collect()) == [("a.py", ".py", "x = 1", f"{root}/a.py"), ("b.ts", ".ts", "let é", f"{root}/sub/b.ts")]
    assert files.documents(spark, f"{root}/a.py", "resource").count() == 1 and files.documents(spark, root, "resource").count() == 0
    assert [r.content for r in files.text_files(spark, root).collect()] == ["text"]
    assert files.all_files(spark, root).count() == 5 and files.one_file(spark, f"{root}/d.txt").first().content == "text"
    chunk = files.as_chunks(files.text_files(spark, root)).first()
    assert chunk.page_content == "text" and chunk.metadata["file_name"] == "d.txt"
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("root/a.py", "1")
        z.writestr("top.py", "2")
    assert sorted(r.entry_path for r in files.zip_files(spark, str(tmp_path), "new").collect()) == ["new/a.py", "top.py"]
    (tmp_path / "x.pdf").write_bytes(b"one|two")
    reader = lambda content: [(str(i + 1), t) for i, t in enumerate(content.decode().split("|"))]
    assert [(r.page_label, r.text) for r in files.pdf_pages(spark, str(tmp_path), reader=reader).collect()] == [("1", "one"), ("2", "two")]
    assert [(r.source, r.page_label, r.text) for r in files.pdf_pages(spark, str(tmp_path), True, reader).collect()] == [(None, None, "onetwo")]
    both = files.by_suffix(spark.createDataFrame([("a.py",), ("b.txt",)], "path string"), {".py": lambda d: d.withColumn("k", F.lit(1)), ".txt": lambda d: d.withColumn("k", F.lit(2))})
    assert sorted(tuple(r) for r in both.collect()) == [("a.py", 1), ("b.txt", 2)]
    rows = spark.createDataFrame([("f", 1, "b"), ("f", 0, "a")], "file string, chunk_no int, page_content string")
    payload = files.to_json_chunks(rows, "file")
    assert json.loads(payload.first().payload) == [{"page_content": "a"}, {"page_content": "b"}]
    assert [r.page_content for r in files.chunks_from_json(payload).collect()] == ["a", "b"]


def test_code():
    js = "// function no() {}\nclass A {\n  constructor() { this.m(); }\n  static m() { return go('function no()'); }\n}\nfunction go(x) { return x; }\nconst cb = list.map((y) => y);\nconst k = (z) => go(z);\n"
    assert [(d["type"], d["name"], d["start"]["line"]) for d in code.definitions_in(js, ".js")] == [("Class", "A", 2), ("Constructor", "A.constructor", 3), ("Method", "A.static.m", 4), ("Function", "go", 6), ("Function", "k", 8)]
    assert [(e["head"]["name"], e["tail"]["name"]) for e in code.calls_in(js, ".js")] == [("A.constructor", "A.static.m"), ("A.static.m", "go"), ("k", "go")]
    assert code.definitions_in("def broken(", ".py") == [] and code.definitions_in("fn x() {}", ".go") == [] and code.top_level_parts("x", ".md") is None


def test_names_of_script_functions():
    js = "const o = { run() { go(1); }, fly: function() { k(2); }, h: (a) => { go(a); } };\nclass A { f = (x) => { go(x); }\n static g = async (x) => x; get z() { return 1; } }\nlet r = /\"x{/; var v = function () { go(3); };\nlist.forEach(function (x) { go(x); });\nlist.map((y) => { return y; });\nexport default async function* last(a = {b: 1}) { if (a) { go(2); } }\n"
    assert [(d["type"], d["name"]) for d in code.definitions_in(js, ".js")] == [("Function", "run"), ("Function", "fly"), ("Function", "h"), ("Class", "A"), ("Method", "A.f"), ("Method", "A.static.g"), ("Method", "A.z"), ("Function", "v"), ("Function", "last")]
    for suffix in (".js", ".py", ".java", ".cs", ".cpp", ".go", ".php", ".rb", ".ts"):
        for text in ("", "{", "}", "class", "def f(", "/* never closed {", "'", "func f() {", ")" * 50, "({[" * 50 + "}", "x" * 10_000, "\n\n"):
            code.definitions_in(text, suffix), code.calls_in(text, suffix), code.imports_in(text, suffix)
            assert "".join("".join(code.top_level_parts(text, suffix)).split()) == "".join(text.split())


def test_code_is_scanned_in_linear_time():
    import time

    texts = {".ts": lambda n: "function f(x) { return { a: [1, (2)] }; }\n" * n, ".java": lambda n: "class A { int m(int x) { if (x) { return m(x); } } }\n" * n, ".go": lambda n: "func f(x int) int { return f(x) }\n" * n, ".rb": lambda n: "def f(x)\n f(x)\nend\n" * n, ".py": lambda n: "def f(x): # c\n    return f(x)\n" * n, ".js": lambda n: "(" * n + "{" * n}
    for suffix, text in texts.items():
        took = []
        for n in (1_000, 4_000):
            began = time.process_time()
            code.calls_in(text(n), suffix), code.top_level_parts(text(n), suffix)
            took.append(time.process_time() - began)
        assert took[1] < 10 * took[0] + 0.3, (suffix, took)


def test_python_pieces_keep_decorators_and_comments():
    text = "# head\n'doc'\nimport os  # why\n\n@a.b(1)\n@c\n# inner\nasync def f(x):\n    # body\n    return 'é'\n# between\nx = 1; y = 2\n@d\nclass K:\n    pass\n"
    assert code.top_level_parts(text, ".py") == ["# head", "'doc'", "import os", "# why", "@a.b(1)\n@c\n# inner\nasync def f(x):\n    # body\n    return 'é'", "# between", "x = 1", "y = 2", "@d\nclass K:\n    pass"]
    assert code.top_level_parts("def broken(", ".py") == ["def broken("] and code.top_level_parts("  \n", ".py") == []


def test_odd_archives(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("r/good.py", "x = 1")
        z.writestr("r/bad.py", "y" * 1000)
        z.writestr("r/.hidden.py", "z")
    content = bytearray(out.getvalue())
    at = content.find(b"r/bad.py") + len(b"r/bad.py")
    content[at : at + 4] = b"\xff\xff\xff\xff"
    rows = spark.createDataFrame([("a", content), ("b", None), ("c", bytearray()), ("d", bytearray(b"junk"))], "path string, content binary")
    got = sorted(((r.path, r.entry_path, r.content and bytes(r.content)) for r in files.zip_entries(rows, "n").collect()), key=str)
    assert got == [("a", "n/.hidden.py", b"z"), ("a", "n/bad.py", None), ("a", "n/good.py", b"x = 1"), ("d", None, None)]


def test_written_files(spark, tmp_path):
    rows = spark.createDataFrame([("a/b.txt", bytearray(b"one")), ("c.txt", None)], "path string, content binary")
    assert sorted(map(tuple, files.written(rows, f"file://{tmp_path}/out").collect())) == [("a/b.txt", 3), ("c.txt", 0)]
    assert (tmp_path / "out/a/b.txt").read_text() == "one" and (tmp_path / "out/c.txt").read_text() == ""
    for bad in ("../x", "a/../../x", ""):
        with pytest.raises(Exception, match="no path inside"):
            files.written(spark.createDataFrame([(bad, bytearray(b"x"))], "path string, content binary"), f"file://{tmp_path}/out").collect()


def test_json_texts_are_compared_by_value(spark):
    rows = [('{"a": 1, "b": [1, {"c": null}]}', '{"b":[1,{"c":null}],"a":1}', True), ('{"a": 1}', '{"a": 2}', False), (None, None, True), (None, "{}", False), ("no json", "no json", True), ("[1, 2]", "[2, 1]", False)]
    got = spark.createDataFrame(rows, "a string, b string, same boolean").select("same", T.same_json(F.col("a"), F.col("b")).alias("got")).collect()
    assert all(r.same == r.got for r in got)


def test_models_stream_and_are_switched(spark):
    prompts = spark.createDataFrame([("p", "one two three"), ("q", None), ("r", "")], "stream_id string, prompt string")
    pieces = models.deltas(prompts, lambda text: (w + " " for w in text.split()))
    assert sorted(map(tuple, pieces.collect())) == [("p", 0, "one "), ("p", 1, "two "), ("p", 2, "three ")]
    assert [(r.stream_id, r.content) for r in deltas.accumulated(pieces).collect()] == [("p", "one two three ")]
    makers = {"upper": lambda mark: lambda text: text.upper() + mark, "lower": lambda mark: lambda text: text.lower() + mark}
    row = prompts.where("stream_id = 'p'").select(models.provider("upper", makers, mark="!")(F.col("prompt")).alias("a"), models.provider("lower", makers, mark="?")(F.col("prompt")).alias("b")).first()
    assert tuple(row) == ("ONE TWO THREE!", "one two three?")
    with pytest.raises(ValueError, match="unknown provider"):
        models.provider("none", makers)
    tries = []

    def flaky(x):
        tries.append(x)
        if len(tries) < 3:
            raise ConnectionError("no")
        return x

    assert models.retrying(flaky)(7) == 7 and tries == [7, 7, 7]
    with pytest.raises(ZeroDivisionError):
        models.retrying(lambda: 1 / 0, attempts=2)()
    ids = spark.createDataFrame([("gpt-4",), ("ada",), (None,)], "id string")
    assert [r.id for r in models.with_prefix(ids).collect()] == ["gpt-4"]


def test_store(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert not store.exists(spark, path, "r=1 中")
    store.save(rows, path, "r=1 中")
    store.save(rows.limit(1), path, "two")
    assert store.exists(spark, path, "r=1 中") and store.load(spark, path, "r=1 中").count() == 2
    with pytest.raises(FileExistsError):
        store.save(rows, path, "two")
    store.delete(spark, path, "r=1 中")
    assert not store.exists(spark, path, "r=1 中") and store.load(spark, path, "two").count() == 1
    assert store.from_bytes(spark, store.to_bytes(rows)).count() == 2


def test_streams_equal_their_batch(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    rows = [{"stream_id": s, "seq": i, "chunk": f"{s}{i} "} for s in "abc" for i in range(5)]
    for k in range(3):
        (source / f"{k}.json").write_text("\n".join(json.dumps(r) for r in rows[2 - k :: 3]))
    stream = deltas.delta_stream(spark, str(source), 1)
    keep = lambda df, n: df.write.mode("overwrite").parquet(str(tmp_path / "out"))
    deltas.relayed(deltas.accumulated(stream), keep, str(tmp_path / "cp"), "complete").awaitTermination()
    table = spark.createDataFrame([(r["stream_id"], r["seq"], r["chunk"]) for r in rows], "stream_id string, seq long, chunk string")
    want = sorted(tuple(r) for r in deltas.accumulated(table).collect())
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == want
    assert want[0] == ("a", "a0 a1 a2 a3 a4 ", 5)
    assert sorted(r.chunk for r in deltas.first_chunks(table).collect()) == ["a0 ", "b0 ", "c0 "]
    raw = spark.createDataFrame([("s", 0, 'data: {"result":"x"}\ndata: {"result":"y"}')], "stream_id string, seq long, chunk string")
    assert deltas.accumulated(deltas.sse_deltas(raw)).first().content == "xy"


def test_events_of_large_chunks_keep_their_order(spark):
    chunk = lambda name, n: "\n".join(f'data: {{"result":"{name}{k} "}}' for k in range(n))
    raw = spark.createDataFrame([("s", 2, chunk("b", 1200)), ("s", 1, chunk("a", 1500))], "stream_id string, seq long, chunk string")
    events = deltas.sse_deltas(raw)
    got = deltas.accumulated(events).first()
    assert got.content == "".join(f"{x}{k} " for x, n in (("a", 1500), ("b", 1200)) for k in range(n)) and got.chunks == 2700
    assert deltas.first_chunks(events).first().chunk == "a0 "


def test_cancel(spark):
    assert deltas.cancellable(spark, "job-1", lambda: spark.range(3).count()) == 3
    assert deltas.cancel(spark, "job-1") == []
    assert "job-1" not in spark.getTags()


def test_entry_without_the_llm_folder(tmp_path):
    """The entry imports, and its other queries stay, when the llm folders are gone."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "tessera"), tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') for k in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert said.returncode == 0, said.stderr
    assert said.stdout.split()[-1] == "False" and int(said.stdout.split()[-2]) > 60


def test_many_queries_go_in_blocks_and_slices(spark, monkeypatch):
    rnd = np.random.default_rng(3)
    rows = [(i, rnd.normal(size=4).tolist()) for i in range(60)]
    index = vector_index.FlatIndex(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3))
    queries = spark.createDataFrame(rows, "query_id long, embedding array<double>")
    want = sorted(map(tuple, index.search_batch(queries, 3).collect()))
    monkeypatch.setattr(vector_index, "QUERY_BLOCK", 25)
    monkeypatch.setattr(vector_index, "QUERY_SLICE", 4)
    assert sorted(map(tuple, index.search_batch(queries, 3).collect())) == want and len(want) == 180


def test_vectors_without_a_distance_are_never_found(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [1.0]), (4, [0.5, 0.5]), (5, [None, 1.0]), (6, [nan, 1.0]), (7, []), (8, [0.0, 1.0, 2.0])]
    index = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = [(10, [1.0, 0.1]), (11, None), (12, [1.0]), (13, [])]
    queries = spark.createDataFrame(asked, "query_id long, embedding array<double>")
    for metric, want in (("l2", [0, 4, 2]), ("cosine", [0, 4]), ("inner_product", [0, 4, 2]), ("jaccard", [0, 4, 2])):
        flat = vector_index.make_index(index, metric=metric)
        assert [r.vec_id for r in flat.search([1.0, 0.1], 9).orderBy("rank").collect()] == want, metric
        found = {}
        for r in flat.search_batch(queries, 9).orderBy("query_id", "rank").collect():
            found.setdefault(r.query_id, []).append(r.vec_id)
        assert found == {10: want, 12: [3]}, metric
    assert vector_index.make_index(index).search([], 3).where("distance > 0").count() == 0


def test_further_columns_may_have_any_names(spark):
    """Graph search, rendering, lookups, the catalog and the index beside columns with the names that they use."""
    names = ("id", "level", "path", "text", "lines", "first", "label", "n", "o", "rank", "distance", "b", "by", "side", "found", "m0", "key2", "query_id", "v", "removed")
    clash = lambda df: df.withColumns({c: F.lit("clash") for c in names if c not in df.columns})
    edges = spark.createDataFrame([(0, "a", "A", "b", "B"), (1, "b", "B", "c", None), (2, "c", None, "a", "A")], "ord long, head_id string, head_label string, tail_id string, tail_label string")
    plain, odd = call_graph.search_calls(edges, "a", 2), call_graph.search_calls(clash(edges), "a", 2)
    assert sorted((r.level, r.ord, r.path) for r in odd.collect()) == sorted((r.level, r.ord, r.path) for r in plain.collect())
    assert call_graph.dot(clash(edges), ["ord"]).first().dot == call_graph.dot(edges, ["ord"]).first().dot
    assert sorted(call_graph.code_mapping(clash(edges)).collect()) == sorted(call_graph.code_mapping(edges).collect())
    vectors = spark.createDataFrame([(3, [1.0, 0.0]), (7, [0.0, 1.0])], "vec_id long, embedding array<double>")
    index = vector_index.FlatIndex(clash(vectors))
    assert [(r.vec_id, r["rank"]) for r in index.search([1.0, 0.1], 2).orderBy("rank").collect()] == [(3, 1), (7, 2)]
    asked = clash(vectors).withColumn("query_id", F.col("vec_id"))
    assert [tuple(r)[:3] for r in index.search_batch(asked, 1).orderBy("query_id").collect()] == [(3, 1, 3), (7, 1, 7)]
    left, removed = index.remove(clash(vectors).where("vec_id = 3"))
    assert removed.first().removed == 1 and [r.vec_id for r in left.rows.collect()] == [0]
    assert sorted(r.vec_id for r in index.add(clash(vectors), "vec_id").rows.collect()) == [2, 3, 3, 7]
    files_ = spark.createDataFrame([("d", "docstore.json"), ("d", "faiss.index"), ("e", "docstore.json")], "dir string, file string").withColumn("birthtime", F.lit("2020-01-01").cast("timestamp"))
    docs = spark.createDataFrame([("f",), ("d",)], "filename string").withColumn("birthtime", F.lit("2020-01-02").cast("timestamp"))
    assert [(r.filename, r.embedding) for r in catalog.resources(clash(docs), clash(files_)).collect()] == [("d", True), ("f", False)]
    store_ = spark.createDataFrame([("k", "1"), ("l", "2")], "key string, value string")
    assert sorted(map(tuple, catalog.upserted(clash(store_), clash(store_.where("key = 'k'")).withColumn("value", F.lit("9"))).collect())) == [("k", "9"), ("l", "2")]
