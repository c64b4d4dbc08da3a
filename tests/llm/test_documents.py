import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate, licenses, quality, secrets, sharding, simhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def multiset(rows):
    return Counter(map(repr, rows))


def test_shards_hold_the_mixture(docs):
    shards = 16
    rows = sharding.interleaved(docs, shards).collect()
    want = [(r.doc_id, r.source, len((r.text or "").encode()) + 1, None if r.text is None else zlib.crc32(r.text.encode())) for r in docs.collect()]
    assert multiset([tuple(r)[:4] for r in rows]) == multiset(want)
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    sizes = [len(by[k]) for k in range(shards)]
    assert sum(sizes) == len(want) and max(sizes) - min(sizes) <= 1
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    total = Counter(r.source for r in rows)
    for source, n in total.items():
        for own in by.values():
            assert abs(sum(r.source == source for r in own) - n / shards) < 2 + len(total) / 8
    assert multiset(sharding.interleaved(docs, shards).collect()) == multiset(rows)


def seeded_hash(seed, *values):
    import struct

    import xxhash

    h = xxhash.xxh64_intdigest(struct.pack("<i", seed), 42)
    for v in values:
        h = h if v is None else xxhash.xxh64_intdigest(struct.pack("<q", v), h)
    return h >> 1


def test_shards_follow_the_seeded_order(docs):
    """The whole order by brute force: rows of a source by their hash, all rows by the fraction of their source before them."""
    shards = 7
    rows = [(r.doc_id, r.source, len((r.text or "").encode()) + 1, None if r.text is None else zlib.crc32(r.text.encode())) for r in docs.collect()]
    first = lambda x: (x is not None, x or 0)
    key = lambda r: (seeded_hash(sharding.SEED, r[0], r[3], r[2]), first(r[0]), first(r[3]), r[2])
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    ordered = [((2 * k + 1) / (2.0 * len(own)), (source is not None, source or ""), key(r), r) for source, own in by.items() for k, r in enumerate(sorted(own, key=key))]
    want, n = [], len(rows)
    for position, (*_, r) in enumerate(sorted(ordered, key=lambda x: x[:3])):
        shard = (shards * (position + 1) - 1) // n
        want.append((*r, shard, position - shard * n // shards))
    assert multiset(map(tuple, sharding.interleaved(docs, shards).collect())) == multiset(want)


def test_written_shards_are_in_slot_order(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sharding.write_shards(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and back.select("shard_no").distinct().count() == 4


def brute_measures(text):
    text = text or ""
    words = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), n < 10 or 100 * len(hit) > 20 * n


def test_quality_measures(docs):
    rows = quality.verdicts(docs).collect()
    want = [(r.doc_id, *brute_measures(r.text)) for r in docs.collect()]
    assert multiset([tuple(r)[:7] for r in rows]) == multiset(want)
    assert not any(r.base_failed and r.kept for r in rows)
    kept = quality.filtered(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in rows)


def prose(rnd, n, low, high):
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(low, high))) + ("." if k % 9 == 8 else "") for k in range(n))


def test_quality_thresholds_follow_the_group(spark):
    """The same texts are usual in one source and odd in another; long words are usual in one language only."""
    rnd = random.Random(3)
    rows = [(k, prose(rnd, 80, 1, 9), "en", "web") for k in range(400)]
    rows += [(1000 + k, prose(rnd, 80, 1, 9).replace(" ", " # "), "en", "code") for k in range(400)]
    rows += [(2000 + k, prose(rnd, 80, 6, 24), "de", "web") for k in range(400)]
    rows += [(5000, prose(rnd, 80, 1, 9).replace(" ", " # "), "en", "web"), (5001, prose(rnd, 80, 6, 24), "en", "web"), (5002, prose(rnd, 80, 1, 9), "de", "web")]
    rows += [(6000, prose(rnd, 12, 1, 9), "en", "web"), (6001, prose(rnd, 5000, 1, 9), "en", "web")]
    out = {r.doc_id: r.kept for r in quality.verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert {k for k, kept in out.items() if not kept} == {5000, 5001, 5002}


def test_quality_bounds_hold_under_copies_and_junk(spark):
    """Copies that fill over half of a group do not narrow its bounds to a point, and a fifth of junk does not widen them."""
    rnd = random.Random(4)
    copy = prose(rnd, 90, 1, 9)
    rows = [(k, copy, "en", "hot") for k in range(300)] + [(1000 + k, prose(rnd, 90, 1, 9), "en", "hot") for k in range(200)]
    rows += [(2000 + k, prose(rnd, 90, 1, 9), "en", "web") for k in range(400)] + [(3000 + k, prose(rnd, 90, 1, 9).replace(" ", "### "), "en", "web") for k in range(100)]
    out = {r.doc_id: r.kept for r in quality.verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(kept == (k < 3000) for k, kept in out.items())


def test_few_documents_are_judged_by_the_base_rule_only(spark):
    rows = [(k, prose(random.Random(k), 30, 1, 9 + 60 * (k == 1)), "en", "web") for k in range(50)]
    assert all(r.kept for r in quality.verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect())


def test_sketch_quantile_is_near(spark):
    df = spark.range(0, 10_000).select(*(quality.bucket(F.col("id"), bits).alias(f"b{bits}") for bits in (6, 10)), "id")
    for r in df.collect():
        assert r.b6 <= r.id <= r.b6 * 33 / 32 + 1 and r.b10 <= r.id <= r.b10 * 513 / 512


def test_quality_equals_brute_force(spark, sf):
    from tests_llm_brute import brute_kept

    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    got = {r.doc_id: r.kept for r in quality.verdicts(docs).collect()}
    rows = docs.collect()
    assert got == {r.doc_id: ok for r, ok in zip(rows, brute_kept(rows))}
    assert 0 < sum(not x for x in got.values()) < len(rows) / 3


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def brute_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


NAMED = re.compile(r"""((?i:pwd|passphrase|credential|bearer|(?:private|access|auth)_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{12,})""", re.A)


def brute_candidates(text, base):
    """(start, kind, end, secret)"""
    apart = lambda a, b, spans: all(x[2] <= a or b <= x[0] for x in spans)
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}", text or ""):
        if re.search("[0-9]", m[0]) and re.search("[A-Z]", m[0]) and re.search("[a-z]", m[0]) and apart(*m.span(), base):
            out.append((m.start(), 3, m.end(), m[0]))
    named = [(m.start(), 3, m.end(), m[2]) for m in NAMED.finditer(text or "") if re.search("[0-9]", m[2]) and re.search("[A-Za-z]", m[2]) and apart(*m.span(), base) and apart(*m.span(), out)]
    return out + named


def secret_of(text, span):
    return re.sub(r"""^[A-Za-z_]+["']?\x20*[:=]\x20*["']?""", "", text[span[0] : span[2]])


def test_secret_spans(docs):
    rows = docs.collect()
    owners, repositories = defaultdict(set), defaultdict(set)
    for r in rows:
        base = brute_spans(r.text)
        for x in base + brute_candidates(r.text, base):
            owners[secret_of(r.text, x)].add(r.source)
            repositories[secret_of(r.text, x)].add((r.source, r.lang))
    want = []
    for r in rows:
        base = brute_spans(r.text)
        told = []
        for x in base + [c[:3] for c in brute_candidates(r.text, base)]:
            n, m = len(owners[secret_of(r.text, x)]), len(repositories[secret_of(r.text, x)])
            if x[1] < 3 or n == 1 and m <= 4:
                told.append((*x, n == 1 and m <= 4, n, m))
        want.append((r.doc_id, base, sorted(told)))
    got = [(r.doc_id, [(s.start, s.kind, s.stop) for s in r["__ts_base"]], [(s.start, s.kind, s.stop, s.live, s.n_owners, s.n_repositories) for s in r["__ts_spans"]]) for r in secrets.scanned(docs, ["doc_id"]).collect()]
    assert multiset(got) == multiset(want)


def test_copied_examples_are_told_from_live_secrets(spark):
    shared, own, spread = "Ab1" * 8, "Zx9" * 8, "Qw7" * 8
    rows = [(k, f"use {shared} here, AKIA{'Z' * 16}", "en", f"s{k}") for k in range(5)] + [(9, f"use {own} here", "en", "s1"), (10, f"use {own} here, pwd: {'k4' * 6}", "fr", "s1")] + [(20 + k, f"{spread}", f"l{k}", "s1") for k in range(5)]
    got = {r.doc_id: [(s.value, s.live, s.n_owners, s.n_repositories) for s in r["__ts_spans"]] for r in secrets.scanned(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), ["doc_id"]).collect()}
    assert got[9] == [(own, True, 1, 2)] and got[10] == [(own, True, 1, 2), (f"pwd: {'k4' * 6}", True, 1, 1)]
    assert all(got[k] == [(f"AKIA{'Z' * 16}", False, 5, 5)] for k in range(5)) and all(got[20 + k] == [] for k in range(5))


def test_secrets_are_masked(edge):
    out = secrets.redacted(edge)
    assert out.columns == edge.columns and out.count() == edge.count()
    texts = {r.doc_id: r.text for r in out.collect()}
    before = {r.doc_id: r.text for r in edge.collect()}
    for i, text in texts.items():
        spans = [(a, b) for a, _, b in brute_spans(before[i])]
        for *_, value in brute_candidates(before[i], brute_spans(before[i])):
            assert value not in text
        assert ("[SECRET]" in (text or "")) >= bool(spans)
    assert texts[12] == before[12] and texts[2] is None


def brute_fingerprint(text):
    import xxhash

    words = WORDS.findall((text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    """prints: (doc_id, fingerprint). Every two distinct fingerprints are compared."""
    distinct = sorted({f for _, f in prints})
    root = {f: f for f in distinct}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    smallest = {}
    for d, f in prints:
        if d is not None:
            smallest[find(f)] = min(d, smallest.get(find(f), d))
    return [(d, f, smallest.get(find(f))) for d, f in prints]


def test_simhash_components(docs):
    got = [(r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.components(docs).collect()]
    assert multiset(got) == multiset(brute_components([(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()]))
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect() if r.doc_id is not None]
    assert sorted(ids) == sorted({c for d, _, c in got if d is not None and d == c})


def test_deduplicate_keeps_one_row_of_each_component(spark):
    words = "abcdefghijklmnopqrstuvwxyz"
    long = lambda k: " ".join(f"{a}{b}{k}" for a in words for b in words)
    rows = [(None, long(1)), (5, long(1)), (None, long(2)), (None, long(2)), (7, long(3)), (7, long(4)), (8, long(4)), (8, long(5)), (9, long(5)), (9, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, (r.text or "")[:3]) for r in simhash.deduplicate(docs).collect())
    component = {r.fp: [] for r in simhash.components(docs).collect()}
    assert len(component) == 6  # five texts and the empty one, all far from each other
    assert got == Counter([(5, "aa1"), (None, "aa2"), (7, "aa3"), (7, "aa4"), (8, "aa5"), (9, "")])


@pytest.mark.parametrize("seed", [1, 4])
def test_pigeonring_loses_no_link(spark, seed):
    rnd = random.Random(seed)
    prints = set()
    for _ in range(20):
        centre = rnd.getrandbits(64)
        for _ in range(25):
            x = centre
            for _ in range(rnd.randint(0, 4)):
                x ^= 1 << rnd.randrange(64)
            prints.add(x)
    chain = rnd.getrandbits(64)
    for b in range(0, 40, 2):
        chain ^= 3 << b
        prints.add(chain)
    rows = [(f - (1 << 64) if f >> 63 else f,) for f in prints]
    from tessera.plans.components import roots

    found = {r.node: r.root for r in roots(simhash.links(spark.createDataFrame(rows, "fp long"))).collect()}
    classes = defaultdict(set)
    for (f,) in rows:
        classes[found.get(f, f)].add(f % (1 << 64))
    want = defaultdict(set)
    for _, f, c in brute_components([(k, f) for k, f in enumerate(sorted(prints))]):
        want[c].add(f)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, want.values()))


def test_every_near_pair_shares_a_chain_key(spark):
    rnd = random.Random(2)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    base = rnd.getrandbits(64)
    pairs = [(signed(base), signed(base ^ (1 << i) ^ (1 << j))) for i in range(64) for j in range(i, 64)]
    shared = F.size(F.array_intersect(simhash.chain_keys(F.col("u")), simhash.chain_keys(F.col("v"))))
    assert spark.createDataFrame(pairs, "u long, v long").where(shared == 0).isEmpty()
    far = [(signed(rnd.getrandbits(64)), signed(rnd.getrandbits(64))) for _ in range(2000)]
    assert spark.createDataFrame(far, "u long, v long").where(shared > 0).count() < 3


def test_one_large_bucket_is_linear_work(spark):
    """2**15 fingerprints that share 49 bits: pairs would be 2**29."""
    from tessera.plans.components import roots

    prints = spark.range(1 << 15).select((F.col("id") * 2 + (5 << 40)).alias("fp"))
    found = roots(simhash.links(prints))
    assert found.count() == (1 << 15) - 1 and found.select("root").distinct().count() == 1


BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_contamination(text, items):
    words = BENCH_WORD.findall((text or "").translate(LOWER))
    hit, names = set(), set()
    for item, other in items:
        w = BENCH_WORD.findall((other or "").translate(LOWER))
        n = min(13, len(w))
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(words) - n + 1 if n else 0):
            if tuple(words[i : i + n]) in windows:
                hit.update(range(i, i + n))
                if item is not None:
                    names.add(str(item))
    return len(words), len(hit), sorted(names), bool(hit) and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("block_bytes", [decontaminate.BLOCK_BYTES, 3000])
def test_contamination(spark, sf, docs, block_bytes):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()] + [(900, "five six"), (901, None), (902, "..."), (None, "iota kappa"), (900, "straße")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.found.n_words, r.found.n_hit, r.found["items"], r.bad) for r in decontaminate.with_digest(docs, bench, "found", block_bytes=block_bytes).withColumn("bad", decontaminate.is_contaminated(F.col("found"))).collect()]
    want = [(r.doc_id, *brute_contamination(r.text, items)) for r in docs.collect()]
    assert multiset(got) == multiset(want)
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(not w[-1] for w in want)


def test_contaminated_spans_can_go(spark, edge):
    bench = spark.createDataFrame([(1, "three FOUR five")], "item_id long, text string")
    out = {r.doc_id: r.text for r in decontaminate.decontaminate(edge, bench, remove="spans").collect()}
    assert out[7] == "one two  six seven eight nine ten one two " and out[2] is None
    none = decontaminate.decontaminate(edge, bench.limit(0))
    assert none.count() == edge.count()


def test_licences(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    path = F.concat(F.lit("src/lib/f"), F.col("doc_id").cast("string"))
    clashing = docs.withColumns({c: F.lit("clash") for c in ("row", "licence", "score", "holder", "held", "folder", "of", "n", "unit", "units", "kind", "at", "size", "up", "steps_up")})
    got = licenses.scanned(clashing, clashing.columns, path, F.col("text"), F.lit(True)).collect()
    assert len(got) == len(rows)
    own = {r.doc_id: r.own_licence for r in got}
    for r in rows:
        if r.text and not re.search(licenses.SPEAKS[4:], r.text, re.I):
            assert own[r.doc_id] is None
    if 11 in own and len(rows) < 50:
        assert own[11] in ("MIT", "CC-BY-NC-4.0")
        assert {r.licence for r in got if r.doc_id not in (11, None)} == {own[11]}


def test_licences_come_from_the_nearest_folder(spark):
    rows = [("LICENSE", "Released under the MIT License."), ("a/LICENSE", "Licensed under the Apache License, Version 2.0."), ("a/b/x.py", "code"), ("a/b/c/y.py", "SPDX-License-Identifier: GPL-3.0\ncode"), ("z/q.py", "code"), ("top.py", None), (None, "code"), ("a/b/c/w.py", "")]
    files = spark.createDataFrame(rows, "path string, text string")
    got = {r.path: (r.own_licence, r.licence, r.inherited_from) for r in licenses.scanned(files, ["path"], F.col("path"), F.col("text"), F.col("path").rlike("(^|/)LICENSE$")).collect()}
    assert got["a/b/x.py"] == (None, "Apache-2.0", "a") and got["a/b/c/w.py"] == (None, "Apache-2.0", "a")
    assert got["a/b/c/y.py"] == ("GPL-3.0", "GPL-3.0", None) and got["z/q.py"] == (None, "MIT", "") and got["top.py"] == (None, "MIT", "")
    assert got[None] == (None, None, None)


def brute_cosine(line):
    import math

    lines = [(name, x) for _, name, x in licenses.template_lines()]
    terms = lambda s: Counter(re.findall(licenses.TERM, s.lower()))
    df = Counter(t for _, x in lines for t in terms(x))
    idf = lambda t: math.log((1 + len(lines)) / (1 + df[t])) + 1
    vector = lambda s: {t: n * idf(t) for t, n in terms(s).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    v = vector(line)
    return max((round(sum(x * vector(t).get(k, 0) for k, x in v.items()) / norm(v) / norm(vector(t)), 9), name) for name, t in lines)


def test_licence_cosines(spark, sf):
    lines = {x for r in spark.read.parquet(f"{sf}/documents.parquet").collect() for x in r.text.split("\n") if re.search("licen", x, re.I)}
    rows = [(k, [(licenses.LINE, x)]) for k, x in enumerate(sorted(lines))]
    got = {r.row: (r.licence, r.score) for r in licenses.own_licences(spark.createDataFrame(rows, "row long, units array<struct<kind:int,x:string>>"), 0.0).collect()}
    for k, ((_, x),) in rows:
        score, name = brute_cosine(x)
        assert got[k][1] == pytest.approx(score, abs=2e-9)


def test_long_notices_among_other_words(spark):
    """Templates of more than SHORT terms: whole, without their first two terms, and with words changed, between 300 words of prose."""
    prose = "the quick brown fox jumps over a lazy dog and this permission of you runs far away from all other animals in its dark green wood " * 12
    rows, want = [], {}
    for template, name, line in licenses.template_lines():
        terms = line.split()
        if len(re.findall(licenses.TERM, line.lower())) > licenses.SHORT:
            for text in (line, " ".join(terms[2:]), " ".join("words" if k % 9 == 8 else t for k, t in enumerate(terms))):
                want[len(rows)] = name
                rows.append((len(rows), prose + text + " " + prose))
    rows += [(900, prose + " licence " + prose), (901, None), (902, "license " + "this permission " * 5000)]
    files = spark.createDataFrame(rows, "row int, text string")
    got = {r.row: r.licence for r in licenses.own_licences(files.select("row", licenses.units_of(F.col("text"), F.lit(False)).alias("units"))).collect()}
    assert len(want) >= 15 and {k: got.get(k) for k in want} == want
    assert not {900, 901, 902} & got.keys()


def test_notices_among_other_words(spark):
    prose = "the quick brown fox jumps over a lazy dog and runs far away from all other animals in its dark green wood "
    grant = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including the rights to use, copy, modify, merge and sell copies"
    want = {
        'Copyright 2024 Example Corp. Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.': "Apache-2.0",
        grant: "MIT",
        prose + "Released under the MIT License.": "MIT",
        prose * 500 + "Licensed under CC BY-NC 4.0. " + prose * 500: "CC-BY-NC-4.0",
        "MIT": None,
        prose + "The files of this folder are licensed under the licence that the author chose for them, as is the case for " + prose: None,
        prose + "all drivers need a license": None,
        "": None,
        "...": None,
    }
    mit = next(x for x in licenses.TEXTS["MIT"])
    wrapped = "\n".join("# " + " ".join(mit.split()[i : i + 9]) for i in range(0, len(mit.split()), 9))
    want |= {
        f"#!/bin/sh\n{wrapped}\n\n{prose * 20}": "MIT",
        prose + "\n" + prose + "\n# Licensed under the\n# Apache License,\n# Version 2.0\n" + prose: "Apache-2.0",
        "\n".join(licenses.TEXTS["GPL-3.0"][0].split()): "GPL-3.0",
        f"{licenses.TEXTS['ISC'][0]}\n\n{prose * 50}": "ISC",
    }
    files = spark.createDataFrame(list(enumerate(want)), "k int, text string")
    got = {r.text: r.own_licence for r in licenses.scanned(files, ["k", "text"], F.col("k").cast("string"), F.col("text"), F.lit(False)).collect()}
    assert got == want


def test_inheritance_by_brute_force(spark):
    """Every folder of a random tree; licences stand in few of its files."""
    rnd = random.Random(5)
    notices = {"MIT": "Released under the MIT License.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.", "GPL-3.0": "SPDX-License-Identifier: GPL-3.0"}
    rows = []
    for k in range(300):
        folder = [rnd.choice("abc") for _ in range(rnd.randint(0, 4))]
        is_file = rnd.random() < 0.1
        name = rnd.choice([*notices, None]) if is_file else rnd.choice([*notices, *[None] * 20])
        rows.append((k, "/".join([*folder, f"f{k}"]), notices.get(name, "words"), is_file, name))
    held = {}
    for _, path, _, is_file, name in rows:
        if is_file and name:
            folder = path.rpartition("/")[0]
            held[folder] = min(held.get(folder, name), name)  # all scores are 1
    files = spark.createDataFrame([r[:4] for r in rows], "k int, path string, text string, is_file boolean")
    got = {r.k: (r.own_licence, r.licence, r.inherited_from, r.steps_up) for r in licenses.scanned(files, ["k"], F.col("path"), F.col("text"), F.col("is_file")).collect()}
    seen = set()
    for k, path, _, _, name in rows:
        parts = path.split("/")[:-1]
        up = next((i for i in range(len(parts) + 1) if "/".join(parts[: len(parts) - i]) in held), None)
        holder = None if up is None else "/".join(parts[: len(parts) - up])
        assert got[k] == (name, name or held.get(holder), None if name else holder, None if name else up)
        seen.add(up)
    assert {0, 1, 2} <= seen


def test_hash_of_a_secret_is_of_its_value(spark):
    df = spark.createDataFrame([("token = 'abcdefghijkl", 0), ("AKIAX", 1)], "value string, kind int").select(secrets.secret_hash(F.struct("value", "kind")).alias("h"))
    assert [r.h for r in df.collect()] == [hashlib.sha256(x).hexdigest() for x in (b"abcdefghijkl", b"AKIAX")]
