"""The pipeline without Spark, from the other tests' brute-force parts."""

import re
from collections import Counter, defaultdict

from test_documents import brute_candidates, brute_components, brute_contamination, brute_fingerprint, brute_measures, brute_spans, secret_of

MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def bucket(v):
    drop = max(0, len(f"{v:b}") - 10)
    return v >> drop << drop


def brute_kept(docs):
    rows = []
    for r in docs:
        n, chars, _, _, _, failed = brute_measures(r.text)
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        marks, short = sum(c in MARKS for c in r.text or ""), sum(len(w) <= 3 for w in words)
        rows.append(((r.lang, r.source), failed, n, (chars * 10000 // max(n, 1), marks * 10000 // max(chars, 1), short * 10000 // max(n, 1))))
    groups = defaultdict(list)
    for key, _, n, ratios in rows:
        for g in (("own", *key), ("lang", key[0]), ("all",)):
            groups[g].append((n, *ratios))

    def quartiles(g, k):
        ordered = sorted(bucket(x[k]) for x in groups[g])
        return [next(v for v in ordered if 4 * sum(1 for y in ordered if y <= v) >= q * len(ordered)) for q in (1, 2, 3)]

    quarter = lambda g, k: min(b - a for a, b in zip(quartiles(g, k), quartiles(g, k)[1:]))

    def limits(key):
        g = next((g for g in (("own", *key), ("lang", key[0]), ("all",)) if len(groups[g]) >= 200), None)
        sources = [x for x in groups if x[:2] == ("own", key[0]) and len(groups[x]) >= 200]
        usual = lambda k: sorted((quarter(x, k) for x in sources), reverse=True)[(len(sources) - 1) // 2] if sources else 0
        return g and (quartiles(g, 0)[1], [(quartiles(g, k)[1], 10 * max(quarter(g, k), usual(k))) for k in (1, 2, 3)])

    known = {key: limits(key) for key in {r[0] for r in rows}}

    def inside(key, n, ratios):
        if not known[key]:
            return True
        words, bounds = known[key]
        return all(not reach or (v - median) ** 2 * n <= reach**2 * max(n, words) for v, (median, reach) in zip(ratios, bounds))

    return [not failed and inside(key, n, ratios) for key, failed, n, ratios in rows]


def masked(text, spans):
    merged = []
    for a, b in spans:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in reversed(merged):
        text = text[:a] + "[SECRET]" + text[b:]
    return text


def brute_pipeline(spark, sf, docs):
    docs = [r for r, ok in zip(docs, brute_kept(docs)) if ok]
    component = {d: c for d, _, c in brute_components([(r.doc_id, brute_fingerprint(r.text)) for r in docs])}
    docs = [r for r in docs if component[r.doc_id] == r.doc_id]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = [r for r in docs if not brute_contamination(r.text, items)[-1]]
    owners, repositories = defaultdict(set), defaultdict(set)
    for r in docs:
        base = brute_spans(r.text)
        for x in base + brute_candidates(r.text, base):
            owners[secret_of(r.text, x)].add(r.source)
            repositories[secret_of(r.text, x)].add((r.source, r.lang))
    out = {}
    for r in docs:
        base = brute_spans(r.text)
        live = [c[:3] for c in brute_candidates(r.text, base) if len(owners[c[3]]) == 1 and len(repositories[c[3]]) <= 4]
        out[r.doc_id] = masked(r.text, [(a, b) for a, _, b in sorted(base + live)])
    assert Counter(len(x) for x in out.values())
    return out
