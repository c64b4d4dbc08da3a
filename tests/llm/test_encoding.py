import random

import pytest

from tessera.llm import bpe, lattice_lm
from tessera.llm.queries import PIECES, TOKENIZER, tokenizer_path


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(TOKENIZER))


def test_bpe_equals_the_library(docs, library):
    rows = bpe.encode_documents(docs, tokenizer_path(TOKENIZER), keep=["doc_id", "text"]).collect()
    assert len(rows) == docs.count()
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids
        assert r.decoded == library.decode(ids, skip_special_tokens=False)


def test_bpe_on_random_unicode(library):
    encoder = bpe.PrefixEncoder(open(tokenizer_path(TOKENIZER), encoding="utf-8").read(), bpe.pattern_classes(), bpe.lower_letters())
    rnd = random.Random(5)
    letters = "aAbeéÉß 'sStT\n\t0123<>|/w.,!?ΣσςİǅŉſK中文한😀́ẛ̣\x1c\x1f\x85 ٣Ⅷ"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 50))) for _ in range(1500)]
    texts += ["".join(chr(rnd.choice([rnd.randint(1, 0x2FF), rnd.randint(0x300, 0xD7FF), rnd.randint(0xE000, 0x1FFFF)])) for _ in range(rnd.randint(0, 30))) for _ in range(1500)]
    texts += ["a" * 4000, "ab" * 2000, "<|endoftext|>x<|startoftext|> don't we'll", "=-" * 500]
    for text, found in zip(texts, encoder.encode(texts).to_pylist()):
        ids = library.encode(text, add_special_tokens=False).ids
        assert found["ids"] == ids, text
        assert found["decoded"] == library.decode(ids, skip_special_tokens=False)


def test_bpe_words_of_every_length(library):
    encoder = bpe.PrefixEncoder(open(tokenizer_path(TOKENIZER), encoding="utf-8").read())
    rnd = random.Random(6)
    texts = ["".join(rnd.choice("aeinorst") for _ in range(n)) for n in [*range(1, 130), 5000]]
    assert [x["ids"] for x in encoder.encode(texts).to_pylist()] == [library.encode(t).ids for t in texts]


def test_full_tables_change_nothing(real, library, monkeypatch):
    texts = [r.text for r in real.collect()]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(bpe, "CACHE_ROWS", 50)
    encoder = bpe.PrefixEncoder(open(tokenizer_path(TOKENIZER), encoding="utf-8").read())
    for _ in range(2):
        got = [x for i in range(0, len(texts), 7) for x in encoder.encode(texts[i : i + 7]).to_pylist()]
        assert [x["ids"] for x in got] == want


def test_automaton_knows_all_ends():
    """Each prefix's state names just the given strings that end there, by the states on its suffix links."""
    rnd = random.Random(7)
    strings = sorted({bytes(rnd.choice(b"ab") for _ in range(rnd.randint(1, 6))) for _ in range(40)} | {b"a", b"b"})
    link, longest, token, steps, targets = bpe.SuffixAutomaton(dict(enumerate(strings))).arrays()
    go = dict(zip(steps.tolist(), targets.tolist()))
    substrings = {s[i:j] for s in strings for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    for _ in range(300):
        text, state, size = bytes(rnd.choice(b"ab") for _ in range(12)), 0, 0
        for end, c in enumerate(text, 1):
            while state << 8 | c not in go:
                state = link[state]
                size = longest[state]
            state, size = go[state << 8 | c], size + 1
            assert size == max(n for n in range(end + 1) if not n or text[end - n : end] in substrings)
            ends, at = [], state
            while at > 0:
                if token[at] >= 0 and longest[at] <= size:
                    ends.append(strings[token[at]])
                at = link[at]
            assert ends == [text[end - n : end] for n in range(end, 0, -1) if text[end - n : end] in strings]


def test_bpe_decodes_what_it_encoded(edge, library):
    from pyspark.sql import functions as F

    shared = bpe.tokenizer_file(edge.sparkSession, tokenizer_path(TOKENIZER))
    rows = bpe.encode_documents(edge, tokenizer_path(TOKENIZER), keep=["doc_id"]).withColumn("again", bpe.decoded(F.col("ids"), shared)).collect()
    assert all(r.again == r.decoded for r in rows)


def all_segmentations(word, odds, limit=16):
    ways = [1.0] + [0.0] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(max(0, end - limit), end):
            ways[end] += ways[start] * odds.get(word[start:end], 0.0)
    return ways[-1]


def test_lattice_sums_all_segmentations():
    import math

    odds = {"▁": 0.1, "a": 0.2, "b": 0.1, "ab": 0.2, "▁a": 0.2, "ba": 0.05}
    names = list(odds)
    lattice = lattice_lm.Lattice([(x, i) for i, x in enumerate(names)], [6] * 256, [math.log(odds[x]) for x in names] + [math.log(1e-3)])
    for word in ("", "a", "ab", "abba", "abab" * 20):
        assert lattice.log10(word) == pytest.approx(math.log10(all_segmentations("▁" + word, odds)))
    assert lattice.log10("é") == pytest.approx(math.log10(0.1 * 1e-6))
    uses = [0.0] * 7
    lattice.expect("ab", 3, uses)
    whole = all_segmentations("▁ab", odds)
    assert uses[3] == pytest.approx(3 * 0.1 * 0.2 / whole)
    assert sum(u * len(x) for u, x in zip(uses, names)) == pytest.approx(3 * 3)


def test_lattice_scores_by_brute_force(docs):
    import math
    import re
    import zlib
    from collections import Counter

    rows = docs.select("doc_id", "text").collect()
    got = sorted(lattice_lm.scores(docs, tokenizer_path(PIECES), head_rows=40).collect(), key=lambda r: (r.doc_id is None, r.doc_id, r.n_tokens))
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)) + [None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    counts = Counter(w for r in rows if not held(r.doc_id) for w in words(r.text))
    n, v = sum(counts.values()), len(counts)
    want = []
    for r in rows:
        w = words(r.text)
        want.append((r.doc_id, held(r.doc_id), len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)))
    want.sort(key=lambda r: (r[0] is None, r[0], r[2]))
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert (g.doc_id, g.held_out, g.n_tokens, g.n_known, g.train_tokens) == w[:5]
        assert g.base_score == pytest.approx(w[5], rel=1e-9, abs=1e-9)
        assert g.score < 0


def test_lattice_prefers_real_words(spark, sf):
    """On held-out documents, real text must be likelier than the same letters in another order."""
    import random

    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rnd = random.Random(1)

    def mixed(text):
        letters = [c for c in text if not c.isspace()]
        rnd.shuffle(letters)
        it = iter(letters)
        return "".join(c if c.isspace() else next(it) for c in text)

    held = [(-r.doc_id - 1, mixed(r.text), r.doc_id) for r in docs.where(F.crc32(F.col("doc_id").cast("string")) % 10 == 0).collect()]
    out = {r.doc_id: r.score for r in lattice_lm.scores(docs, tokenizer_path(PIECES)).collect()}
    noise = spark.createDataFrame([(d, t) for _, t, d in held], "doc_id long, text string")
    both = docs.where(F.crc32(F.col("doc_id").cast("string")) % 10 != 0).union(noise)
    other = {r.doc_id: r.score for r in lattice_lm.scores(both, tokenizer_path(PIECES)).collect()}
    better = sum(out[d] > other[d] for _, _, d in held)
    assert better >= 0.9 * len(held)


def segmentations(word, ids, bytes_):
    """Every way to write a word as pieces, as lists of ids; a letter that is no piece is its bytes."""
    if not word:
        return [[]]
    out = [[ids[word[:n]], *rest] for n in range(1, len(word) + 1) if word[:n] in ids for rest in segmentations(word[n:], ids, bytes_)]
    if word[0] not in ids:
        out += [[bytes_[b] for b in word[0].encode()] + rest for rest in segmentations(word[1:], ids, bytes_)]
    return out


def test_scores_by_all_segmentations(spark):
    """The whole model on a small corpus: both steps of the fit and the scores from explicit lists of segmentations."""
    import math
    import zlib
    from collections import Counter, defaultdict

    pieces, bytes_, logs = lattice_lm.vocabulary(tokenizer_path(PIECES))
    ids = dict(pieces)
    rnd = random.Random(12)
    words = ["the", "Then", "and", "sand", "ört", "é", "x9", "中a", "tion", "nation", "a", "😀"]
    texts = {k: " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 9))) for k in range(40)} | {99: None}
    lowered = {k: "".join(c.lower() if c < "\x80" else c for c in t or "").split() for k, t in texts.items()}
    train = [k for k in texts if zlib.crc32(str(k).encode()) % 10]
    counts, ways = Counter(w for k in train for w in lowered[k]), {w: segmentations("▁" + w, ids, bytes_) for own in lowered.values() for w in own}
    odds = [math.exp(x) for x in logs]
    of = lambda w: sum(math.prod(odds[i] for i in s) for s in ways[w])
    for _ in range(lattice_lm.STEPS):
        uses = defaultdict(float)
        for w, n in counts.items():
            whole = of(w)
            for s in ways[w]:
                p = math.prod(odds[i] for i in s)
                for i in s:
                    uses[i] += n * p / whole
        total = sum(uses.values()) + len(train) + 0.1 * (len(logs) + 1)
        odds = [(uses[i] + 0.1) / total for i in range(len(logs))]
    end = math.log10((len(train) + 0.1) / total)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    for head_rows in (2, 1000):
        got = {r.doc_id: r.score for r in lattice_lm.scores(docs, tokenizer_path(PIECES), head_rows=head_rows).collect()}
        for k, own in lowered.items():
            assert got[k] == pytest.approx(end + sum(math.log10(of(w)) for w in own), rel=1e-7)


def test_rare_letters_in_a_large_corpus():
    """39 rare letters whose odds are as small as in a corpus of 1e13 tokens: the fit stays finite, in log space or not."""
    pieces, bytes_, logs = lattice_lm.vocabulary(tokenizer_path(PIECES))
    rare = [p for p, _ in pieces if len(p) == 1][-39:]
    for odds in (1e-5, 1e-9, 1e-13):
        import math

        lattice = lattice_lm.Lattice(pieces, bytes_, [math.log(odds)] * len(logs))
        for word in ("".join(rare), "".join(rare) * 3, "".join(rare)[:20] + "\ue123"):
            into = [0.0] * len(logs)
            lattice.expect(word, 7, into)
            assert all(math.isfinite(x) for x in into)
            letters = dict(pieces)
            assert sum(into) == pytest.approx(7 * (1 + len(word) + 2 * word.count("\ue123"))) or any(len(p) > 1 and p in "▁" + word for p in letters)
            assert math.isfinite(lattice.log10(word))


@pytest.mark.parametrize("log", [-1.0, -15.0, -18.75, -25.0, -700.0])
def test_expected_uses_of_rare_pieces_are_finite(log):
    lattice = lattice_lm.Lattice([("▁", 0), ("q", 1), ("qq", 2)], [], [-1.0, log, -1e6])
    for n in (1, 20, 38, 39, 60):
        into = [0.0] * 3
        lattice.expect("q" * n, 3, into)
        assert into == pytest.approx([3, 3 * n, 0])
