"""BPE encoding and decoding by per-prefix dynamic programming.

For every prefix of a word exactly one token can be the last one of its encoding: the token must end the prefix, and the
last token of what precedes it must be compatible with it, i.e. merging the two tokens' bytes gives just these tokens. A suffix
automaton of the vocabulary reads a word byte by byte; its state and the states on its suffix links name all tokens that end
there, longest first, and the compatible one is stored for the prefix. Back-pointers from the whole word give the ids. The cost is
linear in a word's length, and words of all lengths take the same way.

A slice of texts is cut into chunks. Those that the worker's bounded table lacks are cut into words; each distinct word is encoded
once, in sorted order, so that a word starts from the prefixes that it shares with the one before. Ids and decoded texts are then
put together by array operations.

Input rows: nulls and empty texts give no ids and the empty text. Texts are never cut. Repeated rows are encoded alike.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.process_cache import give_back, kept, only, uncollected
from tessera.llm.words import slices

#: Entries of each of a worker's tables. A full one makes room or takes no more, which costs time and never changes a result.
CACHE_ROWS = 400_000
#: Rows and characters of text that are encoded together; a longer text is encoded alone.
SLICE_ROWS, SLICE_CHARS = 1024, 4_000_000
#: Byte that stands for the end of a word; UTF-8 has no such byte.
END = 0xFF
#: ASCII marks that the pretokenizer's pattern never parts from each other, nor joins with letters.
MARKS = "!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"
NEVER = 1 << 60
#: Ids of a vocabulary must be smaller.
MOST_IDS = 1 << 16


class SuffixAutomaton:
    """All substrings of some byte strings. A state stands for the substrings that end at the same places; ``link`` leads to the longest
    suffix that ends at more places, ``longest`` is the length of a state's longest string, and ``token`` the string's number if it
    is one of the given ones (which are always the longest of their state), else -1."""

    def __init__(self, strings: dict[int, bytes]):
        self.link, self.longest, self.token = [-1], [0], [-1]
        self.steps: list[dict[int, int]] = [{}]
        for i, letters in strings.items():
            at = 0
            for c in letters:
                at = self._extended(at, c)
            self.token[at] = i

    def _state(self, longest: int, link: int, steps: dict[int, int]) -> int:
        self.longest.append(longest)
        self.link.append(link)
        self.token.append(-1)
        self.steps.append(steps)
        return len(self.link) - 1

    def _extended(self, at: int, c: int) -> int:
        """The state of the string of ``at`` (the longest of its state) with one more letter."""
        steps, longest, link = self.steps, self.longest, self.link
        there = steps[at].get(c)
        if there is not None and longest[there] == longest[at] + 1:
            return there
        new = there is None and self._state(longest[at] + 1, 0, {})
        while at >= 0 and c not in steps[at]:
            steps[at][c] = new
            at = link[at]
        if at < 0:
            return new
        there = steps[at][c]
        if longest[there] != longest[at] + 1:  # shorter strings of that state end at more places now
            part = self._state(longest[at] + 1, link[there], dict(steps[there]))
            link[there] = part
            while at >= 0 and steps[at].get(c) == there:
                steps[at][c] = part
                at = link[at]
            there = part
        if new is False:
            return there
        link[new] = there
        return new

    def arrays(self) -> tuple:
        """Plain arrays: links, lengths, tokens, and the steps by state << 8 | byte."""
        import numpy as np

        pairs = [(s << 8 | c, t) for s, own in enumerate(self.steps) for c, t in own.items()]
        return (*(np.array(x, dtype=np.int32) for x in (self.link, self.longest, self.token)), *np.array(pairs, dtype=np.int64).T)


class Steps(dict):
    """Steps of an automaton by node << 8 | byte. Where a node has no such step, that of the node on its suffix link holds."""

    def __init__(self, steps, up: list[int]):
        super().__init__(steps)
        self.up, self.most = up, len(self) + CACHE_ROWS

    def __missing__(self, key: int) -> int:
        there = self[self.up[key >> 8] << 8 | key & 255]
        if len(self) < self.most:
            self[key] = there
        return there


class Fits(dict):
    """Whether two tokens are compatible, by first << 16 | second."""

    def __init__(self, compatible):
        super().__init__()
        self.compatible = compatible

    def __missing__(self, pair: int) -> bool:
        if len(self) >= CACHE_ROWS:
            self.clear()
        ok = self[pair] = self.compatible(pair >> 16, pair & 0xFFFF)
        return ok


class Chunks(dict):
    """Numbers of chunks, in order of appearance; ``ids`` from ends[number] to ends[number + 1] are a chunk's. A chunk that has no
    number gets one and is noted in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []
        self.ids, self.ends = array("i"), array("i", [0])

    def __missing__(self, chunk: str) -> int:
        n = self[chunk] = len(self)
        self.new.append(chunk)
        return n

    def add(self, ids) -> None:
        """The ids of the next chunk in order."""
        self.ids.extend(ids)
        self.ends.append(len(self.ids))

    def ids_of(self, number: int) -> array:
        return self.ids[self.ends[number] : self.ends[number + 1]]


def spelled_tokens(model: dict) -> dict[int, bytes]:
    """The bytes of each token of a byte-level vocabulary with word ends."""
    letters, suffix = {c: bytes([b]) for b, c in enumerate(byte_letters())}, model["end_of_word_suffix"]
    spell = lambda t: b"".join(letters[c] for c in t)
    return {i: spell(t[: -len(suffix)]) + bytes([END]) if t.endswith(suffix) else spell(t) for t, i in model["vocab"].items() if all(c in letters for c in t.removesuffix(suffix)) and t != suffix}


class PrefixEncoder:
    """Encodes and decodes as a tokenizer file of kind BPE with word ends says."""

    def __init__(self, content: str, classes: dict[str, str] | None = None, lowered: dict[int, str] | None = None, automaton: tuple | None = None):
        """``classes``, ``lowered``: see pattern_classes() and lower_letters(); without them, those of this Python hold. ``automaton``: see
        automaton_of(); it is built if missing."""
        import regex

        file = json.loads(content)
        model, kinds = file["model"], [x["type"] for x in file["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or kinds != ["NFC", "Replace", "Lowercase"] or file["decoder"]:
            raise ValueError("only BPE with word ends, lower case and no decoder is supported")
        split, as_bytes = file["pre_tokenizer"]["pretokenizers"]
        if split["behavior"] != "Removed" or not split["invert"] or as_bytes["use_regex"]:
            raise ValueError("only pretokenizers that keep a pattern's matches are supported")
        #: White space of the tokenizer's patterns.
        space = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
        pattern = split["pattern"]["Regex"].replace(r"[^\s\p{L}", rf"[^{space}\p{{L}}")
        for name, ranges in (classes or {}).items():
            pattern = pattern.replace(name, ranges)
        self.pieces = regex.compile(pattern)
        self.blanks = regex.compile(rf"[{space}]+")
        self.odd_space = regex.compile(r"[\x1c-\x1f]")
        self.special = {x["content"]: x["id"] for x in file["added_tokens"]}
        self.specials = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.lowered = {ord("Σ"): "σ"} | (lowered or {})

        vocab = model["vocab"]
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.names = pa.array([names.get(i, "") for i in range(max(names) + 1)], pa.string())
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        size = max(vocab.values()) + 1
        if size > MOST_IDS:
            raise ValueError("the vocabulary is too large")
        if len({a + b for a, b in merges}) != len(merges):
            raise ValueError("two merges make one token")
        self.rank, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        self.pair = {}
        for rank, (a, b) in enumerate(merges):
            i = vocab[a + b]
            self.rank[i], self.left[i], self.right[i] = rank, vocab[a], vocab[b]
            self.pair[vocab[a], vocab[b]] = rank

        self.read_automaton(*(automaton or automaton_of(content)))
        self.fits = Fits(self.compatible)
        self.chunks, self.older = Chunks(), Chunks()

    def read_automaton(self, link, longest, token, steps, targets) -> None:
        """Nodes are state << 1 | whole: whether a state's longest string was read, or only a shorter one, which never becomes whole
        again by further steps."""
        import numpy as np

        states, letters = steps >> 8, steps & 255
        whole = longest[targets] == longest[states] + 1
        keys = np.concatenate([states << 9 | letters, (states << 1 | 1) << 8 | letters])
        up = np.repeat(link, 2) << 1 | 1
        self.steps = Steps(zip(keys.tolist(), np.concatenate([targets << 1, targets << 1 | whole]).tolist()), up.tolist())
        #: For each node: (length, token) of all tokens that end there, longest first.
        self.ending: list[tuple] = [()] * len(up)
        for state in np.argsort(longest, kind="stable").tolist()[1:]:
            above = self.ending[link[state] << 1 | 1]
            self.ending[state << 1] = above
            self.ending[state << 1 | 1] = ((int(longest[state]), int(token[state])), *above) if token[state] >= 0 else above
        own = np.flatnonzero(token >= 0)
        self.sizes = dict(zip(token[own].tolist(), longest[own].tolist()))

    def compatible(self, a: int, b: int) -> bool:
        """Whether the bytes of two tokens, merged together, stay these two: no pair across the border may come first."""
        x, y, x_ends, y_ends = a, b, NEVER, NEVER
        while True:
            q = self.pair.get((x, y))
            if q is not None and q < x_ends and q <= y_ends:
                return False
            if self.rank[x] < 0 and self.rank[y] < 0:
                return True
            if self.rank[x] > self.rank[y]:
                x_ends, x = self.rank[x], self.right[x]
            else:
                y_ends, y = self.rank[y], self.left[y]

    def encode_words(self, words) -> dict[str, list[int]]:
        """Ids of each of some distinct words (pieces of the pretokenizer)."""
        steps, ending, sizes, fits, out = self.steps, self.ending, self.sizes, self.fits, {}
        before, nodes, last = b"", [1], [-1]
        for word in sorted(words):
            letters, at = word.encode() + b"\xff", 0
            for x, y in zip(letters, before):
                if x != y:
                    break
                at += 1
            del nodes[at + 1 :], last[at + 1 :]
            node = nodes[at]
            for c in letters[at:]:
                node = steps[node << 8 | c]
                at += 1
                for n, token in ending[node]:
                    if n == at or fits[last[at - n] << 16 | token]:
                        break
                else:
                    raise ValueError(f"the vocabulary cannot spell {word[:50]!r}")
                nodes.append(node)
                last.append(token)
            before, back = letters, []
            while at:
                token = last[at]
                back.append(token)
                at -= sizes[token]
            out[word] = back[::-1]
        return out

    def words_of(self, chunk: str) -> list:
        """The words of what stands between white space; special tokens are numbers."""
        core = chunk.rstrip(MARKS)
        if core.isalpha() and max(core) < "\u0130":
            return [core.lower(), chunk[len(core) :]] if len(core) < len(chunk) else [core.lower()]
        out, at = [], 0
        if self.specials and "<" in chunk:
            for m in self.specials.finditer(chunk):
                out += [*self.plain(chunk[at : m.start()]), self.special[m[0]]]
                at = m.end()
        return out + self.plain(chunk[at:])

    def plain(self, text: str) -> list[str]:
        """Words of a text without special tokens."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).translate(self.lowered)
        return self.pieces.findall(text.lower())

    def encode(self, texts: list[str]) -> pa.StructArray:
        """struct(ids, decoded) of each text. White space never joins two chunks' tokens."""
        import numpy as np

        if len(self.chunks) > CACHE_ROWS:
            self.chunks, self.older = Chunks(), self.chunks
        table, parts = self.chunks, [self.blanks.split(t) if self.odd_space.search(t) else t.split() for t in texts]
        text_ends = np.cumsum([0, *map(len, parts)])
        numbers = np.fromiter(map(table.__getitem__, chain.from_iterable(parts)), dtype=np.int64, count=int(text_ends[-1]))
        self.encode_new()
        ids, ends = gathered(np.array(table.ids, dtype=np.int32), np.array(table.ends, dtype=np.int64), numbers, text_ends)
        ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
        return pa.StructArray.from_arrays([ids, self.decode(ids)], ["ids", "decoded"])

    def encode_new(self) -> None:
        """Give each new chunk its ids. Those that the older table has keep them."""
        table, older = self.chunks, self.older
        known = [older.get(c) for c in table.new]
        words = [self.words_of(c) if k is None else () for c, k in zip(table.new, known)]
        found = self.encode_words({w for own in words for w in own if isinstance(w, str)})
        for own, k in zip(words, known):
            table.add(older.ids_of(k) if k is not None else found[own[0]] if len(own) == 1 and own[0] in found else [i for w in own for i in (found[w] if isinstance(w, str) else (w,))])
        table.new = []

    def decode(self, ids: pa.ListArray) -> pa.StringArray:
        """Tokens of each list joined by one space, as a tokenizer without a decoder does; ids without a token are left out. Null is empty."""
        import pyarrow.compute as pc

        known = pc.and_(pc.greater_equal(ids.values, 0), pc.less(ids.values, len(self.names)))
        tokens = self.names.take(pc.if_else(known, ids.values, None))
        if tokens.null_count or pc.any(pc.equal(tokens, "")).as_py():
            return pa.array([" ".join([t for t in own or [] if t]) for own in pa.ListArray.from_arrays(ids.offsets, tokens).to_pylist()], pa.string())
        return pc.fill_null(pc.binary_join(pa.ListArray.from_arrays(ids.offsets, tokens), " "), "")


def gathered(values, value_ends, index, index_ends):
    """Lists of lists made flat: list k of ``values`` (from value_ends[k] on) in place of each k of ``index``; and the new ends."""
    import numpy as np

    sizes = np.diff(value_ends)[index]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(ends[-1]) + np.repeat(value_ends[:-1][index] - ends[:-1], sizes)
    return values[at], ends[index_ends]


def automaton_of(content: str) -> tuple:
    """Arrays of the suffix automaton of a tokenizer file's vocabulary."""
    return SuffixAutomaton(spelled_tokens(json.loads(content)["model"])).arrays()


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else the next from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def pattern_classes() -> dict[str, str]:
    """Ranges of letters and numbers by the Unicode version that the tokenizers library has, which may not be Python's."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = {}
    for name in (r"\p{L}", r"\p{N}"):
        runs = [every[a:b] for _, (a, b) in Split(Regex(f"{name}+"), "removed", invert=True).pre_tokenize_str(every)]
        out[name] = "".join(f"\\U{ord(r[0]):08x}-\\U{ord(r[-1]):08x}" for r in runs)
    return out


def lower_letters() -> dict[int, str]:
    """Letters that the tokenizers library lowers otherwise than this Python does, again for the Unicode version's sake."""
    from tokenizers.normalizers import Lowercase

    every = [chr(i) for i in [*range(0x80, 0xD800), *range(0xE000, 0x20000)]]
    return {ord(c): low for c, low in zip(every, Lowercase().normalize_str("\n".join(every)).split("\n")) if c not in "\x85\u2028\u2029" and low != c.lower()}


def _encoder(shared) -> PrefixEncoder:
    return kept("bpe", shared.value[0], lambda: PrefixEncoder(*shared.value[1:]))


def _prepared(path: str) -> tuple:
    with open(path, encoding="utf-8") as f:
        content = f.read()
    return content, pattern_classes(), lower_letters(), automaton_of(content)


def tokenizer_file(spark, path: str):
    """The vocabulary file and its automaton, made by the driver and broadcast (their size is that of one vocabulary)."""
    return spark.sparkContext.broadcast((path, *kept("bpe-file", path, lambda: _prepared(path))))


def encoded(text: Column, shared) -> Column:
    """struct(ids array<int>, decoded string) of a text column; ``shared`` comes from tokenizer_file()."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        only("bpe")
        encoder = _encoder(shared)
        for batch in slices(batches, SLICE_ROWS):
            texts, at, size, done = [t or "" for t in batch.to_pylist()], 0, 0, []
            with uncollected():
                for k, t in enumerate(texts):
                    if size + len(t) > SLICE_CHARS and k > at:
                        done.append(encoder.encode(texts[at:k]))
                        at, size = k, 0
                    size += len(t)
                done.append(encoder.encode(texts[at:]))
            yield pa.concat_arrays(done)
        give_back()

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "ids array<int>, decoded string").asNondeterministic()(text)


def decoded(ids: Column, shared) -> Column:
    """The text that a column of ids stands for."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(shared)
        for batch in slices(batches, SLICE_ROWS):
            yield encoder.decode(pa.array(batch.to_pylist(), pa.list_(pa.int32())))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "string")(ids)


def encode_documents(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all by default), then ids and decoded; a kept column of such a name gives way."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("ids", "decoded")]
    found = docs.select(*(docs[c] for c in keep), encoded(docs[text], tokenizer_file(docs.sparkSession, path)).alias("__ts_bpe"))
    return found.select(*keep, "__ts_bpe.ids", "__ts_bpe.decoded")
