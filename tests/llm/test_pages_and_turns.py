import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import html_extract, preference


def test_made_pages_are_extracted():
    model = html_extract.trained_once()
    rnd = random.Random(2024)
    good = 0
    for _ in range(150):
        page, blocks = html_extract.made_page(rnd)
        good += html_extract.extract([page], model)[0] == "\n".join(text for text, main in blocks if main)
    assert good >= 147


def test_given_pages_are_extracted(spark, sf):
    import html

    rows = html_extract.extracted(spark.read.parquet(f"{sf}/pages.parquet"), ["page_id", "html"]).collect()
    for r in rows:
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = [re.sub(r"[ \t\n\r\f]+", " ", html.unescape(re.sub(r"<[^>]*>", " ", x))).strip() for x in re.split(r"</?(?:p|h1|li|ul)>", article)]
        assert r.text == "\n".join(x for x in parts if x)


def test_odd_pages(spark):
    pages = [None, "", "plain words only", "<p>" * 3000 + "deep" + "</p>", "<div>" * 3000 + "deep", "<article><p>a &amp; b&nbsp;c<br>d</p><p> </p><p>e\n\tf</article>", "<article><p>x<script>no</script><p hidden>no<p>y<!-- no --></article><footer>no", "<", "<article><p>1 < 2</article", "x" * 200_000]
    rows = html_extract.extracted(spark.createDataFrame([(i, p, "clash") for i, p in enumerate(pages)], "page_id long, html string, text string"), ["page_id", "text"]).orderBy("page_id").collect()
    assert [r.text for r in rows][:2] == ["", ""]
    assert rows[2].text == "plain words only" and rows[3].text == "deep" and rows[9].text == "x" * 200_000
    assert rows[5].text == "a & b c d\ne f" and rows[6].text == "x\ny"
    assert html_extract.extracted(spark.createDataFrame([], "page_id long, html string"), ["page_id"]).count() == 0


def test_siblings_alike_are_counted_at_any_number():
    for n in (5, 198, 199, 200, 201, 250):
        nodes, runs = html_extract.parsed("<body><h2>Head</h2>" + "<p>Some words.</p>" * n)
        rows = html_extract.features(nodes, runs, html_extract.blocks_of(nodes, runs), [0.0] * html_extract.BUCKETS)
        assert [row[-4] for row in rows[2:]] == [1 / (n + 1)] + [n / (n + 1)] * n


def test_body_is_implied():
    model = html_extract.trained_once()
    text = "".join(f"<p>Some words of the story number {k}, which is told here. It goes on for a while, and ends.</p>" for k in range(6))
    head, inner = "<title>t</title><meta charset=utf-8><style>p{}</style>", f"<nav><a href=/>Home</a></nav><article>{text}</article>"
    want = html_extract.extract([f"<html><head>{head}</head><body>{inner}</body></html>"], model)[0]
    assert want.count("\n") == 5
    pages = [head + inner, f"<html><head>{head}{inner}", f"<html><head>{head}</head>{inner}</html>", f"<!doctype html>\n{head}\n<body>{inner}", f"\ufeff<html><head>{head}</head><body>{inner}", f"<html><body></body>{inner}</html>"]
    assert html_extract.extract(pages, model) == [want] * len(pages)
    for page in ("bare words", "bare <b>words</b><br>and more", "<html><body><p>x</p></body>bare words", "<head><title>t</title>bare words", "bare <body class=content>words"):
        nodes, runs = html_extract.parsed(page)
        blocks = html_extract.blocks_of(nodes, runs)
        assert sum(n.tag == "body" for n in nodes) == 1 and "bare words" in " ".join(text for _, text in blocks) and all(n.index for n, _ in blocks)


def test_nothing_is_kept_inside_what_is_not():
    model = html_extract.trained_once()
    nodes, runs = html_extract.parsed("<nav><article><p>Some words. More words here.</p></article></nav><p>x</p>")
    blocks = html_extract.blocks_of(nodes, runs)
    import numpy as np

    trees, evidence = model
    labels = html_extract.decoded(nodes, trees.logit(np.array(html_extract.features(nodes, runs, blocks, evidence), dtype=float)).tolist())
    for n in nodes[1:]:
        assert labels[n.parent.index] or not labels[n.index]


@pytest.mark.parametrize(
    "page, text",
    [
        ('<article><p title="abc>First para</p><p>Second para of it.</p></article>', "First para\nSecond para of it."),
        ("<article><p title='a > b'>First.</p><p data-x=a>b>Second.</p></article>", "First.\nb>Second."),
        ("<article><p don't>First.</p><p class = main >Second.</p></article>", "First.\nSecond."),
        ("<article><p>\u3000First\xa0&nbsp;\u2003 one.\u3000</p><p>&#160;</p></article>", "First one."),
        ("<ARTICLE><P>First<!-- > no --><!--> one.<P>Second.</ARTICLE>", "First one.\nSecond."),
        ("loose words<p>and a paragraph</p>loose again", "loose words\nand a paragraph\nloose again"),
    ],
)
def test_odd_markup(page, text):
    assert html_extract.extract([page], html_extract.trained_once())[0] == text


def test_hostile_pages_take_linear_time():
    import time

    pages = {
        "spans": lambda n: "<span>" * n + "</b>" * n, "apostrophes": lambda n: "<p '>" * n, "headings": lambda n: "<p>" + "<span>" * n + "<h1>x</h1>" * n, "walls": lambda n: "<b><div>" + "<span>" * n + "</b>" * n,
        "items": lambda n: "<li><span>" * n, "names": lambda n: "".join(f"<x{i}>" for i in range(n)), "comments": lambda n: "<!--" * n, "values": lambda n: '<p class="' * n, "bare": lambda n: "<p =" * n,
    }
    for name, page in pages.items():
        took = []
        for n in (10_000, 40_000):
            text = page(n)
            began = time.process_time()
            html_extract.parsed(text)
            took.append(time.process_time() - began)
        assert took[1] < 10 * took[0] + 0.2, (name, took)


def other_page(rnd):
    """A page built otherwise than the training pages: layout by div and table, other names, upper-case and unclosed tags, longer words."""
    word = lambda: rnd.choice("Haus garden mountain Fluss ventana petite river Strasse lumiere camino bridge window kitchen journal science market".split()) + rnd.choice(["", "s", "ing", "lich", "ment"])
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    para = lambda: " ".join(sentence(rnd.randint(6, 18)) for _ in range(rnd.randint(2, 6)))
    main = [sentence(rnd.randint(3, 8)), *(para() for _ in range(rnd.randint(3, 12)))]
    body = f"<H2>{main[0]}</H2>" + "".join(f"<P STYLE='margin:0'>{x}" for x in main[1:])
    items = lambda n: "".join(f'<li class=item><a href="/{k}">{word()}</a>' for k in range(n))
    noise = [
        f'<div id="top-nav"><ul>{items(rnd.randint(3, 9))}</ul></div>', f'<div class="cookie-consent-bar">{sentence(12)} <button>OK</button></div>', f'<div class="box ad-unit"><span>{sentence(7)}</span></div>',
        f'<form><label>{word()}</label><input name=q><button>{word()}</button></form>', f'<div class="sidebar_left"><h4>{word()}</h4><ul>{items(5)}</ul></div>',
    ]
    after = [f'<div class="user-comments"><h3>{word()}</h3>' + "".join(f'<div class=comment><b>{word()}</b><p>{sentence(9)}</p></div>' for _ in range(rnd.randint(1, 4))) + "</div>", f'<div class="page-footer"><p>{sentence(6)}</p></div>', f'<div class=related-links><ul>{items(4)}</ul></div>']
    rnd.shuffle(noise)
    rnd.shuffle(after)
    holder = rnd.choice(['<div class="page-content">%s</div>', '<main id=main>%s</main>', '<div class="post__text">%s</div>', '<table><tr><td class="story-cell">%s</td></tr></table>', "<article>%s</article>", "<section>%s</section>"])
    return f"<HTML><HEAD><TITLE>{word()}</TITLE></HEAD><BODY>" + "".join(noise[: rnd.randint(1, 4)]) + holder % body + "".join(after[: rnd.randint(1, 3)]), main


def test_pages_of_other_construction():
    """Characters of main text that are found, and found characters that are main text, by whole blocks."""
    rnd = random.Random(77)
    right = found = wanted = 0
    for _ in range(200):
        page, main = other_page(rnd)
        got = html_extract.extract([page], html_extract.trained_once())[0].split("\n")
        right += sum(len(x) for x in got if x in main)
        found += sum(map(len, got))
        wanted += sum(map(len, main))
    print(f"recall {right / wanted:.4f}, precision {right / found:.4f}")
    assert right / wanted > 0.97 and right / found > 0.97


def without_names(page, rnd):
    """The page with letters drawn at random for each class and id."""
    name = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(1, 7))) + str(rnd.randint(0, 99))
    return re.sub(r"""\b(class|id)=("[^"]*"|[\w-]+)""", lambda m: f'{m[1]}="{name()}"', page)


def test_pages_whose_names_tell_nothing():
    rnd, names = random.Random(77), random.Random(5)
    right = found = wanted = 0
    for _ in range(200):
        page, main = other_page(rnd)
        got = html_extract.extract([without_names(page, names)], html_extract.trained_once())[0].split("\n")
        right += sum(len(x) for x in got if x in main)
        found += sum(map(len, got))
        wanted += sum(map(len, main))
    print(f"recall {right / wanted:.4f}, precision {right / found:.4f}")
    assert right / wanted > 0.97 and right / found > 0.97


RIVER = [
    "The river", "The river rises in the hills north of the town and runs for forty miles. It feeds two mills on its way.",
    "In spring the water carries silt over the meadows, and farmers wait for it. They say that a dry year costs them more than a flood.",
    "Last year the council built a second bridge, which opened in May. Traffic has halved since then, as the mayor said on Monday.",
]


@pytest.mark.parametrize(
    "frame",
    [
        "<div class=x1><a href=/>Home</a> <a href=/n>News</a> <a href=/s>Sport</a></div><div class=x2>%s</div>", "<div class=inhalt>%s</div><div class=seitenleiste><ul><li><a href=/m>Mehr</a><li><a href=/w>Wetter</a></ul></div>",
        "<table><tr><td><a href=/>Home</a> <a href=/m>More</a></td><td>%s</td></tr></table>", "<table><tr><td><ul><li><a href=/>Home</a><li><a href=/m>More</a></ul></td><td>%s</td></tr></table>",
    ],
)
def test_menus_without_telling_names(frame):
    page = frame % (f"<h1>{RIVER[0]}</h1>" + "".join(f"<p>{x}</p>" for x in RIVER[1:]))
    assert html_extract.extract([f"<html><body>{page}</body></html>"], html_extract.trained_once())[0].split("\n") == RIVER


def spark_hash(*values):
    import xxhash

    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode(), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def side(turns):
    """(role, text) of each turn; of repeated ones that with the smallest hash."""
    out = {}
    for t, role, text in turns:
        if t is not None:
            said = (role or "", text or "")
            key = lambda x: spark_hash(*x) & -2 | (x[0] == "assistant")
            out[t] = min(out.get(t, said), said, key=key)
    return out


def self_rejected(own):
    answers = [t for t in sorted(own) if own[t][0] == "assistant"]
    out = dict(own)
    if len(answers) == 1:
        del out[answers[0]]
    elif answers:
        out[answers[-1]] = own[answers[0]]
    return out


def brute_pair(a, b):
    parting = min((t for t in a.keys() | b.keys() if a.get(t) != b.get(t)), default=None)
    rows = []
    for part, own in (("chosen", a), ("rejected", b)):
        for t, (role, text) in own.items():
            common = parting is None or t < parting
            if common and part == "rejected":
                continue
            head = f"<|im_start|>{role}\n"
            learned = not common and role == "assistant"
            rows.append(("prompt" if common else part, t, role, f"{head}{text}<|im_end|>\n", len(head) if learned else 0, len(head + text) if learned else 0))
    return sorted(rows)


def by_pair(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r.pair].append((r.turn, r.role, r.text))
    return {k: side(own) for k, own in out.items() if k is not None}


def check(chosen, rejected=None):
    a = by_pair(chosen)
    b = by_pair(rejected) if rejected else {k: self_rejected(own) for k, own in a.items()}
    want = [(k, *x) for k in a.keys() | b.keys() for x in brute_pair(a.get(k, {}), b.get(k, {}))]
    got = preference.formatted(chosen, rejected) if rejected else preference.self_formatted(chosen)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    return got, want


def test_preference_pairs(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet").select(F.col("conv_id").alias("pair"), "turn", "role", "text")
    check(turns)
    more = turns.withColumns({c: F.lit("clash") for c in ("first", "last", "of", "store", "part", "parting", "chosen", "hash", "side", "at", "s")})
    check(more)
    check(more, turns.withColumn("text", F.when(F.col("turn") % 4 == 3, F.lower("text")).otherwise(F.col("text"))))


def test_odd_preference_pairs(spark):
    kind = "pair long, turn long, role string, text string"
    chosen = [(1, 0, "user", "hi"), (1, 1, "assistant", "a"), (2, 0, "user", None), (2, 1, None, "x"), (3, 0, "assistant", "only"), (None, 0, "user", "x"), (4, None, "user", "x"), (5, 0, "user", "b"), (5, 0, "user", "a"), (5, 0, "user", "a"), (5, 3, "assistant", "😀 z"), (6, 0, "user", "same")]
    rejected = [(1, 0, "user", "hi"), (1, 1, "assistant", "b"), (1, 2, "user", "more"), (2, 0, "user", ""), (2, 1, "", "x"), (5, 0, "user", "a"), (6, 0, "user", "same"), (7, 0, "assistant", "alone")]
    check(spark.createDataFrame(chosen, kind), spark.createDataFrame(rejected, kind))
    check(spark.createDataFrame([], kind), spark.createDataFrame(rejected, kind))
    check(spark.createDataFrame(chosen + rejected, kind))
    empty = spark.createDataFrame([], kind)
    assert preference.formatted(empty, empty).count() == 0 and preference.self_formatted(empty).count() == 0


def test_paired_rows_hold_both_completions(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet").select(F.col("conv_id").alias("pair"), "turn", "role", "text")
    got, want = check(turns)
    parts = defaultdict(lambda: defaultdict(list))
    for k, part, turn, _, text, a, b in sorted(want, key=lambda x: (x[0], x[2])):
        before = sum(len(x[0]) for x in parts[k][part])
        parts[k][part].append((text, (before + a, before + b) if b else None))
    rows = {r.pair: r for r in preference.paired(got).collect()}
    assert set(rows) == {k for k, own in parts.items() if own["chosen"] or own["rejected"]}
    for k, r in rows.items():
        for part, text, masks in (("prompt", r.prompt, []), ("chosen", r.chosen, r.chosen_masks), ("rejected", r.rejected, r.rejected_masks)):
            assert text == "".join(x for x, _ in parts[k][part])
            assert [tuple(m) for m in masks] == [m for _, m in parts[k][part] if m and part != "prompt"]


def test_texts_are_shuffled_once(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet").select(F.col("conv_id").alias("pair"), "turn", "role", "text")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = preference.self_formatted(turns)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    above = plan[: plan.index("SortAggregate")]
    assert "SortMergeJoin" in above and "Exchange" not in above  # between the join and what gathers the texts
    assert len(re.findall(r"partial_min\(struct\(hash.*?text", plan)) == 1 and len(re.findall("Scan parquet", plan)) == 3  # two of them of what was staged
