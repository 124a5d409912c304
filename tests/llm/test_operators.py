"""The corpus operators against brute force, exact round trips and held-out accuracy, and
on nulls, empty and long texts, ties, repeats, empty tables and clashing column names."""

import collections
import hashlib
import itertools
import math
import random
import re
import struct
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from tapeworks.llm import bpe, common, hnsw, html_text, lm, media, mixing, ngram_join, passages, quality, queries, rollups
from tapeworks.llm.quality import fit_bradley_terry, quality_scores

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, n string, row string, token string, media string, component string"
PATH = P.path("byte_bpe_multi_50k.tiktoken")


def docs_of(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or ["s"])[i % len(sources or ["s"])], None if t is None else len(t), "x", "y", "z", "t", "m", "c") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def messy(spark):
    rng = random.Random(3)
    long = prose(rng, 30_000)
    return docs_of(spark, [None, "", "  \n ", "one", "Tie tie", "tie TIE", "a b あ\U0001f600 \x1c x", "w" * 9000, long, long, prose(rng, 80), prose(rng, 80)], [None, "b", "a"])


def shingle_set(text, k=5):
    w = (text or "").encode().lower().split()
    return frozenset(zip(*[w[i:] for i in range(k)], strict=False)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(texts):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_words_match_bytes_split():
    rng = random.Random(0)
    texts = ["", " ", "A b", "x" * 5000 + " y", "é É\tz\x1c\x0bq"] + ["".join(rng.choice("aB \né") for _ in range(rng.randint(0, 30))) for _ in range(300)]
    import pyarrow as pa

    raw, off = common.buffers(pa.array(texts))
    words, bound = common.words_of(raw, off)
    seen = {}
    for t, a, b in zip(texts, bound[:-1], bound[1:], strict=True):
        own = t.encode().lower().split()
        assert len(own) == b - a
        for w, h in zip(own, words[a:b].tolist(), strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_against_brute_force(spark, sf, seed):
    rng = random.Random(seed)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    for size in (6, 40, 146):  # groups of near copies around the threshold
        base = prose(rng, size).split()
        for _ in range(25):
            own = list(base)
            for _ in range(rng.randint(0, max(1, size // 20))):
                own[rng.randrange(size)] = prose(rng, 1)
            texts.append(" ".join(own))
    line = prose(rng, 12)
    texts += [f"{line} {prose(rng, 6)}" for _ in range(20)] + [texts[70].upper(), None, "", "one", "ONE", "one two", " \n"]
    want = brute_components(dict(enumerate(texts)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_join(docs_of(spark, texts)).collect()}
    assert got == want


def test_jaccard_on_blocks_of_one_document(spark, monkeypatch):
    rng = random.Random(9)
    base = prose(rng, 60).split()
    texts = [" ".join(base[:i] + ["new"] + base[i:]) for i in range(0, 60, 3)] + [prose(rng, 30) for _ in range(10)]
    monkeypatch.setattr(common, "MAX_BROADCAST_ROWS", 0)
    monkeypatch.setattr(ngram_join, "LIST_ROWS", 2)
    monkeypatch.setattr(ngram_join, "MAX_FREQUENT", 5)
    monkeypatch.setattr(ngram_join, "SALT_ROWS", 3)
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_join(docs_of(spark, texts).repartition(8)).collect()}
    assert got == {i: c for i, (_, c) in brute_components(dict(enumerate(texts))).items()}


def test_jaccard_ids_that_are_null_or_repeat(spark):
    rng = random.Random(4)
    a, b = prose(rng, 40), prose(rng, 60)
    rows = [(None, a), (None, None), (3, a), (3, a), (5, b), (7, a), (7, b), (9, prose(rng, 20))]
    got = sorted(ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=str)
    by_id = {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None}
    assert by_id == {3: (36, 3), 5: (56, 3), 7: (56, 3), 9: (16, 9)} and len(got) == 6
    assert sorted((r.n_shingles, r.component_id) for r in got if r.doc_id is None) == [(0, None), (36, None)]


def test_histograms_bound_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(200):
        x, y = (np.unique(rng.integers(0, 1 << 64, rng.integers(1, 900), np.uint64)) for _ in range(2))
        y = np.unique(np.concatenate((y, x[: rng.integers(0, len(x) + 1)])))
        h = [np.frombuffer(ngram_join.histogram(v), np.uint8).astype(int) for v in (x, y)]
        assert np.abs(h[0] - h[1]).sum() <= len(np.setxor1d(x, y))


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 102), (102, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in common.components(edges).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 100, 101: 100, 102: 100}
    assert common.components(edges.where("false")).count() == 0


def test_quality_learns_and_holds_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality_scores(docs, labels).collect()}
    assert len(got) == docs.count()
    held = [(got[r.doc_id], r.quality) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(g.held_out for g, _ in held) and all(0 <= g.score <= 1 and g.predicted == (g.score >= 0.3) for g in got.values())
    assert np.mean([g.predicted == q for g, q in held]) > 0.95
    # labels of held-out rows change nothing
    flipped = labels.withColumn("quality", F.when(common.crc_fold("doc_id", 5) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality_scores(docs, flipped).collect()}
    assert all(abs(again[i] - g.score) < 1e-12 for i, g in got.items())


def test_quality_edges(spark):
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, None), (7, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = quality_scores(messy(spark), labels).collect()
    assert len(rows) == 12 and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality_scores(messy(spark), labels.where("false")).collect()} == {0.5}
    assert quality_scores(messy(spark).where("false"), labels).count() == 0


def test_quality_query_against_brute_force(spark, sf):
    """Each text's features on its own, the fit on the labelled ones, and all scores anew."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    f = {r.doc_id: quality.features(*common.buffers(pa.array([r.text])))[0].astype(np.float32) for r in docs}
    own = sorted((i for i in f if i in labels and zlib.crc32(str(i).encode()) % 5), key=lambda i: (labels[i], *f[i][2::-1].tolist()))
    x, y = np.array([f[i] for i in own]), np.array([labels[i] for i in own])
    mean, scale, beta, cut = fit_bradley_terry(x[y == 1], x[y == 0])
    for r in queries.op1_quality(spark, sf).collect():
        strength = (f[r.doc_id].astype(float) - mean) / scale @ beta - cut
        want = 1 / (1 + math.exp(-strength - math.log(0.3 / 0.7)))
        assert r.score == pytest.approx(want, abs=1e-4) and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_quality_features_of_words():
    texts = ["a b a", "", "one", "b a b a c"]
    raw, off = common.buffers(pa.array(texts))
    words, bound = common.words_of(raw, off)
    got = quality.features(raw, off)[:, quality.SURFACE :]
    for t in range(4):
        own = words[bound[t] : bound[t + 1]].tolist()
        for k, list_ in ((0, own), (1, [int(common.grams(np.array(p, np.uint64), 2)[0]) for p in zip(own, own[1:], strict=False)])):
            want = np.zeros(quality.BUCKETS)
            for h in list_:
                want[h * quality.BUCKETS >> 64] += 1
            assert np.allclose(got[t, k * quality.BUCKETS : (k + 1) * quality.BUCKETS], np.sqrt(want / max(1, len(list_))))


def test_bradley_terry_orders_pairs():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(1, 1, (300, 3)), rng.normal(0, 1, (100, 3))
    mean, scale, beta, cut = fit_bradley_terry(good, bad)
    assert (beta > 0).all() and abs(np.mean(np.concatenate(((good - mean) / scale @ beta, (bad - mean) / scale @ beta)) < cut) - 0.25) < 0.01


def test_mixing_targets_and_taken(spark):
    rng = random.Random(5)
    texts = [prose(rng, rng.randint(1, 60)) for _ in range(400)]
    rows = mixing.mix(docs_of(spark, texts, ["a", "b", "b", "b", "c", None, "b"])).collect()
    names = ["a", "b", "c", None]
    size = {s: sum(len(texts[r.doc_id].split()) for r in rows if ["a", "b", "b", "b", "c", None, "b"][r.doc_id % 7] == s) for s in names}
    weight, target, left, free = dict(zip(names, (5, 2, 1, 5), strict=True)), {}, sum(size.values()), set(names)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * size[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * size[s]
            left -= target[s]
            free.discard(s)
    for s in names:
        own = [r for r in rows if ["a", "b", "b", "b", "c", None, "b"][r.doc_id % 7] == s]
        assert all(r.target == pytest.approx(target[s]) and r.source_size == size[s] and r.taken <= 3 * r.size for r in own)
        assert abs(sum(r.taken for r in own) - target[s]) <= 60
    order = mixing.training_order(mixing.mix(docs_of(spark, texts, names))).collect()
    assert [r.position for r in order] == sorted(r.position for r in order) and 0 <= order[0].position and order[-1].position <= 1


def test_schedule_inverse(spark):
    for knots in mixing.SCHEDULES:
        rows = spark.range(0, 101).select((F.col("id") / 100).alias("u")).withColumn("t", mixing.schedule_inverse(F.col("u"), knots)).collect()
        area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False))
        for r in rows:
            grid = np.linspace(0, r.t, 20001)
            w = np.interp(grid, [k[0] for k in knots], [k[1] for k in knots])
            assert abs(((w[1:] + w[:-1]) / 2 * np.diff(grid)).sum() / area - r.u) < 1e-6


def test_mixing_edges(spark):
    assert mixing.mix(messy(spark)).count() == 12
    assert mixing.mix(messy(spark).where("false")).count() == 0
    assert {r.taken for r in mixing.mix(docs_of(spark, [None, "", " "])).collect()} == {0}
    texts = [prose(random.Random(i), 9) if i % 3 else "" for i in range(60)]
    rows = mixing.mix(docs_of(spark, texts, ["a"] + ["b"] * 9)).collect()  # empty texts stand at any place of a source
    assert max(r.copies for r in rows) == mixing.MAX_REPEATS and all(len(r.positions) == r.copies for r in rows)
    twice = docs_of(spark, texts, ["a", "b"])
    rows = mixing.mix(twice.union(twice)).collect()  # repeated rows are mixed like others
    assert len(rows) == 120 and {r.source_size for r in rows} == {2 * 9 * 20}


PAGE = """<!DOCTYPE html><html><head><title>T words here</title><style>p{}</style><script>var a = "</p><article>";</script></head><body>
<header><p>Site header with many words in it</p></header><nav><ul><li><a href=/a>Menu one</a></li><li><a>Menu two</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies for everything you do here</p></div>
<article class="post"><h1>Title &amp;  more</h1><p>First <b>bold</b>\n text&nbsp;here &lt;tag&gt;.<br>next line<p>Second paragraph of the text
<aside><p>Side bar words go here</p></aside><form><label>Name</label><input></form><!-- <p>hidden</p> --><div class="ad">Buy this thing now</div>
<section id="comments"><div><p>Reader says something long here</p></div></section><article class="comment"><p>Another reader</p></article><p>Last &#233;&#x4e00; words.</p></article>
<footer>&copy; nobody in particular at all</footer></body></html>"""
TEXT = "Title & more\n\nFirst bold text here <tag>. next line\n\nSecond paragraph of the text\n\nLast é一 words."


def test_html(spark):
    pages = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p>no main part"), (5, "u", PAGE[: PAGE.index("<footer")]), (5, "u", "<" * 2000), (None, "u", PAGE)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html_text.extract_pages(df).collect()
    assert [r.page_id for r in got] == [p[0] for p in pages] and all(r.n_chars == len(r.text) for r in got)
    assert got[0].text == got[4].text == got[6].text == TEXT
    assert (got[1].text, got[2].text, got[3].text) == ("", "", "no main part")
    assert html_text.extract_pages(df.where("false")).count() == 0


JAPANESE = "".join(chr(0x3042 + (7 * i) % 80) for i in range(1800))


def test_html_without_an_article(spark):
    """Pages without a main element, also in a script without spaces, beside labelled ones."""
    links = "".join(f"<ul><li><a href=/{i}>link number {i} to another story</a></li></ul>" for i in range(10))
    english = " ".join(["reading", "matter"] * 60)
    pages = [(i, "u", PAGE) for i in range(20)] + [(20, "u", f"<div>{links}</div><div><p>{JAPANESE}</p></div>"), (21, "u", f"<div>{links}</div><div><p>{english}</p></div><x-odd7><y8>z</y8></x-odd7>")]
    got = {r.page_id: r.text for r in html_text.extract_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert JAPANESE in got[20] and english in got[21] and got[0] == TEXT


def test_html_names_outside_the_list_share_a_weight(spark):
    page = "<article><p>one two three</p></article>" + "".join(f"<tag{i}>x</tag{i}>" for i in range(3000))
    weights = html_text.learn_weights(spark.createDataFrame([(page,)], "html string"))
    assert set(weights) <= html_text.NAMES | {"", "?"} and weights["?"] == -5.0


@pytest.mark.parametrize(
    "body, want",
    [
        ("<article><p>%s</p><ul><li>one</li><li>two</li><li>three</li></ul></article>", "%s\n\none\n\ntwo\n\nthree"),
        ("<article><p>%s</p><figure><img src=a><figcaption>a caption</figcaption></figure><p>end</p></article>", "%s\n\na caption\n\nend"),
        ('<article><div class="text widget"><p>%s</p></div></article>', "%s"),
        ('<article><p>%s</p><section class="social-history"><h2>Work</h2><p>of many</p></section></article>', "%s\n\nWork\n\nof many"),
        ("<article><p>%s</p></article><p>between them</p><article><p>%s again</p></article>", "%s\n\n%s again"),
        ("<nav><a>Home</a><a>About</a><p>%s</p>", "%s"),
        ("<div><nav><ul><li>Home</div><p>%s</p>", "%s"),
        ("<header>Site<h1>Site</h1></header><main><header><h1>Title</h1></header><p>%s</p><footer>by us</footer></main>", "Title\n\n%s"),
        ('<article><p>%s</p><div class="related-posts"><p>See this</p></div><div class="share-buttons">Share</div><div id="comments"><p>me too</p></div><aside>x</aside><p>end</p></article>', "%s\n\nend"),
        ("<article><table><tr><td>a<td>b<tr><td>c</table><p>%s", "a\n\nb\n\nc\n\n%s"),
    ],
)
def test_nothing_of_an_article_is_lost(body, want):
    weights = {"": 2.7, "p": -0.1, **dict.fromkeys(("li", "ul", "div", "section", "figure", "figcaption", "h1", "h2", "table", "tr", "td"), -5.0)}
    words = "Some words of an article that go on for a while and then stop."
    assert html_text.main_text("<html><body>" + body.replace("%s", words), weights) == want.replace("%s", words)


def test_html_of_many_open_tags_in_linear_time():
    for part in ("<p>a", "<li>a", "<nav>", "<div class=x>", "</div>", "<header>", "<td><tr>"):
        assert html_text.main_text(part * 40_000, {"": 1.0}) is not None


def test_html_of_pages(spark, sf):
    import html as H

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract_pages(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        blocks = [" ".join(H.unescape(re.sub(r"</?b>", "", b).replace("<br>", " ")).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert got[r.page_id] == "\n\n".join(b for b in blocks if b)


def brute_chain(pos, opos):
    best = []
    for i in range(len(pos)):
        gain = max([0.0] + [best[j] - passages.GAP_COST * (pos[i] - pos[j] + opos[i] - opos[j]) for j in range(i) if pos[j] < pos[i] and opos[j] < opos[i]])
        best.append(passages.K + gain)
    return max(best)


def chain_score(chain, pos, opos):
    return passages.K * len(chain) - passages.GAP_COST * (pos[chain[-1]] - pos[chain[0]] + opos[chain[-1]] - opos[chain[0]])


def test_chains_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n = int(rng.integers(2, 40))
        pairs = sorted(set(zip(rng.integers(0, 60, n).tolist(), rng.integers(0, 60, n).tolist(), strict=True)))
        pos, opos = (np.array(c) for c in zip(*pairs, strict=True))
        found = passages.chains(pos, opos)
        assert sorted(np.concatenate(found).tolist()) == list(range(len(pos)))
        for chain in found:
            assert (np.diff(pos[chain]) > 0).all() and (np.diff(opos[chain]) > 0).all()
        assert max(chain_score(c, pos, opos) for c in found) == pytest.approx(brute_chain(pos, opos))


def test_repeated_passages(spark):
    rng = random.Random(7)
    part = prose(rng, 70).split()
    fuzzy = [w if i % 17 else "edit" for i, w in enumerate(part)]
    texts = [prose(rng, 100) for _ in range(30)]
    texts[3] += " " + " ".join(part)
    for i in (8, 11, 20, 29):
        a = texts[i].split()
        texts[i] = " ".join(a[:40] + (fuzzy if i == 11 else part) + a[40:])
    texts[25] += " " + " ".join(part[:30])  # too short
    df = docs_of(spark, texts + [None, "", "short"])
    for parts in (1, 8):
        rows = passages.repeated_passages(df.repartition(parts, "doc_id")).collect()
        assert {r.doc_id for r in rows} == {8, 11, 20, 29} and all(r.other_id < r.doc_id for r in rows)
        for r in rows:  # a pair of later copies may share a part only; the first document has it all
            assert 39 <= r.first_word < r.end_word <= 111
        for d in (8, 11, 20, 29):
            own = [r for r in rows if r.doc_id == d]
            assert min(r.first_word for r in own) in range(39, 42) and max(r.end_word for r in own) in range(107 if d == 11 else 109, 112)
    kept = {r.doc_id: r.text for r in passages.without_repeats(df, passages.repeated_passages(df)).collect()}
    assert kept[3] == texts[3] and kept[25] == texts[25] and kept[30] is None and len(kept) == 33
    a = texts[8].split()
    assert kept[8].split() == a[:40] + a[110:]
    assert passages.repeated_passages(df.where("false")).count() == 0
    assert {r.doc_id for r in passages.repeated_passages(messy(spark)).collect()} == {9}


@pytest.mark.parametrize("gap", [18, 45, 75, 110, 150, 240])
def test_two_passages_around_different_text(spark, gap):
    rng = random.Random(gap)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    one, two = words(60), words(60)
    df = docs_of(spark, [" ".join(words(30) + one + words(gap) + two + words(30)) for _ in range(2)])
    rows = passages.repeated_passages(df).collect()
    cut = {k for r in rows for k in range(r.first_word, r.end_word)}
    same = set(range(30, 90)) | set(range(90 + gap, 150 + gap))
    assert {r.doc_id for r in rows} == {1} and same <= cut and (gap == 18 or cut == same)


@pytest.mark.parametrize(("lines", "size"), [(4, 15), (3, 20), (2, 30)])
def test_passage_of_frequent_lines(spark, lines, size):
    rng = random.Random(lines)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    own = [words(size) for _ in range(lines)]
    for _ in range(2):
        texts = []
        for _ in range(60):
            parts = [words(30), *(w for line in own if rng.random() < 0.4 for w in (line, words(30))), words(20)]
            texts.append(" ".join(parts))
        a, b = sorted(rng.sample(range(60), 2))
        for i in (a, b):
            texts[i] = " ".join([words(40), *own, words(40)])
        for parts in (1, 7):
            rows = passages.repeated_passages(docs_of(spark, texts).repartition(parts, "doc_id")).where(f"doc_id = {b}").collect()
            assert {k for r in rows for k in range(r.first_word, r.end_word)} >= set(range(40, 40 + lines * size))


def test_passage_three_times_in_a_document(spark):
    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    part = words(60)
    later = [w for _ in range(3) for w in words(40) + part] + words(40)
    df = docs_of(spark, [" ".join(words(50) + part + words(50)), " ".join(later), *(" ".join(words(80)) for _ in range(5))])
    rows = passages.repeated_passages(df).collect()
    assert {k for r in rows for k in range(r.first_word, r.end_word)} == {k + b for b in (40, 140, 240) for k in range(60)}
    assert not set(part) & set(passages.without_repeats(df, passages.repeated_passages(df)).where("doc_id = 1").first().text.split())


def test_parts_of_a_passage_in_other_documents(spark):
    """Documents that hold a part of a passage do not hide it from those that hold it all."""
    rng = random.Random(8)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    part = words(70)
    cuts = [(0, 40), (30, 70), (0, 70)] * 2
    df = docs_of(spark, [" ".join(words(60) + part[a:b] + words(60)) for a, b in cuts])
    for parts in (1, 6):
        rows = passages.repeated_passages(df.repartition(parts, "doc_id")).where("doc_id = 5").collect()
        assert {k for r in rows for k in range(r.first_word, r.end_word)} >= set(range(60, 130))


def test_passages_of_null_and_repeated_ids(spark):
    rng = random.Random(12)
    part, a, b = prose(rng, 70), prose(rng, 60), prose(rng, 60)
    rows = [(None, f"{a} {part}"), (3, f"{b} {part}"), (3, f"{b} {part}"), (4, f"{part} {a}"), (4, f"{part} {a}"), (None, None)]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").withColumn("pos", F.lit(1))).collect()
    assert {(r.doc_id, r.other_id) for r in got} == {(4, 3)} and {k for r in got for k in range(r.first_word, r.end_word)} >= set(range(70))


def repeated_runs(texts, n):
    """Places of each document that lie in a run of n words of a document before it."""
    seen, out = {}, {}
    for i, text in sorted(texts.items()):
        w = text.split()
        runs = [tuple(w[k : k + n]) for k in range(len(w) - n + 1)]
        out[i] = {k + j for k, r in enumerate(runs) if r in seen for j in range(n)}
        for r in runs:
            seen.setdefault(r, i)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_no_repeated_run_is_lost_and_no_other_found(spark, monkeypatch, seed):
    rng = random.Random(seed)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    pool = [words(rng.randint(15, 120)) for _ in range(12)]
    texts = {}
    for i in range(60):
        w = words(20)
        for _ in range(rng.randint(0, 4)):
            piece = rng.choice(pool)
            a = rng.randint(0, len(piece) // 2)
            w += piece[a : a + rng.randint(10, 100)] + words(rng.randint(0, 40))
        texts[i] = " ".join(w)
    monkeypatch.setattr(passages, "JOINED", 64)
    want = repeated_runs(texts, 50)
    short = repeated_runs(texts, 8)  # what is found must mostly be made of real repeats
    for parts in (1, 5):
        got = collections.defaultdict(set)
        for r in passages.repeated_passages(docs_of(spark, [texts[i] for i in range(60)]).repartition(parts, "doc_id")).collect():
            assert r.matched >= 0.8 * (r.end_word - r.first_word) and r.end_word - r.first_word >= 50 and r.other_id < r.doc_id
            got[r.doc_id] |= set(range(r.first_word, r.end_word))
        for i in texts:
            assert want[i] <= got[i] and len(got[i] - short[i]) <= 0.25 * len(got[i])


@pytest.mark.parametrize(("share", "least"), [(0.05, 0.99), (0.1, 0.95), (0.15, 0.85)])
def test_recall_of_edited_passages(spark, share, least):
    rng = random.Random(int(share * 100))
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts, alike = [], {}
    for i in range(60):
        part = words(60)
        edits = set(rng.sample(range(1, 59), round(share * 60)))
        texts += [" ".join(words(70) + part + words(70)), " ".join(words(70) + [f"e{k}" if k in edits else w for k, w in enumerate(part)] + words(70))]
        alike[2 * i + 1] = True
    found = {r.doc_id for r in passages.repeated_passages(docs_of(spark, texts)).collect()}
    assert found <= set(alike) and len(found) >= least * len(alike)


@pytest.mark.parametrize(("size", "share"), [(20, 0.15), (40, 0.18), (40, 0.09)])
@pytest.mark.parametrize("parts", [1, 8])
def test_variants_of_one_passage_find_each_other(spark, size, share, parts):
    """Groups of edited copies of a passage that the first document has whole: a later one
    that is alike to any before it has a row."""
    rng = random.Random(size + int(share * 100))
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    texts, alike = [], set()
    for _ in range(6):
        whole, before = words(60), []
        for k in range(size):
            part = list(whole)
            for place in rng.sample(range(60), round(share * 60)) if k else ():
                part[place] = words(1)[0]
            if any(sum(map(str.__eq__, part, old)) >= 48 for old in before):
                alike.add(len(texts))
            before.append(part)
            texts.append(" ".join(words(40) + part + words(40)))
    found = {r.doc_id for r in passages.repeated_passages(docs_of(spark, texts).repartition(parts, "doc_id")).collect()}
    assert len(alike) == 6 * (size - 1) and len(found & alike) >= 0.95 * len(alike) and found <= alike


def test_bits_of_the_words_around_a_seed():
    rng = np.random.default_rng(4)
    bound = np.array([0, 60, 60, 75, 200, 900])
    words = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    one = (words >> np.uint64(40)).astype(int) & 1
    own, pos, _, around = passages.minimizers(words, bound)
    assert len(own) and (around.view(np.uint16) > 0).any()
    for text, p, got in zip(own, pos, around.view(np.uint16).tolist(), strict=True):
        mine = one[bound[text] : bound[text + 1]]
        places = [*range(p - passages.AROUND, p), *range(p + passages.K, p + passages.K + passages.AROUND)]
        assert got == sum(int(mine[q]) << k for k, q in enumerate(places) if 0 <= q < len(mine))
    same = around.copy()
    assert passages.alike_around(around, same).all()
    same ^= np.int16(0b11)  # two words before differ, none behind
    assert passages.alike_around(around, same).all()
    same ^= np.int16(0b11 << passages.AROUND)
    assert not passages.alike_around(around, same).any()


def test_runs_by_the_bits_of_frequent_seeds(spark):
    rng = random.Random(6)
    line = " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    raw, off = common.buffers(pa.array([line, " ".join(f"x{i}" for i in range(60))]))
    words, bound = common.words_of(raw, off)
    own, _, seed, _ = passages.minimizers(words, bound)
    seeds = spark.createDataFrame([(int(v),) for v in seed[own == 0]], "seed long")
    table = passages._table(seeds.union(seeds))  # a table of one size, whatever it tells
    assert table.nbytes == passages.TABLE_BITS // 8 and np.bitwise_count(table).sum() == len(set(seed[own == 0] & np.uint64(passages.TABLE_BITS - 1)))
    text, pos, _ = passages.runs(words, bound, table, 50)
    assert text.tolist() == [0] * 11 and pos.tolist() == list(range(11))  # the other text has no frequent seed
    assert not len(passages.runs(words, bound, passages._table(seeds.where("false")), 50)[0])


def test_segments_of_matches():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        x, y = (np.cumsum(rng.choice([1, 1, 1, 1, 1, 1, 2, 3], n)) for _ in range(2))
        fits = lambda s, e: x[e] - x[s] + 1 >= 12 and e - s + 1 >= 0.8 * max(x[e] - x[s] + 1, y[e] - y[s] + 1) - 1e-9  # noqa: B023, E731
        found = passages.segments(x, y, 12, 0.8)
        assert all(fits(s, e) for s, e in found) and all(a[1] < b[0] for a, b in zip(found, found[1:], strict=False))
        inside = {k for s, e in found for k in range(s, e + 1)}
        assert all(inside & set(range(s, e + 1)) for s in range(n) for e in range(s, n) if fits(s, e))


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_bpe_equals_the_library(spark, encoding):
    texts = [None, "", " ", "a  b\n\n c's I'LL we'll don't", "漢字かな ½² 12345", "x" * 700, "héé" * 60 + " <|endoftext|>", "\u0085a\x1fb　  z", "\U0001f600\U0001f680 ok"]
    df = docs_of(spark, texts)
    for most in (1000, 0):  # by broadcast and by join
        got = {r.doc_id: r for r in bpe.encode(df, PATH, P.PATTERN, broadcast_words=most).collect()}
        for i, t in enumerate(texts):
            ids = encoding.encode_ordinary(t or "")
            assert (got[i].n_tokens, bytes(got[i].ids), bytes(got[i].decoded)) == (len(ids), struct.pack(f"<{len(ids)}I", *ids), (t or "").encode())
    assert bpe.encode(df.where("false"), PATH, P.PATTERN).count() == 0


def test_bpe_of_long_words_and_repeated_rows(spark, encoding, monkeypatch):
    rng = random.Random(11)
    texts = ["w" * 100_000, "あいう漢字" * 4000, "".join(rng.choice("abcdeé") for _ in range(30_000)), "ab" * 99, "ab" * 101]
    df = docs_of(spark, texts)
    for r in bpe.encode(df.union(df), PATH, P.PATTERN).collect():
        ids = encoding.encode_ordinary(texts[r.doc_id])
        assert bytes(r.ids) == struct.pack(f"<{len(ids)}I", *ids) and bytes(r.decoded) == texts[r.doc_id].encode()
    ranks = bpe.read_ranks(PATH)
    for _ in range(500):
        word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ABCé漢字かな") for _ in range(rng.randint(1, 60))).encode()
        assert bpe.merge_by_heap(word, ranks) == encoding._encode_single_piece(word)


def test_bpe_of_documents(spark, sf, encoding):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op6_byte_bpe(spark, sf).collect():
        ids = encoding.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest() and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def base_scores(texts):
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t in texts.items()}
    count = collections.Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    floor = math.log10(sum(count.values()) + len(count) + 1)
    return count, {i: (len(ws), sum(w in count for w in ws), sum(math.log10(count[w] + 1) - floor for w in ws)) for i, ws in tokens.items()}


def test_lm_scores(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    count, want = base_scores(texts)
    got = {r.doc_id: r for r in queries.op7_lm_scores(spark, sf).collect()}
    assert set(got) == set(texts)
    for i, r in got.items():
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (want[i][0], want[i][1], sum(count.values()), zlib.crc32(str(i).encode()) % 7 == 2)
        assert r.base_score == pytest.approx(want[i][2], abs=1e-6) and r.score < 0
    apart = {r.doc_id: r for r in lm.lm_scores(spark.read.parquet(f"{sf}/documents.parquet"), bpe.read_ranks(PATH), P.PATTERN, broadcast_words=500).collect()}
    for i, r in got.items():  # most words by join: the same
        assert apart[i].n_known == r.n_known and apart[i].base_score == pytest.approx(r.base_score) and apart[i].score == pytest.approx(r.score, abs=1e-3)
    # better than the base on held-out texts whose words are known (of others the base scores no spelling)
    held = [r for r in got.values() if r.held_out and r.n_known >= 0.98 * r.n_tokens]
    assert not held or sum(r.score for r in held) > sum(r.base_score for r in held)


@pytest.fixture(scope="module")
def small_model(spark):
    """A model of two-word texts."""
    rng = random.Random(2)
    texts = [f"{rng.choice(['red', 'green', 'blue'])} {rng.choice(['house', 'boat'])}" for _ in range(300)]
    ranks = spark.sparkContext.broadcast(bpe.read_ranks(PATH))
    from functools import partial

    rows = docs_of(spark, texts).select("doc_id", "text").mapInArrow(partial(lm._counted, ranks=ranks, pattern=P.PATTERN), "kind int, key long, n long, first int, ids binary")
    model, counts = lm.learn(common.staged(rows))
    return spark.sparkContext.broadcast(model), spark.sparkContext.broadcast(lm._broadcast_counts(counts)), ranks


def scores_of(small_model, texts):
    model, counts, ranks = small_model
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
    return np.concatenate([b.column("score").to_numpy() for b in lm._scored([batch], ranks, P.PATTERN, model, counts, True)])


def test_lm_probabilities_add_up_to_one_at_most(small_model, encoding):
    words = ["red", "green", "blue", "house", "boat", "zqxv", "zqxw", "a", "reds"]
    one = scores_of(small_model, words)
    total = (10.0 ** scores_of(small_model, [""]))[0] + (10.0**one).sum()
    total += (10.0 ** scores_of(small_model, [" ".join(p) for p in itertools.product(words, repeat=2)])).sum()
    assert 0.5 < total <= 1 + 1e-6
    # of the words of one first id: known ones by count, and all spellings of unseen ones within the rest
    model = small_model[0].value
    first = encoding.encode_ordinary(" zqxv")[0]
    after = [[first, i] for i in range(50_256)]
    assert 0 < np.exp(lm.spelled(model, [[first]])).sum() + np.exp(lm.spelled(model, after)).sum() <= 1 + 1e-4


def test_lm_scores_the_spelling_of_unseen_words(small_model):
    a, b, c, d = scores_of(small_model, ["zqxv", "zqxvjkjk", "zqxv" * 7, "zqxvjkjkjkjkjkjkjk"])
    assert len({round(x, 6) for x in (a, b, c, d)}) == 4 and a > c and b > d


def test_lm_networks_learn():
    rng = np.random.default_rng(3)
    ids = np.stack((rng.integers(0, 3, 4000), rng.integers(5, 7, 4000)), axis=1).ravel()  # one of three, one of two
    x, own = lm.windows(ids, np.arange(0, 8001, 2))
    total = np.bincount(x[:, lm.SPAN // 2 + 1 :].ravel(), minlength=lm.IDS)
    total[lm.PAD] = 0
    w, group = lm._start(total, rng.random((lm.KNOWN_IDS, lm.CONTEXTS)))
    for _ in range(6):
        w, loss = lm.train(w, x, group, 0.02)
    net = lm.Net(w, group, total)
    want = -(math.log(3) + math.log(2))
    assert np.abs(lm.attended(net, x, own, 4000) - want).max() < 0.35 and abs(lm.attended(net, x, own, 4000).mean() - want) < 0.1


def test_lm_trains_on_every_window():
    class Ranks:
        value = bpe.read_ranks(PATH)

    texts = ["one short text", "the word " * 100, "", None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4), pa.int64()), pa.array(texts, pa.string())], ["id", "text"])
    rows = [r for b in lm._counted([batch], Ranks, P.PATTERN) for r in b.to_pylist() if r["kind"] == 1]
    got = np.frombuffer(b"".join(r["ids"] for r in rows), np.uint16).reshape(-1, lm.SPAN + 1)[:, lm.SPAN // 2 + 1 :]
    assert len(rows) == 1 + 13 + 1 + 1 and (got != lm.PAD).sum() == 3 + 200 + 4


def test_lm_windows_cover_each_target_once():
    counts = [0, 1, 15, 16, 17, 40]
    bound = np.concatenate(([0], np.cumsum(counts)))
    first = np.arange(bound[-1]).astype(np.int32) + 1
    x, text = lm.windows(first, bound)
    for t, n in enumerate(counts):
        own = x[text == t][:, lm.SPAN // 2 + 1 :].ravel()
        assert own[own != lm.PAD].tolist() == [*first[bound[t] : bound[t + 1]].tolist(), lm.END]


def test_lm_gradients_and_causality():
    rng = np.random.default_rng(0)
    total = np.zeros(lm.IDS, np.int64)
    total[:50] = rng.integers(1, 99, 50)
    w, group = lm._start(total, rng.random((lm.KNOWN_IDS, lm.CONTEXTS)))
    w = {k: v.astype(np.float64) for k, v in w.items()}
    w["B"] += rng.normal(0, 0.3, w["B"].shape)
    x = rng.integers(0, 50, (3, lm.SPAN + 1)).astype(np.uint16)
    x[0, : lm.SPAN // 2] = lm.PAD
    x[0, lm.SPAN // 2] = lm.BEGIN
    _, g = lm.gradients(w, x, group)
    for k in w:
        at = tuple(rng.integers(0, s) for s in w[k].shape) if k != "E" else (int(x[1, 5]), 3)
        up, down = ({n: v.copy() for n, v in w.items()} for _ in range(2))
        up[k][at] += 1e-4
        down[k][at] -= 1e-4
        own = g[k][at] if k != "E" else g["E"][1][g["E"][0].tolist().index(at[0])][3]
        assert own == pytest.approx((lm.gradients(up, x, group)[0] - lm.gradients(down, x, group)[0]) / 2e-4, rel=2e-2, abs=1e-6)
    y = x.copy()
    y[:, 25] = 7  # what comes later does not matter
    assert np.allclose(lm.forward(w, x[:, : lm.SPAN])[:, : 25 - lm.SPAN // 2], lm.forward(w, y[:, : lm.SPAN])[:, : 25 - lm.SPAN // 2])


def test_lm_encodes_many_words_at_once(encoding):
    lexer, calls = lm.Lexer(bpe.read_ranks(PATH), P.PATTERN), []
    rng = random.Random(4)
    words = ["".join(rng.choice(["a", "Re", "'s", "9", "-", "\x1c", "é", "中"]) for _ in range(rng.randrange(1, 9))) for _ in range(500)]
    odd = ["a\u00a0", "\u3000b", "\u2003", "Â", "x\u0085y"]  # white space of their own, or its first byte
    words = [*words[:250], *odd, *words[250:]]

    class Counting:
        def encode_ordinary(self, text):
            calls.append(text)
            return encoding.encode_ordinary(text)

    lexer.encoding = Counting()
    raw, off = common.buffers(pa.array([" ".join(words[:300]), " ".join(words[300:])]))
    place = np.array(rng.sample(range(len(words)), len(words)))  # in any order
    ids, bound = lexer.ids(raw, off, place)
    lower = lambda w: "".join(c.lower() if c.isascii() else c for c in w)
    assert [ids[a:b].tolist() for a, b in zip(bound[:-1], bound[1:], strict=True)] == [encoding.encode_ordinary(" " + lower(words[k])) for k in place]
    assert len(calls) <= 1 + len(odd)
    assert [x.tolist() for x in lexer.ids(raw, off, place[:0])] == [[], [0]]


def test_lm_edges(spark):
    ranks = bpe.read_ranks(PATH)
    rows = {r.doc_id: r for r in lm.lm_scores(messy(spark), ranks, P.PATTERN).collect()}
    assert len(rows) == 12 and rows[0].n_tokens == rows[1].n_tokens == 1 and all(math.isfinite(r.score) for r in rows.values())
    assert rows[8].base_score == rows[9].base_score
    assert lm.lm_scores(messy(spark).where("false"), ranks, P.PATTERN).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    x = (centres[rng.integers(0, 12, 1500)] + 0.4 * rng.normal(size=(1500, 16))).astype(np.float32)
    x[500:800] = x[0]  # copies of one vector
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(2000, None, 0), (2100, [0.0] * 16, 0), (2200, [float("nan")] * 16, 0), (2300, [None] * 16, 0), (2400, [1.0, 2.0], 0), (2500, [float("inf")] * 16, 0), (2600, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("score", F.lit("clash"))
    got = collections.defaultdict(list)
    for r in hnsw.nearest(df, F.col("vec_id") % 100 == 0, shard_rows=400).orderBy("query_id", "rank").collect():
        assert r.rank == len(got[r.query_id]) + 1
        got[r.query_id].append((r.score, r.vec_id))
    assert set(got) == set(range(0, 1500, 100))
    hits = 0
    for q in range(0, 1500, 100):
        far = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        want = sorted((d, i) for i, d in enumerate(far.tolist()) if i != q)[:10]
        assert got[q] == sorted(got[q]) and all(d == far[i] for d, i in got[q])
        hits += len(set(want) & set(got[q]))
    assert hits >= 0.9 * 150
    assert got[500] == [(0.0, i) for i in [0, *range(501, 510)]]
    few = hnsw.nearest(df.where("vec_id < 3 or vec_id = 2400"), F.col("vec_id") == 0).collect()
    assert len(few) == 2 and hnsw.nearest(df.where("false"), F.col("vec_id") == 0).count() == 0


def test_recall_on_the_table(spark):
    """Ten shards of the table's vectors, two blocks of queries, against brute force."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.select("vec_id", "embedding").collect()
    x, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    got = collections.defaultdict(list)
    for r in hnsw.nearest(df, F.col("vec_id") % 50 == 0, shard_rows=200).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    hits = 0
    for q in ids[ids % 50 == 0]:
        far = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        hits += len(set(got[q]) & {i for _, i in sorted((d, i) for d, i in zip(far.tolist(), ids.tolist(), strict=True) if i != q)[:10]})
    assert hits >= 0.9 * 10 * len(got) and len(got) == (ids % 50 == 0).sum()


def test_neighbours_in_blocks_and_repeated_ids(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = sorted(map(tuple, hnsw.nearest(df, F.col("vec_id") % 10 == 0).collect()))
    monkeypatch.setattr(hnsw, "BLOCK_VALUES", 50)
    assert sorted(map(tuple, hnsw.nearest(df.union(df), F.col("vec_id") % 10 == 0).collect())) == want
    low = spark.createDataFrame([(0, [-100.0] * 8)], df.schema)
    assert {r.vec_id for r in hnsw.nearest(df.union(low), F.col("vec_id") == 10, k=299).collect()} == set(range(300)) - {10}


def test_media_query_against_the_texts(spark, sf):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op9_media(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = texts[r.doc_id] + b"\0" * (-len(texts[r.doc_id]) % 64 or 64 * (not texts[r.doc_id]))
        file = media.encode_all([want])[0]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id]), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(file), hashlib.sha256(file).hexdigest())
        clips = [tuple(map(int, c.split("-"))) for c in r.feature.split(";")]
        assert clips[0][0] == 0 and clips[-1][1] == -(-len(want) // 4096) - 1 and all(a[1] + 1 == b[0] for a, b in zip(clips, clips[1:], strict=False))
        assert [c[:2] for c in clips] == brute_shots(want) and all(c[2:] == (c[0] * 40, c[1] * 40 + 40) for c in clips)


def brute_shots(payload):
    """Cuts where the difference of neighbouring histograms stands out of those around it."""
    hists = [np.bincount(np.frombuffer(payload[i : i + 4096], np.uint8) >> 3, minlength=32) / len(payload[i : i + 4096]) for i in range(0, len(payload), 4096)]
    diff = [float(np.abs(a - b).sum()) for a, b in zip(hists, hists[1:], strict=False)]
    cuts = [0]
    for i, d in enumerate(diff):
        near = diff[max(0, i - media.NEAR) : i + media.NEAR + 1]
        if d > media.FLOOR and d > np.mean(near) + media.SPREAD * np.std(near):
            cuts.append(i + 1)
    return [(a, b - 1) for a, b in zip(cuts, [*cuts[1:], len(hists)], strict=True)]


def test_media_that_is_null_foreign_or_broken(spark):
    good = media.encode_all([b"x" * 6400])[0]
    coded = good.replace(b"MJPG", b"XXXX")
    at = media.frames_of(good)[0]
    holed = good[: at[0] + 100] + b"\xff\xd9" + good[at[0] + 102 :]
    rows = [(1, good), (2, None), (3, b""), (4, b"GIF89a"), (5, good[:100]), (6, good[:900]), (7, holed), (8, coded), (None, good)]
    df = spark.createDataFrame([(i, 6400, m) for i, m in rows], "id long, n_bytes long, media binary").coalesce(1)
    got = {r.id: r for r in media.read_media(df).collect()}
    want = hashlib.sha256(b"x" * 6400).hexdigest()
    assert len(got) == 9 and got[1].payload_sha256 == got[8].payload_sha256 == got[None].payload_sha256 == want and got[1].error is None
    assert (got[2].error, got[2].media_bytes, got[2].clips) == ("no media", None, []) and got[4].error == "not an AVI file" and got[4].media_bytes == 6
    assert all(got[i].error and got[i].payload_bytes is None and got[i].clips == [] for i in (2, 3, 4, 5, 6, 7))
    assert media.clip_rows(media.read_media(df)).where("id = 4").count() == 0


def test_media_round_trip(spark):
    rng = random.Random(1)
    texts = [None, "", "x", "é" * 32, "a" * 64, "b" * 65, "".join(chr(rng.randint(32, 0x2FF)) for _ in range(30_000)), "A" * 9000 + "z" * 9000, "x"]
    df = docs_of(spark, texts)
    files = {r.id: bytes(r.media) for r in media.to_media(df).collect()}
    for i, t in enumerate(texts):
        want = (t or "").encode()
        want += b"\0" * (max(64, -(-len(want) // 64) * 64) - len(want))
        pixels, counts = media.decode_all([files[i]])
        assert pixels.tobytes() == want and counts == [len(want) // 64]
        assert files[i][:4] == b"RIFF" and struct.unpack_from("<I", files[i], 4)[0] == len(files[i]) - 8
        assert [files[i][o : o + 2] for o, _ in media.frames_of(files[i])] == [b"\xff\xd8"] * -(-len(want) // 4096)
    assert files[2] == files[8]
    rows = {r.id: r for r in media.read_media(media.to_media(df)).collect()}
    assert rows[7].payload_sha256 == hashlib.sha256(texts[7].encode() + b"\0" * (-18000 % 64)).hexdigest() and rows[1].n_bytes == 0
    clips = media.clip_rows(media.read_media(media.to_media(df))).where("id = 7").orderBy("clip").collect()
    assert [c.first_frame for c in clips][:2] == [0, 2] and clips[-1].last_frame == 4 and clips[0].end_ms == 80
    assert media.read_media(media.to_media(df.where("false"))).count() == 0


def test_any_bytes_survive_coding():
    rng = np.random.default_rng(3)
    pixels = rng.integers(0, 256, (200, 64)).astype(np.uint8)
    pixels[:50] = rng.choice([0, 255], (50, 64))
    assert media.decode_all(media.encode_all([pixels[:70].tobytes(), pixels[70:].tobytes()]))[0].tobytes() == pixels.tobytes()
    with pytest.raises(ValueError):
        media.frames_of(b"RIFFxxxxWAVE")


def test_rollup_commits_are_idempotent(spark):
    row = spark.createDataFrame([("s", "en", "w", 5, 3), (None, None, "w", 2, 2)], "source string, lang string, tokenizer string, tokens long, old_tokens long")
    r = rollups.Rollup(spark)
    r.commit(1, rollups.inserts(row), rollups.inserts(row))
    r.commit(2, rollups.revisions(row))
    r.commit(2, rollups.revisions(row))
    r.commit(3, rollups.deletes(row))
    r.commit(4, rollups.deletes(row.where("false")))
    want = {("s", 1, 5 + 2), (None, 1, 2)}
    assert {(x.source, x.n_docs, x.n_tokens) for x in r.totals([1, 2, 3, 4, 2]).collect()} == want
    assert {(x.source, x.n_docs, x.n_tokens) for x in r.totals(r.compact([1, 2, 3, 4], 9)).collect()} == want
    # what a compacted batch was made of does not count again, nor after another compaction
    assert {(x.source, x.n_docs, x.n_tokens) for x in r.totals([1, 2, 3, 4, 9]).collect()} == want
    assert {(x.source, x.n_docs, x.n_tokens) for x in r.totals([*r.compact([9], 10), 1, 9]).collect()} == want


def test_rollup_that_dies_leaves_the_last_commit(spark, monkeypatch):
    row = spark.createDataFrame([("s", "en", "w", 5)], "source string, lang string, tokenizer string, tokens long")
    r = rollups.Rollup(spark)
    r.commit(1, rollups.inserts(row))
    broken = rollups.inserts(row).withColumn("d_tokens", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        r.commit(1, broken)
    again = rollups.Rollup(spark, r.folder)
    assert [(x.n_docs, x.n_tokens) for x in again.totals([1]).collect()] == [(1, 5)]
    monkeypatch.setattr(rollups.Rollup, "manifest", lambda self: (0, {}))  # a writer that does not know of version 1
    with pytest.raises(Exception, match="(?i)exists"):
        again.commit(2, rollups.inserts(row))


def test_rollup_edges(spark):
    rows = rollups.corpus_rollup(messy(spark)).collect()
    assert sum(r.n_docs for r in rows) == 2 * 11
    assert rollups.corpus_rollup(messy(spark).where("false")).count() == 0


@pytest.mark.parametrize("name", ["op3_mixing", "op10_token_rollup"])
def test_queries_equal_their_sql(spark, sf, name):
    got = queries.queries()[name](spark, sf)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    rel = con.sql(queries.oracle_sql()[name])
    order = sorted(rel.columns)
    assert order == sorted(got.columns)
    tidy = lambda rows: sorted((tuple(None if v is None else v if isinstance(v, str) else round(float(v), 9) + 0.0 for v in r) for r in rows), key=str)
    assert tidy(tuple(r[c] for c in order) for r in got.collect()) == tidy(tuple(r[rel.columns.index(c)] for c in order) for r in rel.fetchall())


def test_messy_tables_join_and_mix(spark):
    rows = {r.doc_id: r for r in ngram_join.jaccard_join(messy(spark)).collect()}
    assert len(rows) == 12 and rows[9].component_id == 8 and rows[5].component_id == 4 and rows[0].n_shingles == 0
    assert ngram_join.jaccard_join(messy(spark).where("false")).count() == 0


@pytest.mark.parametrize("parts", [1, 7])
def test_partners_by_frequent_seeds_only(spark, monkeypatch, parts):
    """Passages that share no seed but those of a line that most documents have: the partner is neither the first nor the
    previous document with that line, and places of a seed are in several tiles."""
    monkeypatch.setattr(passages, "TILE", 16, raising=False)
    rng = random.Random(11)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    line, pairs = words(16), [(5, 33), (9, 21), (12, 70)]
    texts = [words(60) + line + words(60) for _ in range(80)]
    for a, b in pairs:
        for own in [words(40)]:
            for d in (a, b):  # one word in five differs, so that no five in a row are equal
                texts[d] = words(50) + line + [w if k % 5 else words(1)[0] for k, w in enumerate(own)] + words(50)
    texts[50] = texts[33]  # the same words around: a run
    rows = passages.repeated_passages(docs_of(spark, [" ".join(t) for t in texts]).repartition(parts, "doc_id")).collect()
    got = collections.defaultdict(set)
    for r in rows:
        got[r.doc_id] |= set(range(r.first_word, r.end_word))
        assert r.matched >= 0.8 * (r.end_word - r.first_word) and r.end_word - r.first_word >= 50
    assert set(got) == {33, 21, 70, 50} and all(got[b] >= set(range(50, 104)) for b in got)


def test_places_of_a_seed_against_all_pairs(monkeypatch):
    """Every place with a passage of an earlier document around it has a match, whatever the sizes of passes."""
    rng = np.random.default_rng(9)
    base = rng.integers(1, 256, (4, 100)).astype(np.uint8)
    near = base[rng.integers(0, 4, 150)]
    near = np.where(rng.random(near.shape) < rng.choice([0.05, 0.12, 0.3], (150, 1)), rng.integers(1, 256, near.shape), near).astype(np.uint8)
    near[::7, :20] = 0
    ids = np.sort(rng.integers(0, 90, 150))
    want = {i for i in range(150) if any(ids[j] < ids[i] and passages.in_passage(near[i : i + 1], near[j : j + 1], 50, 0.8)[0] for j in range(i))}
    for pairs in (1, 300, 1 << 18):
        monkeypatch.setattr(passages, "PAIRS", pairs)
        u, j = passages.first_alike(near, passages._planes(near), ids, np.zeros(150, int), 50, 0.8)
        assert sorted(u.tolist()) == sorted(want) and 20 < len(want) < 150
        assert (ids[j] < ids[u]).all() and passages.in_passage(near[u], near[j], 50, 0.8).all()
    part = rng.integers(0, 2, 150)
    u, j = passages.first_alike(near, passages._planes(near), ids, part, 50, 0.8)
    assert (part[u] != part[j]).all()


def test_passage_around_a_seed():
    rng = np.random.default_rng(2)
    for _ in range(300):
        x = rng.integers(1, 256, (1, 100)).astype(np.uint8)
        y = np.where(rng.random((1, 100)) < rng.choice([0.1, 0.2, 0.3]), x ^ 255, x).astype(np.uint8)
        same = (x == y)[0] & (x[0] > 0)
        row = np.concatenate((same[:50], np.ones(5, bool), same[50:]))
        brute = any(row[i] and row[j - 1] and row[i:j].sum() >= 0.8 * (j - i) - 1e-9 for i in range(51) for j in range(max(55, i + 50), 106))
        assert bool(passages.in_passage(x, y, 50, 0.8)[0]) == brute
