"""Neighbours, HTML extraction, toxicity, the Jaccard join and the pipeline."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklake.llm import ann, components, html_extract, jaccard_join, toxicity

# -- nearest neighbours


def brute_nearest(rows, k=10):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, np.float32).astype(float)
    out = {}
    for q in good:
        if q % 100 == 0:
            found = sorted((float(np.sqrt(((good[q] - v) ** 2).sum())), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
            if found:
                out[q] = [(n + 1, i, d) for n, (d, i) in enumerate(found[:k])]
    return out


def found_nearest(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r.query_id].append((r["rank"], r.vec_id, r.score))
    return {q: sorted(v) for q, v in out.items()}


def test_nearest_on_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(1, 60)]
    rows += [(100, [1.0, 0.0, 0.0, 0.0]), (200, [1.0, -0.0, 0.0, 0.0]), (300, None), (400, []), (500, [nan, 1.0, 1.0, 1.0]), (600, [inf, 1.0, 1.0, 1.0])]
    rows += [(700, [0.0] * 4), (800, [None, 1.0, 1.0, 1.0]), (None, [1.0, 0.0, 0.0, 0.0]), (900, [1.0, 2.0]), (901, [2.0, 2.0]), (1000, [5.0])]
    rows += [(i, [1.0, 0.0, 0.0, 0.0]) for i in range(2000, 2030)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id bigint, embedding array<float>, rank string")
    got, want = found_nearest(ann.nearest(df)), brute_nearest(rows)
    assert got == want and set(want) == {100, 200, 900, 2000} and len(got[900]) == 1
    assert ann.nearest(df.limit(0)).count() == 0
    assert ann.nearest(df.where("vec_id = 100")).count() == 0


def test_recall_over_many_lists(spark):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(40, 16)) * 3
    x = (centers[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 16))).astype(np.float32)
    rows = list(enumerate(x.tolist()))
    got, want = found_nearest(ann.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"))), brute_nearest(rows)
    pairs = lambda d: {(q, i) for q, v in d.items() for _, i, _ in v}
    assert ann.recall(pairs(got), pairs(want)) >= 0.95
    for q, v in got.items():
        assert all(d == pytest.approx(float(np.linalg.norm(x[q].astype(float) - x[i].astype(float))), rel=1e-12) for _, i, d in v)


def test_recall_does_not_fall_with_more_lists(spark, monkeypatch):
    # Vectors without clusters, in many short lists: a fixed number of lists holds ever fewer of the neighbours.
    monkeypatch.setattr(ann, "LIST_ROWS", 8)
    monkeypatch.setattr(ann, "CALIBRATED_RECALL", 0.995)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(8000, 32)).astype(np.float32)
    rows = list(enumerate(x.tolist()))
    got, want = found_nearest(ann.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"))), brute_nearest(rows)
    pairs = lambda d: {(q, i) for q, v in d.items() for _, i, _ in v}
    assert ann.recall(pairs(got), pairs(want)) >= 0.98


@pytest.mark.parametrize("size", [400, 2000])
def test_small_tables_are_searched_by_lists(spark, monkeypatch, size):
    """Lists prune on tables of the given sizes too, and a query that reads all of them gets exact results."""
    read, answers = [], ann._answers

    def watched(postings, probes, *rest):
        read.append((postings.select("list").distinct().count(), probes.count() / max(1, probes.select("rep").distinct().count())))
        return answers(postings, probes, *rest)

    monkeypatch.setattr(ann, "_answers", watched)
    x = np.random.default_rng(12).normal(size=(size, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    rows = list(enumerate(x.tolist()))
    table, want = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), brute_nearest(rows)
    asked = F.col("vec_id") % 10 == 0
    pairs = lambda d: {(q, i) for q, v in d.items() for _, i, _ in v}
    got = found_nearest(ann.nearest(table, asked))
    assert len(got) == size // 10 and ann.recall(pairs({q: got[q] for q in want}), pairs(want)) >= 0.9
    lists, each = read[0]
    assert lists >= int(size**0.5) - 1 and each < (lists / 2 if size == 2000 else lists)
    monkeypatch.setattr(ann, "reach_for", lambda entries, wanted, graph, k: ann.Reach(np.inf, len(graph.centroids)))
    assert found_nearest(ann.nearest(table)) == want


def test_calibration_leaves_queries_to_the_lists(spark, monkeypatch):
    """Few queries are not answered by their own calibration; of many, a share is."""
    seen, true = [], ann._true_neighbours
    monkeypatch.setattr(ann, "CALIBRATION", 20)
    monkeypatch.setattr(ann, "_true_neighbours", lambda entries, ids, x, k: seen.append(set(ids.tolist())) or true(entries, ids, x, k))
    x = np.random.default_rng(13).normal(size=(600, 8)).astype(np.float32)
    table = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id bigint, embedding array<float>")
    assert ann.nearest(table).count() == 60 and ann.nearest(table, F.col("vec_id") % 2 == 0).count() == 3000
    assert all(len(s) == 20 for s in seen) and any(i % 2 for i in seen[0]) and not any(i % 2 for i in seen[1])


def test_far_queries_get_ten(spark, monkeypatch):
    """A query far from all but three vectors, one on a crowded point, and a repeated id, in many lists."""
    monkeypatch.setattr(ann, "LIST_ROWS", 16)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 16)).astype(np.float32)
    rows = [(i, v) for i, v in enumerate(x.tolist()) if i]
    far = (1000 + rng.normal(size=(4, 16))).astype(np.float32).tolist()
    rows += [(100_000, far[0]), (100_001, far[1]), (100_002, far[2]), (100_003, far[3])]
    rows += [(200_000 + i, [5.0] * 16) for i in range(700)]
    rows += [(300_000, x[1].tolist()), (300_000, x[2].tolist())]
    got = found_nearest(ann.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")))
    want = brute_nearest([r for r in rows if r[0] != 300_000])
    assert all(len(v) == 10 for v in got.values()) and set(got) == {*want, 300_000}
    assert [i for _, i, _ in got[100_000]][:3] == [i for _, i, _ in want[100_000]][:3]
    assert [i for _, i, _ in got[200_000]] == list(range(200_001, 200_011))
    again = found_nearest(ann.nearest(spark.createDataFrame(rows[::-1], "vec_id bigint, embedding array<float>").repartition(3)))
    assert again[300_000][:1] == got[300_000][:1]


def test_ragged_lengths(spark, monkeypatch):
    monkeypatch.setattr(ann, "FEW_VECTORS", 50)
    monkeypatch.setattr(ann, "CALIBRATED_RECALL", 1.0)
    rng = np.random.default_rng(6)
    rows = [(100 * i, rng.normal(size=n).astype(np.float32).tolist()) for i, n in enumerate([*range(1, 60), *[70] * 80])]
    rows += [(100 * i + 1, rng.normal(size=n).astype(np.float32).tolist()) for i, n in enumerate(range(1, 60))]
    assert found_nearest(ann.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"))) == brute_nearest(rows)


def test_graph_search_finds_nearest_centroids():
    rng = np.random.default_rng(3)
    graph = ann.CentroidGraph.build(rng.normal(size=(1500, 8)))
    x = rng.normal(size=(200, 8))
    found, dist = graph.search(x)
    true = ann._distances(x, graph.centroids).argmin(1)
    assert (found[:, 0] == true).mean() > 0.97 and (np.diff(dist, axis=1) >= 0).all()
    wide, far = graph.search(x, 300)
    near = ann._distances(x, graph.centroids).argsort(1)[:, :300]
    assert np.mean([len(set(a) & set(b)) / 300 for a, b in zip(wide.tolist(), near.tolist(), strict=True)]) > 0.97
    d = np.sqrt(ann._distances(x, graph.centroids))
    place = d.argsort(1).argsort(1)
    for ratio, width in [(1.0, 64), (1.1, 400), (1.5, 64), (1.5, 400), (50.0, 100)]:
        rows, lists = ann.probes_of(graph, x, ann.Reach(ratio, width))
        want = {(i, j) for i, j in zip(*np.nonzero((d <= ratio * d.min(1, keepdims=True)) & (place < width)), strict=True)}
        got = set(zip(rows.tolist(), lists.tolist(), strict=True))
        assert len(got) == len(rows) and len(want & got) >= 0.97 * len(want) and len(got) <= 1.03 * len(want)


# -- HTML


@pytest.fixture(scope="module")
def model():
    return html_extract.trained()


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        (
            "<html><nav><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></nav><div class='ad'>Buy now, cheap.</div><article><h1>A  title</h1>"
            "<p><b>First &amp; best\n para.<br><p>Second<br>line &copy; 2020.</p><script>var a='</p>';</script></article><footer>&copy; me</footer>",
            "A title\nFirst & best para.\nSecond line © 2020.",
        ),
        (
            "<body><div id=sidebar><p>Read this related story now.</p></div><main><p>The text itself is here, and it is long enough.</p><form><p>Your mail?</p></form>"
            "<p>More of the text.</p></main><section class=comments><div class=comment><p>I like it very much.</p></div></section>",
            "The text itself is here, and it is long enough.\nMore of the text.",
        ),
    ],
)
def test_main_text(model, html, text):
    assert html_extract.main_text(html, model) == text


def test_marginals_are_exact(model):
    """Against the sum over all states of a small tree."""
    tree = html_extract.parse("<div class=menu><a>x</a></div><p>some text.<b>bold</b><ul><li>one")
    n, x = len(tree.tag), html_extract.features(tree)
    assert n <= 12
    own, total, sums = x @ model.weights, 0.0, np.zeros(n)
    for states in range(2**n):
        s = [states >> i & 1 for i in range(n)]
        weight = np.exp(sum(o for o, v in zip(own, s, strict=True) if v) + sum(model.pair[s[tree.parent[i]], s[i]] for i in range(1, n)))
        total += weight
        sums += weight * np.array(s)
    assert np.allclose(html_extract.marginals(tree, model), sums / total)


ARTICLE = (
    "<h1>A title of this</h1><p>The text itself is here, and it is long enough to matter for the reader.</p>"
    "<p>More of the text, with <a href=x>a link</a> inside.</p>"
)
ARTICLE_TEXT = "A title of this\nThe text itself is here, and it is long enough to matter for the reader.\nMore of the text, with a link inside."
NAV = "<nav><ul><li><a href=x>Home</a><li><a href=y>News</a><li><a href=z>About us</a></ul></nav>"
FOOT = "<footer><p>&copy; 2020 Me, all rights. Contact us.</p></footer>"
COMMENT = "<div class='comment'><p>I like this very much, thank you for it.</p></div>"
SIDE = "<div id='sidebar'><h3>Related</h3><ul><li><a href=1>Another story that is long</a><li><a href=2>One more</a></ul><p>Subscribe to our letter.</p></div>"
#: Layouts that the generator of training pages doesn't have.
LAYOUTS = {
    "head not closed": "<!DOCTYPE html><html><head><title>T</title><meta charset=utf-8><body>{nav}<article>{a}</article>{foot}",
    "neither head nor body": "<title>T</title>{nav}<article>{a}</article>{foot}",
    "self-closing drawing": "<body><svg class='i'/>{nav}<article>{a}</article>{foot}",
    "drawing": "<body><svg><path d='M0'/><title>x</title></svg>{nav}<article>{a}</article>{foot}",
    "unclosed drawing": "<body><svg><path d='M0'/>{nav}<article>{a}</article>{foot}",
    "article with tags": "<body>{nav}<article class='post tags'>{a}</article>{foot}",
    "fixed header": "<body>{nav}<div class='page header-fixed'><div class='article'>{a}</div></div>{foot}",
    "blog": "<body class='home blog'><div id='page' class='hfeed site'><header id='masthead'><p><a href='/'>My Blog</a></p><div class='menu-main'><ul><li><a href=a>A</a>"
    "</ul></div></header><div id='content'><main id='main'><article id='post-1' class='post hentry tag-y'>{a}</article><section id=comments>{com}</section></main></div>"
    "{side}<footer class='site-footer'>Powered by a thing</footer></div>",
    "news": "<body>{nav}<div class='breadcrumb'><a href=1>Home</a> &gt; <a href=2>World</a></div><div class='row'><div class='col-8'><div class='story-body'>{a}</div>"
    "<div class='share'>Share this story</div></div><div class='col-4'>{side}</div></div><div class='footer'>Terms and privacy</div>",
    "table": "<body><table><tr><td class=menu><a href=1>Home</a><br><a href=2>News</a></td><td class=content>{a}</td></tr></table><div class=footer>Copyright me</div>",
    "one form around all": "<body><form id='aspnetForm'>{nav}<div class='content'>{a}</div>{foot}</form>",
    "more comments than text": "<body>{nav}<article>{a}</article><div class='comments'>{coms}</div>{foot}",
    "plain": "<html><head><title>x</title></head><body>{a}</body></html>",
    "list of comments": "<html><body>{nav}<article>{a}</article><ol class='commentlist'><li><p>I liked reading this very much, thank you.</p></li>"
    "<li><p>Nonsense, the author has no idea at all.</p></li></ol>{foot}",
    "list of comments alone": "<html><body><article>{a}</article><ol class='commentlist'><li><p>I liked reading this very much, thank you.</p></li>"
    "<li><p>Nonsense, the author has no idea at all.</p></li></ol></body></html>",
    "named comments in a list": "<body>{nav}<main><div class='entry'>{a}</div></main><div id='comments'><ul class='comment-list'>"
    "<li class='comment even' id='c-1'><div class='comment-body'><b>Ann</b><p>I liked reading this.</p><p>Thank you for it.</p></div></li></ul></div>{foot}",
    "table without names": "<html><body><table><tr><td><a href='/'>Home</a> <a href='/n'>News</a></td><td>{a}</td></tr></table></body></html>",
    "table of three cells": "<body><table width=100%><tr><td colspan=3><a href=/>Home</a> | <a href=/a>About us</a></td></tr><tr><td valign=top><a href=1>One</a><br>"
    "<a href=2>Two words</a><br><a href=3>Three</a></td><td>{a}</td><td><h3>More</h3><ul><li><a href=4>Some other story</a></li><li><a href=5>One more</a></li></ul></td></tr></table>{foot}",
}
#: What must stay whole: lists, tables and definitions of the article itself.
INSIDE = {
    "list": ("<ol><li>Take two eggs and some flour.</li><li>Stir it well.</li></ol>", "Take two eggs and some flour.\nStir it well."),
    "definitions": ("<dl><dt>Term</dt><dd>What the term means in this text.</dd></dl>", "Term\nWhat the term means in this text."),
    "table": ("<table><tr><td>Width</td><td>12 metres</td></tr><tr><td>Length</td><td>80 metres</td></tr></table>", "Width\n12 metres\nLength\n80 metres"),
}


@pytest.mark.parametrize("kind", INSIDE)
def test_parts_of_the_article_stay(model, kind):
    html, text = INSIDE[kind]
    page = f"<html><body>{NAV}<main>{ARTICLE}{html}</main><ol class='commentlist'><li><p>I liked reading this very much, thank you.</p></li></ol>{FOOT}</body></html>"
    assert html_extract.main_text(page, model) == f"{ARTICLE_TEXT}\n{text}"


@pytest.mark.parametrize("layout", LAYOUTS)
def test_other_layouts(model, layout):
    html = LAYOUTS[layout].format(nav=NAV, a=ARTICLE, foot=FOOT, com=COMMENT, coms=COMMENT * 60, side=SIDE)
    assert html_extract.main_text(html, model) == ARTICLE_TEXT


def test_messages_decide(model):
    """Without the potentials between parents and children most pages read differently."""
    alone = html_extract.Potentials(model.weights, model.pair * 0)
    html = [t.format(nav=NAV, a=ARTICLE, foot=FOOT, com=COMMENT, coms=COMMENT * 60, side=SIDE) for t in LAYOUTS.values()]
    assert sum(html_extract.main_text(h, alone) != ARTICLE_TEXT for h in html) > len(html) / 2


def test_text_by_brute_force(model):
    """Small pages, with marginals summed over the states of all nodes."""
    pages = [
        "<nav><a>Home</a></nav><article><p>Some text here.</article>", "<div class=ad>Buy</div><p>A longer text, which is here.</p><footer>x</footer>",
        "<ul><li><a>x</a><li><a>y</a></ul><main><h1>T</h1><p>One. Two.</main>", "<section class=comments><p>No.</p></section><p>Yes, and more of it.",
    ]
    for html in pages:
        tree = html_extract.parse(html)
        n, own = len(tree.tag), html_extract.features(tree) @ model.weights
        states = (np.arange(2**n)[:, None] >> np.arange(n)) & 1
        energy = states @ own + sum(model.pair[states[:, tree.parent[i]], states[:, i]] for i in range(1, n))
        weight = np.exp(energy - energy.max())
        content = weight @ states / weight.sum() >= 0.5
        want, run = [], ""
        for node, text in [*tree.texts, (0, "")]:
            block = node
            while tree.tag[block] not in html_extract.BLOCK and block:
                block = tree.parent[block]
            if text and content[block]:
                run += text
            elif not text:
                want, run = want + [run.strip()] * bool(run.strip()), ""
        assert html_extract.main_text(html, model) == "\n".join(want)


def test_fit_climbs_to_the_data():
    """Expected features and pair counts under the fitted model equal those of the labels, up to the ridge."""
    pages = [html_extract.labelled_page(i) for i in range(60)]
    fitted = html_extract.fit(pages, rounds=400, ridge=0.01)
    forest = html_extract._Forest([t for t, _ in pages])
    x, y = np.vstack([html_extract.features(t) for t, _ in pages]), np.concatenate([v for _, v in pages])
    marginal, counts = forest.expected(x @ fitted.weights, fitted.pair)
    single = np.concatenate([html_extract.marginals(t, fitted) for t, _ in pages])
    assert np.allclose(marginal, single, atol=1e-6) and counts.sum() == pytest.approx(len(y) - len(pages))
    assert np.abs(x.T @ (y - marginal)).max() < 0.02 * len(y)


def test_held_out_pages(model):
    right = total = 0
    for seed in range(50_000_000, 50_000_150):
        tree, label = html_extract.labelled_page(seed)
        texts = {node for node, text in tree.texts if text.strip() and tree.tag[node] not in html_extract.HIDDEN}
        guess = html_extract.marginals(tree, model) >= 0.5
        right += sum(guess[n] == label[n] for n in texts)
        total += len(texts)
    assert right / total > 0.97


def test_broken_and_deep_pages(model):
    rng = random.Random(6)
    parts = ["<![if !IE]>", "<!", "<!--", "-->", "<p>", "</p>", "<div class='a'", "<b>", "&#x110000;", "&#0;", "text ", "<script>", "<", ">", "<li>", "</ul>", "\0", "<![CDATA[ x ]]>", "<title>"]
    for _ in range(300):
        html_extract.main_text("".join(rng.choices(parts, k=30)), model)
    assert html_extract.main_text("<div>" * 20000 + "hello world." + "</div>" * 20000, model) in ("", "hello world.")


def test_extract_rows(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (1, "u", "<article><p>Some text here.</p></article>", "x"), (2, None, "", "x")], "page_id bigint, url string, html string, text string")
    got = sorted(tuple(r) for r in html_extract.extract(df).select("page_id", F.coalesce("url", F.lit("-")), "text", "n_chars").collect())
    assert got == [(1, "u", "", 0), (1, "u", "Some text here.", 15), (2, "-", "", 0)]
    assert html_extract.extract(df.limit(0)).count() == 0


# -- toxicity


@pytest.fixture(scope="module")
def spoken(spark):
    rng = random.Random(7)
    syllables = "an re ti on the er ou st en ha".split()
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    rows = []
    for i in range(800):
        words = [word() for _ in range(rng.randint(5, 120))]
        toxic = i % 5 == 0
        for _ in range(2 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(["blockhead", "nitwit", "zumka" + word()]))
        rows.append((i, " ".join(words) + ".", int(toxic)))
    rows += [(900, None, 0), (901, "", 0), (902, "x" * 100000, 0), (903, " ".join(word() for _ in range(20000)), 0)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t, _ in rows], "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id bigint, quality int, toxic int")
    return docs, labels, {i: y for i, _, y in rows}


def test_toxicity_held_out(spoken):
    docs, labels, truth = spoken
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == len(truth) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert all(r.held_out == (toxicity.fold_of(r.doc_id) == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 100 and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.98


def test_toxicity_of_disguised_words(spoken):
    docs, labels, _ = spoken
    model = toxicity.train(docs, labels, F.lit(True))
    scorer = toxicity.Scorer(model)
    bad = ["you nitwit", "you n-i-t-w-i-t", "n i t w i t !", "a blockkhead", "BLOCK.HEAD", "zumkaxyz"]
    assert all(model.probability(m) > 0.3 for m in scorer.margins(bad))
    assert all(model.probability(m) < 0.3 for m in scorer.margins(["", "a plain day", "block the head", "thererean"]))


def test_toxicity_of_inserted_characters(spoken):
    docs, labels, _ = spoken
    model = toxicity.train(docs, labels, F.lit(True))
    scorer = toxicity.Scorer(model)
    bad = ["you nixtwit", "you nixxtwit", "you nixxxtwit", "a blo??ckhead", "a bloxxxckhead", "block----head", "nit....wit"]
    assert [t for t, m in zip(bad, scorer.margins(bad), strict=True) if model.probability(m) < 0.3] == []


def test_scores_by_brute_force(spoken):
    """Margins from kernel values of all windows of all words, each by the definition of the kernel."""
    docs, labels, _ = spoken
    model = toxicity.train(docs, labels, F.lit(True))

    def kernel(s, t):
        from itertools import combinations

        found = defaultdict(float)
        for i in combinations(range(len(s)), 3):
            found[s[i[0]] + s[i[1]] + s[i[2]]] += toxicity.DECAY ** (i[-1] - i[0] + 1)
        return sum(found[t[j[0]] + t[j[1]] + t[j[2]]] * toxicity.DECAY ** (j[-1] - j[0] + 1) for j in combinations(range(len(t)), 3))

    def common(a, b):
        row = [0] * (len(b) + 1)
        for c in a:
            last = 0
            for j, d in enumerate(b, 1):
                last, row[j] = row[j], max(row[j], row[j - 1], last + (c == d))
        return row[-1]

    def value(word, mark):
        n, best = len(mark), 0.0
        for size in range(n - 1, n + min(4, n - 3) + 1):
            for i in range(len(word) - size + 1):
                x = word[i : i + size]
                if x[0] not in mark[:2] or x[-1] not in mark[-2:] or common(x, mark) < max(3, -(-7 * n // 10)):
                    continue
                own, both = kernel(mark, mark), kernel(mark, x)
                likeness = both / (own * kernel(x, x)) ** 0.5
                best = max(best, 1.0 if x == mark else min(both / own, 0.9) if common(x, mark) == n else likeness if likeness >= 0.7 else 0.0)
        return best

    texts = ["you nitwit", "such a blockhed. a nitwit!", "nixxtwit or zumka", "the day is here", "zumkathe blocckhead", "erthonti stanen", "ntwit"]
    for text, got in zip(texts, toxicity.Scorer(model).margins(texts), strict=True):
        margins = [model.bias]
        for sentence in toxicity._SENTENCE.split(text):
            best = [max([0.0, *(value(w, mark) for w in toxicity.words_of(sentence))]) for mark in model.landmarks]
            margins.append(model.bias + float(np.dot(model.weights, best)))
        assert got == pytest.approx(max(margins), abs=1e-9), text


def test_toxicity_without_labels_or_rows(spoken):
    docs, labels, _ = spoken
    none = toxicity.toxicity(docs, labels.limit(0)).select("score").distinct().collect()
    assert len(none) == 1 and none[0].score < 1e-6
    one = toxicity.toxicity(docs, labels.where("toxic = 1")).select("score").distinct().collect()
    assert len(one) == 1 and one[0].score > 0.99
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_toxicity_of_null_and_repeated_ids(spoken):
    docs, labels, _ = spoken
    spark = docs.sparkSession
    odd = spark.createDataFrame([(None, "you nitwit"), (None, None), (5, "you nitwit"), (5, "a plain day"), (5, "you nitwit")], "doc_id bigint, text string")
    both = docs.select("doc_id", "text").union(odd)
    twice = labels.union(spark.createDataFrame([(5, 1, None), (None, 1, 1), (5, 0, 0)], "doc_id bigint, quality int, toxic int"))
    rows = toxicity.toxicity(both, twice).collect()
    got = sorted((str(r.doc_id), r.held_out, r.predicted) for r in rows if r.doc_id is None)
    assert len(rows) == both.count() and got == [("None", False, 0), ("None", False, 1)]
    fold = toxicity.fold_of(5) == 2
    assert sorted((r.held_out, r.predicted) for r in rows if r.doc_id == 5)[-2:] == [(fold, 1), (fold, 1)]


def test_kernel_by_definition():
    def slow(s, t):
        from itertools import combinations

        total = 0.0
        for i in combinations(range(len(s)), 3):
            for j in combinations(range(len(t)), 3):
                if all(s[a] == t[b] for a, b in zip(i, j, strict=True)):
                    total += toxicity.DECAY ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
        return total

    pairs = [("idiot", "idiiot"), ("abcabc", "cabab"), ("xyz", "abc"), ("aaaa", "aaa")]
    got = toxicity.kernel(toxicity._codes([a for a, _ in pairs]), toxicity._codes([b for _, b in pairs]))
    assert np.allclose(got, [slow(a, b) for a, b in pairs])


def test_common_subsequences():
    marks = toxicity.Landmarks(["idiot", "blockhead", "moron", "pathetic", "aaaa"])

    def slow(a, b):
        row = [0] * (len(b) + 1)
        for c in a:
            last = 0
            for j, d in enumerate(b, 1):
                last, row[j] = row[j], max(row[j], row[j - 1], last + (c == d))
        return row[-1]

    words = ["idiot", "xidxiot", "headblock", "aabaa", "zzz", "patheticmoron"]
    assert marks.common(toxicity._codes(words)).tolist() == [[slow(w, m) for m in marks.strings] for w in words]


# -- the Jaccard join


def brute_classes(rows):
    def shingles(t):
        w = (t or "").split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    texts = defaultdict(list)
    for i, t in rows:
        texts[t or ""].append(i)
    keys = list(texts)
    sets, parent, links = [shingles(t) for t in keys], list(range(len(keys))), [0] * len(keys)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if (a == b) or (a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    members = defaultdict(list)
    for i, t in enumerate(keys):
        members[root(i)] += texts[t]
    return {d: (min(members[root(i)]), len(members[root(i)]), links[i]) for i, t in enumerate(keys) for d in texts[t]}


def near_texts(rng, groups, size, words=80):
    vocabulary = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(3000)]
    passage = rng.choices(vocabulary, k=12)
    out = []
    for _ in range(groups):
        base = rng.choices(vocabulary, k=rng.randint(5, words))
        base[2:2] = passage
        for _ in range(rng.randint(1, size)):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            out.append(" ".join(own))
    return out


@pytest.mark.parametrize("small", [64, 4])
def test_jaccard_classes(spark, monkeypatch, small):
    monkeypatch.setattr(jaccard_join, "SMALL_BUCKET", small)
    monkeypatch.setattr(jaccard_join, "SKETCH_BLOCK", 16)
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    rng = random.Random(8)
    texts = near_texts(rng, 60, 5) + near_texts(rng, 4, 40, 600) + [None, "", " \n ", "one", "one", "two words", "two  words", "w " * 20000, "w " * 20001]
    rows = [*enumerate(texts), (3, texts[3])]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id bigint, text string, n_links string")
    want = brute_classes(rows)
    got = [(r.doc_id, (r.class_id, r.class_size, r.n_links)) for r in jaccard_join.similarity_classes(df).collect()]
    assert len(got) == len(rows)
    wrong = [(d, v, want[d]) for d, v in got if v != want[d]]
    assert not wrong and max(v[2] for v in want.values()) > 10


def test_large_groups_of_close_copies(spark, monkeypatch):
    """Groups with a core that is not compared, sets around it, and another core that chains to it."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    rng = random.Random(18)
    vocabulary = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(3000)]
    texts, compared = [], []
    for spread in (2, 6, 12):
        base = rng.choices(vocabulary, k=400)
        for _ in range(60):
            own = list(base)
            for _ in range(rng.randint(0, spread)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append(" ".join(own))
        second = list(base)
        second[100:122] = rng.choices(vocabulary, k=22)
        for _ in range(40):
            own = list(second)
            own[rng.randrange(400)] = rng.choice(vocabulary)
            texts.append(" ".join(own))
    plain = jaccard_join._compare_blocks
    monkeypatch.setattr(jaccard_join, "_compare_blocks", lambda rows: compared.append(rows.count()) or plain(rows))
    rows = list(enumerate(texts))
    want = brute_classes(rows)
    got = {r.doc_id: (r.class_id, r.class_size, r.n_links) for r in jaccard_join.similarity_classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == want and len({v[2] for v in want.values()}) > 5
    assert compared[0] < 3 * 100 * -(-100 // 16)
    close = spark.createDataFrame(rows[:60], "doc_id bigint, text string")
    assert {(r.class_id, r.class_size) for r in jaccard_join.similarity_classes(close).collect()} == {(0, 60)} and compared[1] < 60


def test_jaccard_on_nothing(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert jaccard_join.similarity_classes(empty).count() == 0
    lone = spark.createDataFrame([(1, "a b c d e f")], "doc_id bigint, text string")
    assert tuple(jaccard_join.similarity_classes(lone).first()) == (1, 1, 1, 0, True)


def test_jaccard_on_null_and_repeated_ids(spark):
    rng = random.Random(15)
    text = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    base, other, third = text(60), text(60), text(60)
    near = base.rsplit(" ", 1)[0] + " end"
    rows = [(None, base), (None, near), (7, other), (7, third), (8, third), (7, third), (9, base), (None, text(40)), (None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((str(r.doc_id), str(r.class_id), r.class_size, r.n_links, r.is_first) for r in jaccard_join.similarity_classes(df).collect())
    want = [
        ("7", "7", 1, 0, True), ("7", "7", 3, 0, True), ("7", "7", 3, 0, True), ("8", "7", 3, 0, False), ("9", "9", 3, 1, True),
        ("None", "9", 3, 1, False), ("None", "9", 3, 1, False), ("None", "None", 1, 0, True), ("None", "None", 1, 0, True),
    ]
    assert got == sorted(want)


def test_runs_reach_recall():
    assert jaccard_join.runs_for(0.999, 1) == 7 and jaccard_join.runs_for(0.999, 3) == 15


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (200, 100), (None, 5)]
    got = {r.node: r.label for r in components.connected_components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 100}
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
