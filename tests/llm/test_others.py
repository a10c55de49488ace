"""Operators on vectors and pages, toxicity, and the pipeline."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelstat.llm import embedding_dedup, html_extract, toxicity
from panelstat.llm.components import components


# components


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(200, 200), (300, 301), (301, 300)]
    found = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    expected = {i: 0 for i in range(1, 41)} | {k: 100 for k in range(101, 140)} | {301: 300}
    assert found == expected


# op7

VECTORS = "vec_id long, embedding array<float>, label int"


def brute_links(given):
    good = {}
    for k, (_, v, label) in enumerate(given):
        if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good[k] = np.array(v, np.float32).astype(np.float64)
    linked, root = Counter(), list(range(len(given)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in good:
        for b in good:
            x, y = good[a], good[b]
            if a < b and given[a][2] == given[b][2] and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.93:
                linked[a] += 1
                linked[b] += 1
                root[find(b)] = find(a)
    smallest = {}
    for k, (i, _, _) in enumerate(given):
        if i is not None:
            smallest[find(k)] = min(i, smallest.get(find(k), i))
    out = Counter()
    for k, (i, _, _) in enumerate(given):
        c = smallest.get(find(k))
        out[(i, linked[k], c, i is not None and i == c)] += 1
    return out


def test_near_vectors_match_brute_force(spark):
    rng, given = np.random.default_rng(8), []
    for centre in rng.standard_normal((25, 64)):
        for spread in (0, 0.05, 0.2, 0.3, 0.38, 0.42):
            v = centre + spread * rng.standard_normal(64)
            given.append((len(given), v.tolist(), int(rng.integers(2))))
    given += [
        (None, given[0][1], given[0][2]), (500, given[0][1], given[0][2]), (500, given[0][1], given[0][2]), (501, given[0][1], None),
        (502, None, 1), (503, [], 1), (504, [0.0] * 64, 1), (505, [float("nan")] * 64, 1), (506, [None] * 64, 1),
        (507, [float("inf")] * 64, 1), (508, [1.0, 2.0], 1), (509, [2.0, 4.0], 1), (510, [3.0], 0), (511, [1e-30] * 64, 1), (512, [1e30] * 64, 1),
    ]
    frame = spark.createDataFrame(given, VECTORS)
    assert Counter(map(tuple, embedding_dedup.near_vectors(frame).collect())) == brute_links(given)
    assert embedding_dedup.near_vectors(frame.limit(0)).count() == 0


def test_large_buckets_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BUCKET_ROWS", 8)
    rng = np.random.default_rng(2)
    centre = rng.standard_normal(64)
    given = [(i, (centre + 0.3 * rng.standard_normal(64)).tolist(), 1) for i in range(60)]
    assert Counter(map(tuple, embedding_dedup.near_vectors(spark.createDataFrame(given, VECTORS)).collect())) == brute_links(given)


def test_decoding_finds_exactly_the_filters_beyond_the_cap():
    rng = np.random.default_rng(0)
    books = embedding_dedup.codebooks(64)
    for _ in range(5):
        u = rng.standard_normal(64)
        u /= np.linalg.norm(u)
        every = (books[0] @ u[:32])[:, None] + (books[1] @ u[32:])[None, :]
        expected = np.flatnonzero(every.ravel() / math.sqrt(2) >= 0.3)
        assert set(embedding_dedup.decode(u, 0.3)) == set(expected)


def test_filters_recall_close_pairs():
    rng, shared = np.random.default_rng(1), []
    for _ in range(300):
        u = rng.standard_normal(64)
        u /= np.linalg.norm(u)
        d = rng.standard_normal(64)
        d -= d @ u * u
        v = 0.93 * u + math.sqrt(1 - 0.93**2) * d / np.linalg.norm(d)
        shared.append(len(np.intersect1d(embedding_dedup.filters(u), embedding_dedup.filters(v))))
    assert min(shared) > 0


# op6

PAGE = """<!DOCTYPE html><html><head><title>No</title><script>var t="</p> five words that aren't text";</script></head><body>
<nav><ul><li><a href="/x">Menu one</a></li><li><a>Menu two</a></li></ul></nav><!-- <p>gone</p> --><div class="ad">Buy this now and save</div>
<article><h1>A  title &amp; more</h1><p><b>First   paragraph of the story.<br><p>Second &lt;one&gt; here, with <i>mark</i>up.
<div class="newsletter">Sign up now please</div><p>Third is last.<section class="comments"><p>A reader says things here</p></section></article>
<aside>Other stories of interest</aside><footer>&copy; All of us</footer></body></html>"""
TEXT = "A title & more\nFirst paragraph of the story.\nSecond <one> here, with markup.\nThird is last."


def test_main_text_of_pages(spark):
    pages = [(1, "u1", PAGE), (2, "u2", None), (3, "u3", ""), (4, None, "<p>"), (None, "u5", PAGE), (6, "u6", "<<<>>&#x0;&am"), (7, "u7", PAGE[:300])]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'clash' text", "1 n_chars")
    got = {r.url: (r.page_id, r.text, r.n_chars) for r in html_extract.main_text(frame).collect()}
    assert got["u1"] == (1, TEXT, len(TEXT)) and got["u5"] == (None, TEXT, len(TEXT))
    assert got["u2"] == (2, "", 0) and got["u3"] == (3, "", 0) and got[None] == (4, "", 0)
    assert html_extract.main_text(frame.limit(0)).count() == 0


def test_pages_without_labels_use_the_defaults():
    page = "<body><div><a>a</a><a>b</a><a>c</a></div><p>" + "word " * 40 + "</p><p>more words of it</p><div><a>d</a></div></body>"
    assert html_extract.extract(page, {}) == " ".join(["word"] * 40) + "\nmore words of it"


WORDS = "word " * 60
LONG = " ".join(["word"] * 60)
# page, main text: names of elements must not lose an article, nor keep what is none
NAMED = [
    (f'<div class="layout has-sidebar"><article><p>{WORDS}</article></div>', LONG),
    (f'<form id="aspnetForm"><nav><a>Menu</a></nav><article><p>{WORDS}</article></form>', LONG),
    (f'<form id="aspnetForm"><nav><a>Menu</a></nav><div class="c"><p>{WORDS}</div></form>', LONG),
    (f'<article><div class="article-header"><h1>My title here</h1></div><p>{WORDS}</article>', "My title here\n" + LONG),
    (f'<article><p>{WORDS}<section class="related-work"><p>Others did it so</section><p>last {WORDS}</article>', f"{LONG}\nOthers did it so\nlast {LONG}"),
    (f'<article><p>{WORDS}<div class="related"><ul><li><a>One story</a><li><a>Two</a></ul></div><p>last {WORDS}</article>', f"{LONG}\nlast {LONG}"),
    (f"<article><p>where <math><mi>x</mi> is</math> one {WORDS}</article>", f"where x is one {LONG}"),
    (f"<article><p data-x=don't>The dog's bone</p><p>{WORDS}</p></article>", f"The dog's bone\n{LONG}"),
    (f'<article><p title="a > b">First line</p><p>{WORDS}</p></article>', f"First line\n{LONG}"),
    (f'<main><div class="sidebar"><article>A card</article></div><p>{WORDS}</main>', LONG),
    (f'<article><p>{WORDS}</article><div id="comments"><article class="comment"><p>{WORDS * 3}</article></div>', LONG),
    (f'<div class="comments"><article><p>{WORDS * 3}</article></div><article><p>{WORDS}</article>', LONG),
    (f"<head><title>No</title><meta name=x><p>{WORDS}</p>", LONG),
    (f'<p>{WORDS}</p><p>cut off <a href="x', f"{LONG}\ncut off"),
]


@pytest.mark.parametrize(("page", "text"), NAMED)
def test_names_of_elements_lose_no_article(page, text):
    assert html_extract.extract(page, {}) == text
    assert html_extract.extract(f"<!DOCTYPE html><html><body>{page}", {}) == text


def test_best_run_is_the_best_of_all_runs():
    random.seed(5)
    for _ in range(300):
        scores = [random.choice([-2.0, -1.5, -0.5, 0.0, 0.5, 1.0, 3.0]) for _ in range(random.randint(0, 25))]
        runs = [(sum(scores[a:b]), -b, a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)]
        start, stop = html_extract.best_run(scores)
        best = max((r[0] for r in runs), default=0.0)
        assert sum(scores[start:stop]) == max(best, 0.0)
        if best > 0:
            assert stop == min(b for total, _, _, b in runs if total == best)


def test_very_long_pages_repeated_rows_and_learned_weights(spark):
    long = f"<nav>{'<a>menu</a>' * 500}</nav><article>{'<p>some words of it</p>' * 20_000}</article><footer>end</footer>"
    pages = [(k, f"u{k}", PAGE) for k in range(3)] + [(7, "long", long)] * 2 + [(8, "cut", "<a b='" + "c <d " * 20_000)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("kind", F.lit(1))
    got = html_extract.main_text(frame, max_pages=2).collect()
    assert [r.text for r in got if r.page_id in (0, 1, 2)] == [TEXT] * 3
    assert [r.text for r in got if r.page_id == 7] == ["\n".join(["some words of it"] * 20_000)] * 2
    assert [r.text for r in got if r.page_id == 8] == [""]
    weights = html_extract.learn(frame, max_pages=2)
    assert weights["w:p"] > 0 > weights["w:a"] and weights["t:nav"] < 0
    assert html_extract.learn(frame.limit(0)) == {}


def test_every_given_page_keeps_its_article(spark, sf):
    import html
    import re

    from panelstat.llm.queries import QUERIES

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in QUERIES["op6_html_extract"][0](spark, sf).collect():
        inside = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
        assert r.text == "\n".join(b for b in blocks if b)


# op9


def corpus(n=900):
    random.seed(11)
    common, bad = [f"word{i}" for i in range(300)], ["nasty", "vile", "rotten"]
    out, labels, where = [], [], {}
    for i in range(n):
        lines = [[random.choice(common) for _ in range(8)] for _ in range(random.randint(3, 12))]
        toxic = i % 5 == 0
        if toxic:
            k = random.randrange(len(lines))
            lines[k][3] = random.choice(bad)
            where[i] = k
        out.append((i, ". ".join(" ".join(x) for x in lines) + "."))
        labels.append((i, int(toxic)))
    return out, labels, where


def test_toxicity_learns_from_documents_and_locates_sentences(spark):
    texts, labels, where = corpus()
    rest = [(None, "word1 nasty word2."), (5_000, None), (5_001, ""), (5_002, "... !"), (0, texts[0][1])]
    frame = spark.createDataFrame(texts + rest, "doc_id long, text string").selectExpr("*", "'clash' toxic", "0.5 score")
    known = spark.createDataFrame([*labels, (7_000, None), (None, 1)], "doc_id long, toxic int")
    found = toxicity.score(frame, known).collect()
    assert len(found) == len(texts) + len(rest)
    held = [r for r in found if r.held_out and r.doc_id is not None and r.doc_id < 900]
    right = sum(r.predicted == int(r.doc_id % 5 == 0) for r in held)
    assert right / len(held) > 0.95
    body = dict(texts)
    located = 0
    for r in found:
        if r.predicted and r.doc_id in where and r.sentences:
            worst = max(r.sentences, key=lambda s: s.score)
            located += any(b in body[r.doc_id][worst.start : worst.stop] for b in ("nasty", "vile", "rotten"))
    assert located > 0.9 * len(where)
    by_id = {r.doc_id: r for r in found}
    assert by_id[5_000].score == by_id[5_001].score == by_id[5_002].score == 0.0
    kept = toxicity.reject(frame, known)
    assert kept.columns == frame.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in found if not r.predicted)


def test_toxicity_without_labels_or_documents(spark):
    frame = spark.createDataFrame([(1, "some text here.")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.score(frame, none).collect()] == [0.0]
    assert toxicity.score(frame.limit(0), none).count() == 0


# pipeline


def test_pipeline_stages_each_do_their_work(spark, sf):
    import corpus_pipeline
    from panelstat.session import checkpoint
    from tests.llm.test_documents import brute_components, fold

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(checkpoint(stage(spark, kept[-1], sf)))
    for frame in kept[1:4]:
        assert frame.columns == docs.columns
    clean, single, apart, packed = kept[1:]
    assert set(clean.collect()) <= set(docs.collect())
    last = {}
    for r in clean.collect():
        last[fold(r.text)] = max(r.doc_id, last.get(fold(r.text), -1))
    assert sorted(r.doc_id for r in single.collect()) == sorted(last.values())
    pairs = [(r.doc_id, r.text) for r in single.collect()]
    assert sorted(r.doc_id for r in apart.collect()) == sorted(i for i, n, c in brute_components(pairs) if i == c)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in apart.collect()}
    whole = defaultdict(int)
    for r in packed.collect():
        whole[r.doc_id] += r.length
    assert all(whole[r.doc_id] == r.doc_tokens for r in packed.collect())


def test_pipeline_runs_on_empty_documents(spark, sf, tmp_path):
    import corpus_pipeline

    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
