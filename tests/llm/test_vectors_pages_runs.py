"""Whitening, HTML extraction and periodic runs against plain versions and awkward inputs."""

import hashlib
import html
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlens.llm import html_extraction, periodic_runs, whitening
from postlens.llm.queries import QUERIES
from postlens.llm.recompression import Grammar

VECTORS = "vec_id long, embedding array<float>, label int, id string, x int, n int, whitened int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "a", 2, 3, 4) for i, v in rows], VECTORS)


def symmetric(values, seed=0):
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.normal(size=(len(values), len(values))))[0].astype(np.longdouble)
    for _ in range(3):
        q = q @ (3 * np.eye(len(values)) - q.T @ q) / 2
    a = (q * np.array(values, np.longdouble)) @ q.T
    return (a + a.T) / 2, q


@pytest.mark.parametrize(
    "values",
    [
        np.linspace(1400, 700, 64),
        [1000, 1000 - 1e-6, 1000 - 3e-6, 999.9, *np.linspace(900, 1, 40)],
        [5, 3] + [0] * 20,
        [7] * 5 + [1, 0.5],
        10.0 ** -np.arange(14),
        [3.0],
    ],
)
def test_eigenvectors_keep_their_precision_where_eigenvalues_cluster(values):
    matrix, _ = symmetric(values)
    found, v = whitening.refined_eigenvectors(matrix)
    assert np.abs(v.T @ v - np.eye(len(values))).max() < 1e-14
    assert np.abs(matrix @ v - v * found).max() < 1e-15 * max(values)
    assert np.allclose(found, sorted(values, reverse=True), rtol=1e-12, atol=1e-14)


def test_close_eigenvectors_are_told_apart_better_than_in_double_precision():
    values = [1000, 1000 - 1e-6, 1000 - 3e-6, 999.9, *np.linspace(900, 1, 40)]
    matrix, q = symmetric(values)
    for found, most in (
        (whitening.refined_eigenvectors(matrix)[1], 1e-10),
        (np.linalg.eigh(matrix.astype(float))[1][:, ::-1], 1e-5),
    ):
        off = max(min(np.abs(found[:, i] - s * q[:, i]).max() for s in (1, -1)) for i in range(3))
        assert off < most


def plain_whitening(rows):
    x = np.floor(256 * np.array(rows, np.float32).astype(float))
    fit = np.unique(x, axis=0)
    n, mean = len(fit), fit.mean(axis=0)
    spread = (fit - mean).T @ (fit - mean) / n
    values, v = np.linalg.eigh(spread)
    values, v = values[::-1][:4], v[:, ::-1][:, :4]
    deviation = ((n * x - fit.sum(axis=0)) ** 2).sum(axis=1)
    return n, deviation, (x - mean) @ v / np.sqrt(values), values / np.trace(spread)


def test_whitening_of_awkward_vectors(spark):
    rng = np.random.default_rng(3)
    good = rng.normal(size=(40, 6)).tolist()
    good += [good[0]] * 30
    bad = [None, [], [None] + [1.0] * 5, [float("nan")] * 6, [float("inf")] * 6, [1.0] * 5]
    rows = list(enumerate(good)) + [(None, good[1]), (3, good[2])]
    rows += [(100 + i, v) for i, v in enumerate(bad)]
    got = whitening.whiten(vectors(spark, rows).repartition(5)).collect()
    assert len(got) == 72
    used = [v for _, v in rows[:72]]
    n, deviation, white, explained = plain_whitening(used)
    by_deviation = {}
    for d, w in zip(deviation, white, strict=True):
        by_deviation[int(d)] = w
    mine = np.array([r["whitened"] for r in got])
    plain = np.array([by_deviation[r["deviation"]] for r in got])
    signs = np.sign((mine * plain).sum(axis=0))
    assert np.abs(mine * signs - plain).max() < 1e-12
    assert {r["n"] for r in got} == {n} and got[0]["identity_error"] < 1e-12
    assert np.abs(np.array(got[0]["explained"]) - explained).max() < 1e-14
    assert sorted(r["deviation"] for r in got) == sorted(int(d) for d in deviation)


def test_whitening_without_variance_and_without_rows(spark):
    same = whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r["whitened"], r["explained"], r["deviation"]) for r in same] == [
        ([None, None], [0.0, 0.0], 0)
    ] * 2
    line = whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 4.0])])).collect()
    assert sorted(r["whitened"][0] for r in line) == [-1.0, 1.0]
    assert all(r["whitened"][1] is None for r in line)
    huge = whitening.whiten(vectors(spark, [(1, [1e30, 2.0]), (2, [-1e30, 4.0])])).collect()
    assert [r["deviation"] for r in huge] == [None, None]
    none = whitening.whiten(vectors(spark, []))
    assert none.count() == 0 and "whitened" in none.columns


def test_whitening_query(spark, data_dir):
    rows = QUERIES["op11_embedding_whitening"](spark, data_dir).collect()
    table = spark.read.parquet(f"{data_dir}/embeddings.parquet").orderBy("vec_id").collect()
    n, deviation, white, _ = plain_whitening([r["embedding"] for r in table])
    assert len(rows) == 4 * len(table)
    mine = {(r["vec_id"], r["component"]): r for r in rows}
    for k in range(4):
        own = np.array([mine[r["vec_id"], k + 1]["whitened"] for r in table])
        assert min(np.abs(own - s * white[:, k]).max() for s in (1, -1)) < 1e-10
    assert [mine[r["vec_id"], 1]["deviation"] for r in table] == [int(d) for d in deviation]


PAGES = "page_id long, url string, html string, main_text string, id int, text string"
LAYOUTS = [
    ("", ""),
    (None, ""),
    ("plain words here", "plain words here"),
    ("a < b and 1<2 &amp; c &lt;p>", "a < b and 1<2 & c <p>"),
    ("<p>ab<b>cd</b> e&nbsp;\n f</p><p>x&#65;&copy;y</p>", "abcd e f xA©y"),
    (
        '<html><head><title>T T</title><script>var t="</p>";</script></head><body><nav><a href=x>'
        'Home</a></nav><div class="ad">Buy now</div><article><h1>Head</h1><p><b>One two.<br><p>Three'
        ' four</p><aside>side</aside><div class="ad-slot">ad ad</div><form>f <input> g</form>'
        "<p>five</p></article><footer>foot &copy;</footer>",
        "Head One two. Three four five",
    ),
    (
        '<body><div class="wrap"><div id="content"><h1>Head line</h1><p>One two three four</p>'
        '<p>a b c d e</p></div><div class="sidebar"><p>s s s s s s s s</p></div></div>'
        '<section id="comments"><article class="comment"><p>c c c c c</p></article></section>',
        "Head line One two three four a b c d e",
    ),
    ("<p title=\"a > b\">x</p><p title='it's>y z", "x y z"),
    ("<article><p>one two</p><!-- c > <p> --><p>four</p", "one two four"),
    ("<table><tr><td>a b<td>c d<tr><td>e</table>", "a b c d e"),
    ("<article><header><h1>Title</h1></header><p>x y</p><footer>by</footer></article>", "Title x y"),
    ("<header><h1>Site</h1></header><p>x y</p>", "x y"),
    ("<script>unclosed <p>x</p>", ""),
    ("<p>x</p><style>p{}</STYLE ><p>y", "x y"),
    ("<main><p>in main</p></main><p>out of main long long</p>", "in main"),
    ("<form id=f><article>all of it</article></form>", "all of it"),
    (
        "<p>One two three. <a href=x>link</a> and more.</p><p><a>l</a> <a>m</a></p>",
        "One two three. link and more.",
    ),
    ('<article><p>long text of it</p><div role="alert">stop</div></article>', "long text of it"),
    ('<article class="teaser has-sidebar">kept words</article>', "kept words"),
]


def test_layouts_of_pages(spark):
    rows = [(i, "u", page, "old", 1, "t") for i, (page, _) in enumerate(LAYOUTS)]
    pages = spark.createDataFrame(rows * 2, PAGES).repartition(3)
    got = html_extraction.extract(pages, html_extraction.UNTRAINED).collect()
    assert len(got) == 2 * len(LAYOUTS)
    for r in got:
        assert r["main_text"] == LAYOUTS[r["page_id"]][1], r["html"]
        assert (r["url"], r["id"], r["text"]) == ("u", 1, "t")


def test_pages_of_repeated_marks_take_linear_time():
    for page in ("<" * 10**5, "<b>" * 10**5, '<a "' * 10**5, "<a ='" * 10**5, "<li>x" * 10**5):
        html_extraction.main_text(page, html_extraction.UNTRAINED)


def test_best_stretch_against_all_stretches():
    rng = random.Random(5)
    for _ in range(300):
        scores = [rng.choice([-3, -1, -0.5, 0, 1, 2]) for _ in range(rng.randint(0, 12))]
        sums = [sum(scores[i:j]) for i in range(len(scores)) for j in range(i, len(scores) + 1)]
        begin, end, total = html_extraction.best_stretch(scores)
        assert total == max([0, *sums]) == sum(scores[begin:end])


def test_weights_come_from_labelled_pages(spark):
    page = (
        '<div class="shell"><div class="zork">junk words</div><article><p>a</p><h2>b</h2></article>'
        '<ul><li><a href="x">l</a></li></ul></div>'
    )
    unlabelled = "<section class='shell'><ul>x</ul></section>"
    rows = [(i, "u", p, "", 1, "") for i, p in enumerate([page] * 30 + [unlabelled] * 90 + [None])]
    pages = spark.createDataFrame(rows, PAGES)
    weights = html_extraction.train(pages)
    assert weights.names == {"zork"} and "section" not in weights.tags
    assert weights.cost("li") > 3 > weights.cost("p") == html_extraction.LEAST_COST
    assert weights.link_word < 0
    hidden = page.replace("article>", "section>")
    assert html_extraction.main_text(hidden, weights) == "a b"
    assert "junk" in html_extraction.main_text(hidden, html_extraction.UNTRAINED)
    assert html_extraction.train(pages.limit(0)) == html_extraction.UNTRAINED
    assert html_extraction.extract(pages.limit(0), weights).count() == 0


def test_extraction_query(spark, data_dir):
    got = {r["page_id"]: r for r in QUERIES["op12_html_extraction"](spark, data_dir).collect()}
    pages = spark.read.parquet(f"{data_dir}/pages.parquet")
    weights = html_extraction.train(pages)
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        article = re.sub(r"</?(p|h1|br)>", " ", re.sub(r"</?b>", "", article))
        text = " ".join(html.unescape(article).split())
        assert (got[r["page_id"]]["text"], got[r["page_id"]]["n_chars"]) == (text, len(text))
        # the weights alone find the same without the element that the labels come from
        hidden = r["html"].replace("article>", "section>")
        assert html_extraction.main_text(hidden, weights) == text


def plain_runs(words):
    best = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(24, 3 * q):
                best.setdefault((start, i - start + q), q)
    return sorted(((s, n, q) for (s, n), q in best.items()), key=lambda r: (r[0], r[2]))


def plain_kept(words, runs):
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in dropped]


def test_extensions_against_word_by_word():
    rng = random.Random(1)

    def common(t, i, j):
        n = 0
        while i + n < len(t) and j + n < len(t) and t[i + n] == t[j + n]:
            n += 1
        return n

    for _ in range(150):
        n, k = rng.randint(1, 200), rng.choice([1, 2, 3, 5])
        t = [rng.randrange(k) for _ in range(n)]
        if rng.random() < 0.6:
            t = (t[: rng.randint(1, min(n, 9))] * n)[:n]
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(n)] = rng.randrange(k + 1)
        grammar = Grammar.build(np.array(t))
        one = np.array([rng.randint(0, n) for _ in range(50)])
        two = (one + np.array([rng.randint(1, n) for _ in range(50)])) % (n + 1)
        one, two = one[one != two], two[one != two]
        ask = list(zip(one.tolist(), two.tolist(), strict=True))
        assert grammar.extension(one, two).tolist() == [common(t, i, j) for i, j in ask]
        back = grammar.mirrored().extension(one, two).tolist()
        assert back == [common(t[::-1], i, j) for i, j in ask]


def test_runs_against_all_periods():
    rng = random.Random(2)
    for _ in range(120):
        texts = []
        for _ in range(rng.randint(1, 10)):
            n, k = rng.choice([0, 1, 23, 24, 30, 60, 100, 250]), rng.choice([1, 2, 3, 30])
            t = [rng.randrange(k) for _ in range(n)]
            for _ in range(rng.randint(0, 4) if n > 1 else 0):
                a = rng.randrange(n)
                p = rng.randint(1, max(1, min(n - a, rng.choice([2, 10, 60]))))
                for i in range(a, min(n, a + rng.randint(1, n))):
                    t[i] = t[a + (i - a) % p]
            texts.append([b"w%d" % x for x in t])
        for t, runs in zip(texts, periodic_runs.find_runs(texts), strict=True):
            assert [tuple(r) for r in runs.tolist()] == plain_runs(t)
            kept = periodic_runs.kept_words(len(t), runs)
            assert [w for w, k in zip(t, kept, strict=True) if k] == plain_kept(t, runs.tolist())


def test_long_runs_are_found_once(monkeypatch):
    monkeypatch.setattr(periodic_runs, "_GRID_CHUNK", 1 << 12)
    words = [b"a"] * 5_000 + [b"w%d" % (i % 700) for i in range(7_000)]
    assert [tuple(r) for r in periodic_runs.find_runs([words])[0].tolist()] == [
        (0, 5000, 1),
        (5000, 7000, 700),
    ]


def test_runs_of_awkward_rows(spark):
    texts = [None, "", " \n", "a " * 23, "a " * 24, "x " * 30_000 + "y", "Ä\tä " * 20, "z"]
    rows = [(i, t, 1, "c") for i, t in enumerate(texts)] + [(None, "a " * 24, 1, "c")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int, collapsed string")
    found = periodic_runs.periodic_runs(docs)
    found = found.withColumn("best", periodic_runs.strongest(F.col("runs")))
    got = found.collect()
    assert sorted(r["n_words"] for r in got) == [0, 0, 0, 1, 23, 24, 24, 24, 40, 30_001]
    by_id = {r["id"]: r for r in got if r["id"] is not None}
    assert by_id[4]["best"].asDict() == {"start": 0, "length": 24, "period": 1}
    assert (by_id[5]["collapsed"], by_id[6]["collapsed"]) == ("x y", "Ä ä")
    assert by_id[3]["best"] is None and by_id[0]["collapsed"] == ""
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


def test_runs_query(spark, data_dir):
    got = {r["doc_id"]: r for r in QUERIES["op13_periodic_runs"](spark, data_dir).collect()}
    sha = lambda s: hashlib.sha256(s).hexdigest()
    for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect():
        words = (r["text"] or "").encode().split()
        n, h = len(words), zlib.crc32(str(r["doc_id"]).encode())
        if n > 2_000:
            continue
        if h % 10 == 0 and n:
            a, g = h // 10 % n, h // 10
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs, own = plain_runs(words), got[r["doc_id"]]
        best = min(runs, key=lambda z: (-Fraction(z[1], z[2]), z[0], z[2]), default=(None,) * 3)
        assert (own["n_runs"], own["start"], own["length"], own["period"]) == (len(runs), *best)
        assert own["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        assert own["runs_sha256"] == sha(lines.encode())
        assert own["collapsed_sha256"] == sha(b" ".join(plain_kept(words, runs)))
