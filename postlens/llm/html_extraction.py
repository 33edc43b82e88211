"""Main text of web pages as the best-scoring stretch of blocks."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import slices
from postlens.llm.html_pages import BOILERPLATE, INLINE, NEVER_BY_NAME, Walk, words_of_name

# Words that class names, ids and roles use for what is not the article.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adsbygoogle sponsor sponsored promo "
    "promotion banner cookie cookies consent gdpr notice notification alert disclaimer newsletter "
    "subscribe subscription signup login popup modal overlay sidebar aside complementary menu nav "
    "navbar navigation breadcrumb breadcrumbs pager pagination toolbar footer foot contentinfo "
    "masthead topbar comment comments commentlist disqus reply replies respond discussion related "
    "recommended share sharing social widget search searchbox form skip".split()
)
#: Only outside of articles: an article's own header holds its title.
OUTER_HINTS = frozenset({"header"})
TITLED = frozenset("article post entry story".split())
NOT_A_HINT_AFTER = frozenset("has with no is non without".split())
KEEPS = frozenset(
    "content article post entry story main text body article-body post-body entry-body "
    "article-content post-content entry-content main-content story-body page-content".split()
)
#: A learned name marks an element if it stands this many times oftener outside of articles.
NAME_ODDS = 9
MIN_PAGES = 20
#: Bound of the learned names that are kept, the most frequent ones.
MAX_NAMES = 5_000
LEAST_COST, MOST_COST = 0.1, 5.0
WORD_SCORE = 1.0
_COUNTS = "kind string, name string, inside long, outside long, pages long"
_FLUSH = 50_000


@dataclass(frozen=True)
class Weights:
    """Cost of each tag, score of a word in a link, and learned names of other matter."""

    tags: dict[str, float]
    link_word: float
    names: frozenset[str]

    def cost(self, tag: str) -> float:
        return self.tags.get(tag, LEAST_COST)


UNTRAINED = Weights({}, -WORD_SCORE, frozenset())


def boilerplate(learned: frozenset[str]) -> Callable[[str, list[str], bool], bool]:
    """Which elements are skipped: by tag, by hint in a name, or by a learned name."""

    def by_name(name: str, within: bool) -> bool:
        words = words_of_name(name)
        if not words or words[0] in NOT_A_HINT_AFTER:
            return False
        outer = not within and words[0] not in TITLED
        hints = HINTS | OUTER_HINTS if outer else HINTS
        return words[0] in hints or words[-1] in hints

    def skipped(tag: str, names: list[str], within: bool) -> bool:
        if tag in BOILERPLATE or (tag == "header" and not within):
            return True
        if not names or tag in NEVER_BY_NAME:
            return False
        lower = [n.lower() for n in names]
        if any(n in KEEPS for n in lower):
            return False
        return any(n in learned or by_name(raw, within) for n, raw in zip(lower, names, strict=True))

    return skipped


def _counted(page: str, add: Callable[[str, str, bool, int], None]) -> None:
    """Tags and words of a labelled page, inside and outside of its article.

    A page is labelled if it has one article element; what that holds is inside, but for
    skipped elements, and so are the elements around it. The article's own tag says what is
    to be learned and is no input.
    """
    walk = Walk(boilerplate(frozenset()))
    tokens = list(walk.tokens(page))
    if walk.articles != 1:
        return
    around: set[int] = set()
    for token in tokens:
        outer = token.element if token.element.article else None
        while outer is not None and id(outer) not in around:
            around.add(id(outer))
            outer = outer.outer
    for token in tokens:
        element = token.element
        inside = bool(element.article) and not element.skipped
        if token.name is None:
            if token.in_link and token.text.strip():
                add("link", "", inside, len(token.text.split()))
            continue
        inside = inside or id(element) in around
        if token.name != "article":
            add("tag", token.name, inside, 1)
        if token.opens:
            for name in {n.lower() for n in element.names}:
                add("name", name, inside, 1)


def _page_counts(batches) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple[str, str], list[int]] = defaultdict(lambda: [0, 0, 0])

    def flushed() -> pa.RecordBatch:
        rows = [(*key, *value) for key, value in counts.items()]
        counts.clear()
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in range(5)]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            ["kind", "name", "inside", "outside", "pages"],
        )

    for batch in slices(batches):
        for page in batch.column("html").to_pylist():
            seen: set[tuple[str, str]] = set()

            def add(kind: str, name: str, inside: bool, n: int, seen=seen) -> None:
                own = counts[kind, name]
                own[0 if inside else 1] += n
                if (kind, name) not in seen:
                    seen.add((kind, name))
                    own[2] += 1

            _counted(page or "", add)
        if len(counts) > _FLUSH:
            yield flushed()
    yield flushed()


def train(
    pages: DataFrame, html_col: str = "html", max_names: int = MAX_NAMES, min_pages: int = MIN_PAGES
) -> Weights:
    """Weights from all labelled pages of a table, counted by its tasks.

    A page is labelled by having one article element. The cost of a tag is the logarithm of
    how much oftener it stands outside of articles than inside, between ``LEAST_COST`` and
    ``MOST_COST`` words. Of the tags and the names of at least ``min_pages`` pages the
    ``max_names`` most frequent ones are kept. No labelled page gives costs of ``LEAST_COST``.
    """
    counted = pages.select(F.col(html_col).alias("html")).mapInArrow(_page_counts, _COUNTS)
    sums = [F.sum(c).alias(c) for c in ("inside", "outside", "pages")]
    counted = counted.groupBy("kind", "name").agg(*sums)
    counted = counted.where(F.col("pages") >= min_pages)
    most = counted.orderBy(F.desc("pages"), "kind", "name").limit(max_names).collect()
    tags, names, link = {}, set(), -WORD_SCORE
    for row in most:
        odds = math.log((row["outside"] + 1) / (row["inside"] + 1))
        if row["kind"] == "tag":
            tags[row["name"]] = min(MOST_COST, max(LEAST_COST, odds))
        elif row["kind"] == "link":
            link = min(WORD_SCORE, max(-WORD_SCORE, -odds))
        elif odds > math.log(NAME_ODDS):
            names.add(row["name"])
    return Weights(tags, link, frozenset(names))


@dataclass
class Block:
    """Text without a line break in it, its score, and what the tags before it cost."""

    text: str
    score: float
    before: float
    article: int
    main: bool


def blocks(page: str, weights: Weights) -> list[Block]:
    """The blocks of a page that no skipped element holds, in page order.

    Skipping an element costs as much as its tag, however much it holds.
    """
    out: list[Block] = []
    parts: list[str] = []
    score = before = 0.0
    linked = 0
    article, main = 0, False

    def end_block() -> None:
        nonlocal score, before, linked
        words = "".join(parts).split()
        if words:
            own = (len(words) - min(linked, len(words))) * WORD_SCORE
            own += min(linked, len(words)) * weights.link_word
            out.append(Block(" ".join(words), own - score, before, article, main))
            before = 0.0
        else:
            before += score
        parts.clear()
        score, linked = 0.0, 0

    skipping = False
    for token in Walk(boilerplate(weights.names)).tokens(page):
        element = token.element
        if element.skipped:
            if not skipping:
                if element.name not in INLINE:
                    end_block()
                before += weights.cost(element.name)
            skipping = True
            continue
        skipping = False
        if token.name is None:
            if not parts:
                article, main = element.article, element.main
            parts.append(token.text)
            linked += len(token.text.split()) if token.in_link else 0
        elif token.name in INLINE:
            score += weights.cost(token.name)
        else:
            end_block()
            before += weights.cost(token.name)
    end_block()
    return out


def best_stretch(scores: list[float]) -> tuple[int, int, float]:
    """First contiguous stretch ``[begin, end)`` with the largest sum, by one scan.

    Empty, with a sum of 0, if nothing is above 0.
    """
    best = (0, 0, 0.0)
    begin, total = 0, 0.0
    for i, score in enumerate(scores):
        if total <= 0:
            begin, total = i, 0.0
        total += score
        if total > best[2]:
            best = (begin, i + 1, total)
    return best


def main_text(page: str, weights: Weights) -> str:
    """The main text: the best stretch of blocks of one article, else of main, else of the page.

    A stretch does not reach from one article into another. Blocks are joined by one blank.
    """
    found = blocks(page, weights)
    numbers = {b.article for b in found if b.article}
    if numbers:
        groups = [[b for b in found if b.article == n] for n in sorted(numbers)]
    else:
        within = [b for b in found if b.main]
        groups = [within or found]
    best: tuple[float, list[Block]] = (0.0, [])
    for group in groups:
        begin, end, total = _best_blocks(group)
        if total > best[0]:
            best = (total, group[begin:end])
    return " ".join(b.text for b in best[1])


def _best_blocks(group: list[Block]) -> tuple[int, int, float]:
    scores = [s for b in group for s in (-b.before, b.score)]
    begin, end, total = best_stretch(scores)
    return begin // 2, end // 2, total


def extract(pages: DataFrame, weights: Weights, html_col: str = "html") -> DataFrame:
    """All columns of ``pages`` and ``main_text``, never null.

    White space, no-break spaces included, is one blank; character references are decoded. A
    null or empty page, and one without any word that scores, has an empty text. Every page
    is read whole and on its own, so repeated rows and ids do not matter; an empty table
    gives no rows. A column that is named ``main_text`` already is replaced. No shuffle.
    """
    kept = pages.drop("main_text")
    source = kept.withColumn("main_text", F.col(html_col).cast("string"))
    position = len(kept.columns)

    def extracted(batches):
        for batch in slices(batches):
            texts = [main_text(p or "", weights) for p in batch.column(position).to_pylist()]
            yield batch.set_column(position, batch.schema.field(position), pa.array(texts, pa.string()))

    return source.mapInArrow(extracted, source.schema)
