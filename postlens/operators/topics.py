"""Topic model for posts without a keyword tag, held as tables.

The vocabulary and the topic weights are written tables with a row per word. A fit deals the
posts into blocks and the words into slabs, both of bounded size. In each update a slab sends
each block the weights of its own words as one cell, the block infers its posts in one task and sends
one cell back to each slab. What the driver holds are ``k`` totals and priors.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postlens import columns as C
from postlens.functions import text as T
from postlens.functions.arrays import let, token_counts
from postlens.functions.special import digamma
from postlens.functions.token_table import ROW_ID, TokenTable, annotate_tokens, with_row_id
from postlens.operators.dirichlet import newton_step, newton_step_table
from postlens.operators.topic_inference import infer
from postlens.operators.vocabulary import number_words, vocabulary_counts
from postlens.sources.staging import stage, staging_path, unstage

__all__ = ["vocabulary_counts", "number_words"]

# Topic count and priors, and the most steps for one post.
TOPICS = 4
ALPHA = 0.5
BETA = 0.1
MAX_STEPS = 100
TOLERANCE = 1e-3
#: How fast older updates fade: update t counts as (1 + t) to this power.
DECAY = -0.51
TOP_WORDS = 3
#: Entries (a word of a post) of a block, which one task infers together; and how many blocks
#: there are at least, unless that makes blocks of under ``LEAST_ENTRIES``.
BLOCK_ENTRIES = 1 << 20
LEAST_BLOCKS = 64
LEAST_ENTRIES = 1 << 12
#: Words of a slab, and how few it may have for the sake of more slabs.
SLAB_WORDS = 1 << 14
LEAST_WORDS = 1 << 10
#: Weights within this size are handed to every task; larger ones are joined.
MAX_BROADCAST_BYTES = 64 << 20
#: Sums of weights are kept in units of this fraction, so that their order does not matter.
UNIT = 1 << 24
_PRIOR_SLAB = -1


@dataclass
class TopicModel:
    """``terms(index, token, tf)`` and ``weights(index, weights, prior)``, one row per word.

    ``weights`` holds the word's weight in each topic, ``prior`` the weight it starts from;
    ``totals`` are their sums per topic and ``alpha`` the prior of each topic in a post.
    """

    terms: DataFrame
    weights: DataFrame
    totals: tuple[float, ...]
    alpha: tuple[float, ...]

    @property
    def k(self) -> int:
        return len(self.totals)

    @cached_property
    def words(self) -> int:
        return self.terms.count()

    def save(self, path: str) -> None:
        spark = self.terms.sparkSession
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        self.weights.write.mode("overwrite").parquet(f"{path}/weights")
        numbers = [(i, *row) for i, row in enumerate(zip(self.totals, self.alpha, strict=True))]
        numbers = spark.createDataFrame(numbers, "topic int, total double, alpha double")
        numbers.coalesce(1).write.mode("overwrite").parquet(f"{path}/topics")

    @classmethod
    def load(cls, path: str) -> TopicModel:
        spark = SparkSession.active()
        numbers = spark.read.parquet(f"{path}/topics").orderBy("topic").collect()
        return cls(
            spark.read.parquet(f"{path}/terms"),
            spark.read.parquet(f"{path}/weights"),
            tuple(r["total"] for r in numbers),
            tuple(r["alpha"] for r in numbers),
        )

    def fits_in_memory(self, max_bytes: int) -> bool:
        """Whether words and weights are within the bound; measured, not estimated."""
        held = F.sum(F.octet_length("token") + F.lit(8 * (self.k + 8)))
        return (self.terms.agg(held).first()[0] or 0) <= max_bytes


def topic_eligible(text_col: str = C.LEMMATIZED_TEXT, more_than: int = 3) -> Column:
    """True for posts with more than three words and no keyword tag; never null."""
    enough = T.word_count(F.col(text_col)) > more_than
    return F.coalesce(enough & F.col(C.WEATHER_TOPICS).isNull(), F.lit(False))


def any_text(text_col: str = C.LEMMATIZED_TEXT) -> Column:
    """Eligibility of the alternative settings: any non-empty text, tagged or not."""
    return F.coalesce(F.col(text_col) != "", F.lit(False))


def bag_of_words(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """Long form of the term counts: ``id, token, n``. Counted inside each row."""
    C.require_columns(df, text_col, id_col)
    bag = token_counts(T.words(F.col(text_col)))
    return df.select(id_col, F.inline(bag))


# --- blocks of posts ----------------------------------------------------------------------


def _bags(df: DataFrame, id_col: str, text_col: str, eligible: Column) -> DataFrame:
    """``id, bag, block``: the eligible posts, dealt into blocks by a hash; a written table."""
    bags = df.where(eligible).select(
        F.col(id_col).alias("id"), token_counts(T.words(F.col(text_col))).alias("bag")
    )
    bags = stage(bags, "bags")
    entries = bags.agg(F.sum(F.size("bag"))).first()[0] or 0
    blocks = max(1 + entries // BLOCK_ENTRIES, min(LEAST_BLOCKS, 1 + entries // LEAST_ENTRIES))
    return bags.withColumn("block", F.pmod(F.xxhash64("id", "bag"), F.lit(blocks)).cast("int"))


def _block_words(bags: DataFrame, terms: DataFrame, slabs: int) -> DataFrame:
    """``block, token, index, slab``: the known words of each block; a written table.

    A word is at most once in a block, so a very frequent one is as many rows as there are blocks.
    """
    words = bags.select("block", F.explode(F.transform("bag", lambda b: b["token"])).alias("token"))
    known = terms.select("token", "index", _slab(slabs).alias("slab"))
    return stage(words.distinct().join(known, "token"), "block-words")


def _slabs(terms: DataFrame) -> int:
    """How many slabs the words are dealt to."""
    words = terms.count()
    return max(1 + words // SLAB_WORDS, min(LEAST_BLOCKS, 1 + words // LEAST_WORDS))


def _slab(slabs: int) -> Column:
    # in turn, so that each slab has its part of the frequent words, which most blocks ask for
    return F.pmod("index", F.lit(slabs)).cast("int")


def _cells(numbers: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Binary cells of so many numbers each."""
    ends = np.concatenate([[0], np.cumsum(sizes)]) * numbers.itemsize
    data = pa.py_buffer(np.ascontiguousarray(numbers))
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), data])


def _numbers(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of binary cells end to end, and how many each cell has."""
    cells = column.cast(pa.binary()).combine_chunks()
    if isinstance(cells, pa.ChunkedArray):
        cells = cells.chunk(0) if cells.num_chunks else pa.array([], pa.binary())
    if not len(cells):
        return np.empty(0, kind), np.empty(0, np.int64)
    ends = np.frombuffer(cells.buffers()[1], np.int32)[cells.offset : cells.offset + len(cells) + 1]
    data = cells.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.empty(0, np.uint8)
    return flat.view(kind), np.diff(ends).astype(np.int64) // np.dtype(kind).itemsize


_LINKS = "slab int, block int, index binary"


def _links(block_words: DataFrame) -> DataFrame:
    """``slab, block, index``: the words that a block has of a slab, by rising number; a written table."""

    def pack(words: pa.Table) -> pa.Table:
        index, slab = words.column("index").to_numpy(), words.column("slab").to_numpy()
        order = np.lexsort((index, slab))
        slabs, sizes = np.unique(slab, return_counts=True)
        block = np.full(len(slabs), words.column("block")[0].as_py(), np.int32)
        return pa.table({"slab": slabs, "block": block, "index": _cells(index[order], sizes)})

    words = block_words.select("block", "index", "slab")
    return stage(words.groupBy("block").applyInArrow(pack, _LINKS), "links")


_CODED = "block int, id {id}, words binary, counts binary"


def _coded(bags: DataFrame, block_words: DataFrame) -> DataFrame:
    """``block, id, words, counts``: the entries of each post, by rising number of their words.

    Words stand as their places among the block's words, which go by slab and number. Those that
    are not in the vocabulary are left out; the post stays. Dealt by block.
    """
    kind = bags.schema["id"].dataType.simpleString()

    def code(bag: pa.Table, words: pa.Table) -> pa.Table:
        lists = bag.column("bag").combine_chunks()
        flat = lists.flatten()
        at = pc.index_in(flat.field("token"), value_set=words.column("token").combine_chunks())
        known = at.is_valid().to_numpy(zero_copy_only=False)
        at = at.drop_null().to_numpy(zero_copy_only=False)
        index, slab = words.column("index").to_numpy(), words.column("slab").to_numpy()
        place = np.empty(len(index), np.int32)
        place[np.lexsort((index, slab))] = np.arange(len(index), dtype=np.int32)
        n = flat.field("n").to_numpy(zero_copy_only=False)[known]
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(sizes)), sizes)[known]
        order = np.lexsort((index[at], owner))
        sizes = np.bincount(owner, minlength=len(sizes))
        return pa.table(
            {
                "block": bag.column("block").cast(pa.int32()),
                "id": bag.column("id"),
                "words": _cells(place[at[order]], sizes),
                "counts": _cells(n[order].astype(np.int32), sizes),
            }
        )

    return (
        bags.select("block", "id", "bag")
        .groupBy("block")
        .cogroup(block_words.select("block", "token", "index", "slab").groupBy("block"))
        .applyInArrow(code, _CODED.format(id=kind))
    )


@dataclass(frozen=True)
class _State:
    """What a task needs besides the weights of its words."""

    totals: tuple[float, ...]
    alpha: tuple[float, ...]
    max_steps: int
    tolerance: float

    def beta(self, weights: np.ndarray) -> np.ndarray:
        return np.exp(digamma(weights) - digamma(np.array(self.totals)))


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    return pa.concat_arrays(column.chunks).flatten().to_numpy(zero_copy_only=False)


_SLABS = "slab int, index binary, weights binary"


def _packed(weights: DataFrame, slabs: int) -> DataFrame:
    """``weights(index, weights)`` as a row per slab: its words by rising number, and their weights."""

    def pack(rows: pa.Table) -> pa.Table:
        index = rows.column("index").to_numpy()
        order = np.argsort(index)
        held = _flat(rows.column("weights")).reshape(len(index), -1)[order]
        slab = pa.array([rows.column("slab")[0].as_py()], pa.int32())
        return pa.table(
            {"slab": slab, "index": _cells(index[order], [len(index)]), "weights": _cells(held, [held.size])}
        )

    rows = weights.select(_slab(slabs).alias("slab"), "index", "weights")
    return rows.groupBy("slab").applyInArrow(pack, _SLABS)


_SLICES = "block int, slab int, places binary, beta binary"


def _slices(slabs: DataFrame, links: DataFrame, state: _State) -> DataFrame:
    """What each slab sends to each block: where in the slab the words stand, and their ``beta``."""

    def send(slab: pa.Table, links: pa.Table) -> pa.Table:
        k = len(state.alpha)
        index, weights = (_numbers(slab.column(c), t)[0] for c, t in (("index", np.int64), ("weights", float)))
        beta = state.beta(weights.reshape(-1, k))
        wanted, sizes = _numbers(links.column("index"), np.int64)
        places = np.searchsorted(index, wanted).astype(np.int32)
        return pa.table(
            {
                "block": links.column("block"),
                "slab": links.column("slab"),
                "places": _cells(places, sizes),
                "beta": _cells(beta[places] if len(places) else beta[:0], sizes * k),
            }
        )

    slabs = slabs.select("slab", "index", "weights").groupBy("slab")
    return slabs.cogroup(links.groupBy("slab")).applyInArrow(send, _SLICES)


class _Block:
    """The posts of a block in a fixed order, and what is inferred of them."""

    def __init__(self, posts: pa.Table, slices: pa.Table, state: _State) -> None:
        self.ids = posts.column("id")
        self.word, self.sizes = _numbers(posts.column("words"), np.int32)
        self.counts = _numbers(posts.column("counts"), np.int32)[0].astype(float)
        self.slices = slices.take(pa.array(np.argsort(slices.column("slab").to_numpy())))
        self.k = len(state.alpha)
        self.beta, self.slabs = _numbers(self.slices.column("beta"), float)
        self.beta, self.slabs = self.beta.reshape(-1, self.k), self.slabs // self.k
        self.state = state

    def infer(self, take=None):
        s = self.state
        return infer(
            self.sizes, self.word, self.counts, self.beta, np.array(s.alpha), s.max_steps, s.tolerance, take
        )


def _units(values: np.ndarray) -> np.ndarray:
    return np.rint(values * UNIT).astype(np.int64)


_TAKEN = "slab int, places binary, taken binary"


def _statistics(state: _State):
    """What a block sends back to each slab: the occurrences that each topic takes of its words,
    in ``UNIT``; and under ``_PRIOR_SLAB`` the posts' expected log topic weights."""

    def of_block(posts: pa.Table, slices: pa.Table) -> pa.Table:
        k = len(state.alpha)
        if not posts.num_rows:
            return pa.table({"slab": pa.array([], pa.int32()), **dict.fromkeys(("places", "taken"), pa.array([], pa.binary()))})
        block = _Block(posts, slices, state)
        sums = np.zeros((len(block.beta), k), np.int64)

        def take(entries: np.ndarray, shares: np.ndarray) -> None:
            taken = _units(shares * block.counts[entries, None])
            cells = block.word[entries].astype(np.int64)[:, None] * k + np.arange(k)
            np.add.at(sums.reshape(-1), cells.ravel(), taken.ravel())

        theta = _units(block.infer(take).log_theta).sum(axis=0)
        sizes = np.append(block.slabs, 1)
        places = block.slices.column("places").cast(pa.binary())
        return pa.table(
            {
                "slab": pa.concat_arrays([*block.slices.column("slab").chunks, pa.array([_PRIOR_SLAB], pa.int32())]),
                "places": pa.concat_arrays([*places.chunks, pa.array([b""], pa.binary())]),
                "taken": _cells(np.concatenate([sums, theta[None, :]]), sizes * k),
            }
        )

    return of_block


# --- the fit ------------------------------------------------------------------------------


def _start_weights(terms: DataFrame, k: int, prior: float, seed: int) -> DataFrame:
    """Weights near 1 that sum to ``k`` for each word: noise from hashes, the same on any layout."""

    def noise(topic: int) -> Column:
        draws = [
            F.pmod(F.xxhash64("token", F.lit(seed), F.lit(topic), F.lit(i)), F.lit(1 << 20)) / (1 << 20)
            for i in range(4)
        ]
        return 1 + 0.1 * 3**0.5 * (draws[0] + draws[1] + draws[2] + draws[3] - 2)

    raw = terms.select("index", F.array(*[noise(t) for t in range(k)]).alias("w"))
    total = F.aggregate("w", F.lit(0.0), lambda a, x: a + x)
    return raw.select(
        "index",
        F.transform("w", lambda x: x * k / total).alias("weights"),
        F.lit(float(prior)).alias("prior"),
    )


def _exact_sums(weights: np.ndarray) -> np.ndarray:
    """Sums of the columns in ``UNIT``, the halves rounded up: the same in any order."""
    units = weights * UNIT
    whole = np.floor(units)
    return (whole + (units - whole >= 0.5)).astype(np.int64).sum(axis=0)


_UPDATED = "slab int, index binary, weights binary, sums array<bigint>"


def _updated(
    slabs: DataFrame, priors: DataFrame, taken: DataFrame, k: int, rate: float, scale: float
) -> DataFrame:
    """Old weights faded by ``rate`` towards prior and scaled statistics, with their sums per topic.

    The row of ``_PRIOR_SLAB`` has the sums of the posts' expected log topic weights.
    """
    none = [F.lit(None).cast("binary").alias(c) for c in ("index", "weights", "prior")]
    old = slabs.select("slab", "index", "weights", none[2]).union(priors.select("slab", *none[:2], "prior"))

    def update(old: pa.Table, taken: pa.Table) -> pa.Table:
        def own(name: str) -> pa.ChunkedArray:
            return old.column(name).drop_null()

        cells, sizes = _numbers(taken.column("taken"), np.int64)
        if not old.num_rows:
            slab = taken.column("slab")[0].as_py()
            index, weights = pa.array([b""], pa.binary()), np.empty(0)
            totals = cells.reshape(-1, k).sum(axis=0)
        else:
            slab = old.column("slab")[0].as_py()
            index = pa.array([own("index")[0].as_py()], pa.binary())
            weights = _numbers(own("weights"), float)[0].reshape(-1, k)
            prior = _numbers(own("prior"), float)[0]
            places, parts = _numbers(taken.column("places"), np.int32)
            sums = np.zeros(weights.shape, np.int64)
            cells = cells.reshape(-1, k)
            ends = np.concatenate([[0], np.cumsum(parts)])
            for a, b in zip(ends, ends[1:], strict=False):  # a word is once in what a block sends
                sums[places[a:b]] += cells[a:b]
            weights = (1 - rate) * weights + rate * (prior[:, None] + scale * sums / UNIT)
            totals = _exact_sums(weights)
        return pa.table(
            {
                "slab": pa.array([slab], pa.int32()),
                "index": index,
                "weights": _cells(weights, [weights.size]),
                "sums": pa.array([totals.tolist()], pa.list_(pa.int64())),
            }
        )

    return old.groupBy("slab").cogroup(taken.groupBy("slab")).applyInArrow(update, _UPDATED)


def _sums(updated: DataFrame, k: int) -> dict[bool, tuple[float, ...]]:
    """The sums per topic of the weights (True), and of the posts' expected log topic weights (False)."""
    of_words = F.col("slab") != _PRIOR_SLAB
    unit = lambda i: F.get("sums", F.lit(i)).cast("decimal(28,0)")
    rows = updated.groupBy(of_words.alias("of_words")).agg(*[F.sum(unit(i)).alias(str(i)) for i in range(k)])
    return {r["of_words"]: tuple(float(r[str(i)]) / UNIT for i in range(k)) for r in rows.collect()}


_PRIORS = "slab int, prior binary"


def _learned_word_prior(
    slabs: DataFrame, priors: DataFrame, totals: tuple[float, ...], rate: float, path: str
) -> DataFrame:
    """``priors`` moved by a Newton step: the topics are the draws. Written to ``path`` on the way."""
    k, at_totals = len(totals), digamma(np.array(totals))

    def mean_log(slab: pa.Table, prior: pa.Table) -> pa.Table:
        weights, sizes = _numbers(slab.column("weights"), float)
        held = (digamma(weights.reshape(-1, k)) - at_totals).mean(axis=1)
        return pa.table({**{c: prior.column(c) for c in ("slab", "prior")}, "mean_log": _cells(held, sizes // k)})

    both = slabs.select("slab", "weights").groupBy("slab").cogroup(priors.groupBy("slab"))
    table = stage(both.applyInArrow(mean_log, _PRIORS + ", mean_log binary"), "word-priors", path)
    return newton_step_table(table, k, rate).drop("mean_log")


def _unpacked(slabs: DataFrame, priors: DataFrame, k: int) -> DataFrame:
    """``index, weights, prior``: a row per word again."""

    def rows(slab: pa.Table, prior: pa.Table) -> pa.Table:
        index, _ = _numbers(slab.column("index"), np.int64)
        weights, _ = _numbers(slab.column("weights"), float)
        offsets = pa.array(np.arange(0, len(weights) + 1, k, dtype=np.int32))
        lists = pa.ListArray.from_arrays(offsets, pa.array(weights))
        return pa.table({"index": index, "weights": lists, "prior": _numbers(prior.column("prior"), float)[0]})

    both = slabs.select("slab", "index", "weights").groupBy("slab").cogroup(priors.groupBy("slab"))
    return both.applyInArrow(rows, "index long, weights array<double>, prior double")


def fit_topics(
    df: DataFrame,
    id_col: str,
    text_col: str = C.LEMMATIZED_TEXT,
    eligible: Column | None = None,
    k: int = TOPICS,
    alpha: float = ALPHA,
    beta: float = BETA,
    max_iter: int = 10,
    mini_batch: float = 1.0,
    learn_prior: bool = False,
    seed: int = 42,
    vocab_size: int | None = None,
    max_steps: int = MAX_STEPS,
    tolerance: float = TOLERANCE,
) -> TopicModel | None:
    """Fit online variational LDA on the eligible rows; None when they have no words.

    Every update reads every eligible post, and every word of theirs is in the vocabulary, unless
    the caller asks for a random ``mini_batch`` or the most frequent ``vocab_size`` words.
    ``learn_prior`` learns the weights that topics have in posts and words have in topics
    too. Random starts are hashes of words, blocks hashes of ids, and sums are integers, so
    a fit depends on ids, texts and ``seed`` and on no file layout or order of tasks.
    Words, blocks and the weights of each update are written tables: a lost executor costs
    its own tasks. Rows with equal id and text share a block; otherwise ids may repeat.
    """
    C.require_columns(df, text_col, id_col)
    eligible = topic_eligible(text_col) if eligible is None else eligible
    bags = _bags(df, id_col, text_col, eligible)
    terms = bags.select(F.inline("bag")).groupBy("token").agg(F.sum("n").alias("tf"))
    terms = stage(number_words(terms), "terms")
    if vocab_size is not None:
        terms = terms.where(F.col("index") < vocab_size)
    slabs = _slabs(terms)
    block_words = _block_words(bags, terms, slabs)
    links = _links(block_words)
    # on disk, sorted as the updates need it: memory is left to the tasks
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    coded = stage(_coded(bags, block_words), "coded").repartition(parts, "block").sortWithinPartitions("block")
    coded = coded.persist(StorageLevel.DISK_ONLY)
    try:
        posts = coded.count()
        start = _start_weights(terms, k, beta, seed)
        if not posts or start.isEmpty():
            return None
        weights, priors, totals = _started(start, slabs, beta, k)
        alphas = (float(alpha),) * k
        old: list[str] = []
        for step in range(1, max_iter + 1):
            rate = (1 + step) ** DECAY
            state = _State(totals, alphas, max_steps, tolerance)
            batch, seen = coded, posts
            if mini_batch < 1:
                draw = F.pmod(F.xxhash64("id", F.lit(seed), F.lit(step)), F.lit(1 << 30))
                batch = coded.where(draw < int(mini_batch * (1 << 30)))
                seen = batch.count()
                if not seen:
                    continue
            slices = _slices(weights, links, state)
            taken = batch.groupBy("block").cogroup(slices.groupBy("block")).applyInArrow(_statistics(state), _TAKEN)
            paths = [staging_path(df.sparkSession, name) for name in ("slabs", "word-priors")]
            updated = stage(_updated(weights, priors, taken, k, rate, posts / seen), "slabs", paths[0])
            sums = _sums(updated, k)
            totals, weights = sums[True], updated.where(F.col("slab") != _PRIOR_SLAB)
            if learn_prior:
                mean_log = np.array(sums[False]) / seen
                alphas = tuple(newton_step(np.array(alphas), mean_log, seen, rate).tolist())
                priors = _learned_word_prior(weights, priors, totals, rate, paths[1])
            unstage(df.sparkSession, *old)
            old = paths if learn_prior else paths[:1]
        weights = stage(_unpacked(weights, priors, k), "weights")
        unstage(df.sparkSession, *old)
        return TopicModel(terms, weights, totals, alphas)
    finally:
        coded.unpersist()


def _started(
    start: DataFrame, slabs: int, prior: float, k: int
) -> tuple[DataFrame, DataFrame, tuple[float, ...]]:
    """Slabs of the first weights, a written table; their priors; and their sums per topic."""
    weights = stage(_packed(start, slabs), "slabs")

    def first(slab: pa.Table) -> pa.Table:
        held = _numbers(slab.column("weights"), float)[0].reshape(-1, k)
        same = _cells(np.full(len(held), float(prior)), [len(held)])
        sums = pa.array([_exact_sums(held).tolist()], pa.list_(pa.int64()))
        return pa.table({"slab": slab.column("slab"), "prior": same, "sums": sums})

    first_priors = weights.select("slab", "weights").groupBy("slab").applyInArrow(first, _PRIORS + ", sums array<bigint>")
    priors = stage(first_priors, "word-priors")
    return weights, priors.select("slab", "prior"), _sums(priors, k)[True]


# --- what a model says --------------------------------------------------------------------


def topic_word_shares(model: TopicModel) -> DataFrame:
    """``topic, index, token, share``: each word's part of each topic; they sum to 1 per topic."""
    totals = F.array(*[F.lit(t) for t in model.totals])
    shares = F.transform("weights", lambda w, i: w / F.get(totals, i))
    long = model.weights.select("index", F.posexplode(shares).alias("topic", "share"))
    return long.join(model.terms.select("index", "token"), "index").select("topic", "index", "token", "share")


def topic_words(model: TopicModel, n: int = TOP_WORDS) -> list[list[str]]:
    """The ``n`` heaviest words of each topic, in topic order; ties by frequency, spelling."""
    best = Window.partitionBy("topic").orderBy(F.desc("share"), "index")
    ranked = topic_word_shares(model).withColumn("rank", F.row_number().over(best))
    rows = ranked.where(F.col("rank") <= n).collect()
    words: list[list[str]] = [[] for _ in range(model.k)]
    for r in sorted(rows, key=lambda r: r["rank"]):
        words[r["topic"]].append(r["token"])
    return words


def topic_table(model: TopicModel, n: int = TOP_WORDS) -> DataFrame:
    """The same as a table: one row per rank, one column ``Topic i`` per topic."""
    words = topic_words(model, n)
    spark = model.terms.sparkSession
    rows = [(rank, *ranked) for rank, ranked in enumerate(zip(*words, strict=True))]
    names = ", ".join(f"`Topic {i}` string" for i in range(len(words)))
    return spark.createDataFrame(rows, f"rank int, {names}")


def _small_scorer(model: TopicModel, max_steps: int, tolerance: float):
    """``words -> topic`` for a model within the bound: every task has all of it."""
    held = model.weights.join(model.terms, "index").orderBy("index").select("token", "weights").toArrow()
    state = _State(model.totals, model.alpha, max_steps, tolerance)
    beta = state.beta(_flat(held.column("weights")).reshape(-1, model.k))
    known = {t: i for i, t in enumerate(held.column("token").to_pylist())}
    shared = model.terms.sparkSession.sparkContext.broadcast((known, beta))

    @F.pandas_udf("int")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known, beta = shared.value
        for texts in batches:
            bags = [
                sorted((known[w], n) for w, n in Counter(words).items() if w in known)
                for words in texts
                if words is not None
            ]
            flat = np.array([e for bag in bags for e in bag], np.int64).reshape(-1, 2)
            sizes = np.array([len(b) for b in bags], np.int64)
            found = infer(
                sizes, flat[:, 0], flat[:, 1].astype(float), beta,
                np.array(state.alpha), max_steps, tolerance,
            )
            out = pd.Series([None] * len(texts), dtype="Int64")
            out[texts.notna().to_numpy()] = found.gamma.argmax(axis=1)
            yield out

    return score


def _joined_posts(
    df: DataFrame, model: TopicModel, id_col: str, text_col: str, eligible: Column, state: _State, per_block, schema: str,
    with_tokens: bool = False,
) -> DataFrame:
    """``per_block`` over the blocks of the eligible posts and the weights of their words.

    ``with_tokens`` adds a row with ``token, index`` for each of the words.
    """
    bags = _bags(df, id_col, text_col, eligible)
    slabs = _slabs(model.terms)
    block_words = _block_words(bags, model.terms, slabs)
    coded = _coded(bags, block_words)
    slices = _slices(_packed(model.weights, slabs), _links(block_words), state)
    if with_tokens:
        slices = slices.unionByName(block_words.select("block", "slab", "token", "index"), allowMissingColumns=True)
    return coded.groupBy("block").cogroup(slices.groupBy("block")).applyInArrow(per_block, schema)


def assign_topics(
    df: DataFrame,
    model: TopicModel | None,
    text_col: str = C.LEMMATIZED_TEXT,
    eligible: Column | None = None,
    top_n: int = TOP_WORDS,
    id_col: str | None = None,
    max_bytes: int = MAX_BROADCAST_BYTES,
    max_steps: int = MAX_STEPS,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """Add ``dominant_topic`` and ``top_3_words`` to eligible rows, null elsewhere.

    On a tie the first topic wins. A model within ``max_bytes`` scores every row where it lies. A
    larger one is joined with blocks of posts and the topic joined back by ``id_col``, a
    unique column; without one, rows are numbered and written first. Both give the same.
    """
    C.require_columns(df, text_col)
    if model is None:
        return df.withColumns(
            {
                C.DOMINANT_TOPIC: F.lit(None).cast("int"),
                C.TOP_3_WORDS: F.lit(None).cast("string"),
            }
        )
    eligible = topic_eligible(text_col) if eligible is None else eligible
    if model.fits_in_memory(max_bytes):
        score = _small_scorer(model, max_steps, tolerance)
        words = F.when(eligible, T.words(F.col(text_col)))
        out = df.withColumn(C.DOMINANT_TOPIC, score(words))
    else:
        out = _assigned_by_join(df, model, text_col, eligible, id_col, max_steps, tolerance)
    labels = F.array(*[F.lit(", ".join(w)) for w in topic_words(model, top_n)])
    return out.withColumn(C.TOP_3_WORDS, F.get(labels, F.col(C.DOMINANT_TOPIC)))


def _assigned_by_join(df, model, text_col, eligible, id_col, max_steps, tolerance) -> DataFrame:
    key = id_col or ROW_ID
    rows = df if id_col else with_row_id(df)
    state = _State(model.totals, model.alpha, max_steps, tolerance)
    kind = rows.schema[key].dataType.simpleString()

    def dominant(posts: pa.Table, slices: pa.Table) -> pa.Table:
        topic = pa.array([], pa.int32())
        if posts.num_rows:
            block = _Block(posts, slices, state)
            topic = pa.array(block.infer(lambda *_: None).gamma.argmax(axis=1).astype(np.int32))
        return pa.table({"_topic_id": posts.column("id"), C.DOMINANT_TOPIC: topic})

    schema = f"_topic_id {kind}, {C.DOMINANT_TOPIC} int"
    found = stage(_joined_posts(rows, model, key, text_col, eligible, state, dominant, schema), "topics")
    out = rows.drop(C.DOMINANT_TOPIC).join(found, F.col(key).eqNullSafe(F.col("_topic_id")), "left").drop("_topic_id")
    return out if key in df.columns else out.drop(key)


def token_responsibilities(
    df: DataFrame,
    model: TopicModel,
    id_col: str,
    text_col: str = C.LEMMATIZED_TEXT,
    eligible: Column | None = None,
    max_steps: int = MAX_STEPS,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """``id, token, n, topic, share``: how each word of a post falls to the topics.

    The posterior of the word's topic in that post, as the last inference step has it; the
    shares of a word in a post sum to 1. A topic's weight in the post is its prior plus the sum of
    ``n * share``. Words outside the vocabulary have no rows. ``id_col`` tells posts apart.
    """
    C.require_columns(df, text_col, id_col)
    eligible = topic_eligible(text_col) if eligible is None else eligible
    state = _State(model.totals, model.alpha, max_steps, tolerance)
    kind = df.schema[id_col].dataType.simpleString()

    def shares(posts: pa.Table, slices: pa.Table) -> pa.Table:
        schema = pa.schema([posts.schema.field("id"), ("token", pa.string()), ("n", pa.int64()),
                            ("shares", pa.list_(pa.float64()))])
        parts = [schema.empty_table()]
        if not posts.num_rows:
            return parts[0]
        words = slices.filter(slices.column("token").is_valid())
        words = words.take(pa.array(np.lexsort((words.column("index").to_numpy(), words.column("slab").to_numpy()))))
        token = words.column("token").combine_chunks()
        block = _Block(posts, slices.filter(slices.column("beta").is_valid()), state)
        owner = np.repeat(np.arange(len(block.sizes)), block.sizes)
        ids = block.ids.combine_chunks()

        def take(entries: np.ndarray, shares: np.ndarray) -> None:
            offsets = np.arange(0, shares.size + 1, shares.shape[1], dtype=np.int32)
            columns = [
                ids.take(pa.array(owner[entries])),
                token.take(pa.array(block.word[entries])),
                pa.array(block.counts[entries].astype(np.int64)),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(shares.ravel())),
            ]
            parts.append(pa.table(columns, schema=schema))

        block.infer(take)
        return pa.concat_tables(parts)

    schema = f"id {kind}, token string, n long, shares array<double>"
    rows = _joined_posts(df, model, id_col, text_col, eligible, state, shares, schema, with_tokens=True)
    return rows.select(F.col("id").alias(id_col), "token", "n", F.posexplode("shares").alias("topic", "share"))


def label_by_topic_words(
    df: DataFrame,
    topics: list[list[str]],
    text_col: str = C.CLEANED_TEXT,
    out: str = "labels",
) -> DataFrame:
    """``Topic i`` of the first topic one of whose words occurs inside the text, else null.

    ``topics`` is what ``topic_words`` returns: a few words per topic.
    """
    C.require_columns(df, text_col)
    label = F.lit(None).cast("string")
    for i in reversed(range(len(topics))):
        hit = F.lit(False)
        for word in topics[i]:
            hit = hit | F.col(text_col).contains(word)
        label = F.when(hit, F.lit(f"Topic {i}")).otherwise(label)
    return df.withColumn(out, label)


def finalize_words(
    df: DataFrame,
    topics: list[list[str]],
    words_col: str = C.WEATHER_TOPICS,
    conditions_col: str = C.WEATHER_TEMP,
    label_col: str = "labels",
    out: str = "final_weather_words",
) -> DataFrame:
    """Conditions of a tagged post, else the words of its topic label, else null."""
    C.require_columns(df, words_col, conditions_col, label_col)
    by_label = F.lit(None).cast("string")
    for i, ranked in enumerate(topics):
        by_label = F.when(
            F.col(label_col) == f"Topic {i}", F.lit(", ".join(ranked[:TOP_WORDS]))
        ).otherwise(by_label)
    tagged = F.col(words_col).isNotNull()
    return df.withColumn(out, F.when(tagged, F.col(conditions_col)).otherwise(by_label))


#: Topics in which a word weighs less than this do not count in its relevance.
LEAST_RELEVANCE = 1e-8


def term_relevance(model: TopicModel) -> DataFrame:
    """``token, relevance``: a word's mean weight over the topics it has some weight in.

    The weight is the exponential of the expected log share. A word without weight in any topic is
    left out. Computed where the words lie; nothing passes through the driver.
    """
    at_totals = digamma(np.array(model.totals))

    @F.pandas_udf("double")
    def mean_weight(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            held = np.stack(rows.to_list()) if len(rows) else np.zeros((0, len(at_totals)))
            beta = np.exp(digamma(held) - at_totals)
            counted = beta >= LEAST_RELEVANCE
            total = np.where(counted, beta, 0).sum(axis=1)
            yield pd.Series(total / np.maximum(counted.sum(axis=1), 1))

    words = model.weights.join(model.terms.select("index", "token"), "index")
    return words.select("token", mean_weight("weights").alias("relevance")).where("relevance > 0")


def relevance_words(
    df: DataFrame,
    model_or_relevance: TopicModel | DataFrame,
    n: int = 3,
    text_col: str = C.LEMMATIZED_TEXT,
    out: str = "top_3_relevance_words",
    **bounds: int,
) -> DataFrame:
    """The ``n`` words of a post with the largest relevance x count, joined by a blank.

    Null text stays null; ties go by spelling.
    """
    C.require_columns(df, text_col)
    relevance = (
        term_relevance(model_or_relevance)
        if isinstance(model_or_relevance, TopicModel)
        else model_or_relevance
    )
    table = TokenTable.of(relevance, "double", **bounds)
    bagged = df.withColumn("_bag", token_counts(T.words(F.col(text_col))))
    hits = annotate_tokens(bagged, F.col("_bag")["token"], table, "_hits")

    def ranked(bag: Column) -> Column:
        return F.array_sort(
            F.transform(
                "_hits",
                lambda h: F.struct(
                    (-h["value"] * F.get(bag, h["pos"])["n"]).alias("order"), h["token"]
                ),
            )
        )

    best = let(F.col("_bag"), lambda bag: F.slice(ranked(bag), 1, n))
    words = F.array_join(F.transform(best, lambda b: b["token"]), " ")
    return hits.withColumn(out, F.when(F.col(text_col).isNotNull(), words)).drop("_bag", "_hits")
