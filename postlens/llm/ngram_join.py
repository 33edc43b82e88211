"""N-gram Jaccard join: documents whose word shingles overlap, by signature trees.

1. One pass turns every text into its set of shingle hashes, the hash of that set (its key),
   and a token bitmap. Equal sets share a key and are one node from then on.
2. A forest of signature trees is rooted at rare shingles: two sets of that similarity share
   one of the first ``n - ceil(s n) + 1`` shingles of each, in any common order. The order
   puts shingles last that a count sketch of the whole corpus shows as frequent.
3. The sets below one root, cut where sizes have a gap that no link can cross, form trees of
   OR-combined bitmaps and size ranges; their dual traversal leaves the pairs that may link. These
   tie sets into candidate groups. Trees that would hold very many sets, or many below a frequent
   root, tie neighbours by size instead, which can only make a group larger. A frequent shingle
   comes first only in sets that hold little else: near copies.
4. Each group is joined again by its bitmaps, so that only sets that can link stay together, and
   then by its whole shingle sets: its tree proposes, an exact intersection decides, and pairs
   already in one component are skipped. A large group is dealt into blocks twice at random; what
   its main component did not reach is compared with all of the group, block by block. So no
   link between components is lost and none is repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlens.llm.common import byte_texts, slices, summed_counts
from postlens.llm.components import components
from postlens.llm.signature_tree import Union, bitmap, candidate_pairs
from postlens.sources.staging import stage

SHINGLE_WORDS = 5
SIMILARITY = (3, 4)
SKETCH_WIDTH = 1 << 18
SKETCH_SLICES = 8
#: Sets below one root that make a tree at once; of a shingle that the sketch shows as frequent.
ROOT_SETS, FREQUENT_ROOT_SETS = 1024, 64
BLOCK_SETS = 512
#: Bytes of text that are hashed at once.
PIECE = 1 << 16
#: Hash values of wanted ids or keys that a broadcast holds at most.
FILTER_BUCKETS = 1 << 18


_ODD = 0x9E3779B97F4A7C15
_BYTE_CODES = np.array([xxhash.xxh3_64_intdigest(bytes([b])) for b in range(256)], np.uint64)
_IN_WORD = np.array([b != 0x20 and not 0x09 <= b <= 0x0D for b in range(256)])


def _powers(base: int) -> np.ndarray:
    out = np.full(PIECE + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS, _INVERSES = _powers(_ODD), _powers(pow(_ODD, -1, 1 << 64))


def word_codes(text: bytes) -> np.ndarray:
    """64-bit hash of each word: a polynomial of its bytes, from running sums over pieces of text.

    A word longer than a piece is hashed on its own.
    """
    data = np.frombuffer(text, np.uint8) if text else np.empty(0, np.uint8)
    edges = np.flatnonzero(np.diff(_IN_WORD[data], prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    codes = np.empty(len(starts), np.uint64)
    low = 0
    while low < len(starts):
        base = starts[low]
        high = int(np.searchsorted(ends, base + PIECE, "right"))
        if high <= low:
            codes[low] = xxhash.xxh3_64_intdigest(text[base : ends[low]])
            low += 1
            continue
        size = ends[high - 1] - base
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(_BYTE_CODES[data[base : base + size]] * _POWERS[:size], out=sums[1:])
        at = starts[low:high] - base
        codes[low:high] = (sums[ends[low:high] - base] - sums[at]) * _INVERSES[at]
        low = high
    return codes


def shingle_set(text: bytes, width: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text.

    ``bytes.lower`` changes A-Z only; words end at blank and \\x09-\\x0D only.
    """
    codes = word_codes(text.lower())
    if not len(codes):
        return codes
    width = min(width, len(codes))
    n = len(codes) - width + 1
    out = np.full(n, width, np.uint64)
    for at in range(width):
        out ^= codes[at : at + n]
        out *= np.uint64(_ODD)
        out ^= out >> np.uint64(29)
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def _key(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def _bucket(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(20)).astype(np.int64) & (SKETCH_WIDTH - 1)


SETS_SCHEMA = "doc_id long, key long, n int, signature binary, part int, task int, counts binary"


def _sets(batches) -> Iterator[pa.RecordBatch]:
    """A row for each document, then the task's slices of the count sketch."""
    names = ["doc_id", "key", "n", "signature", "part", "task", "counts"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.binary()]

    def batch(columns):
        arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names)

    counts, any_row = np.zeros(SKETCH_WIDTH, np.int64), False
    for rows in slices(batches):
        any_row = True
        sets = [shingle_set(t) for t in byte_texts(rows.column(1))]
        counts += np.bincount(_bucket(np.concatenate(sets)), minlength=SKETCH_WIDTH)
        none = [None] * len(sets)
        yield batch(
            [
                rows.column(0).to_pylist(),
                [_key(s) if len(s) else None for s in sets],
                [len(s) for s in sets],
                [bitmap(s) if len(s) else None for s in sets],
                none, none, none,
            ]
        )
    if any_row:
        k, none = SKETCH_SLICES, [None] * SKETCH_SLICES
        cut = [c.astype(np.int64).tobytes() for c in np.split(counts, k)]
        task = TaskContext.get().partitionId()
        yield batch([none, none, none, none, list(range(k)), [task] * k, cut])


def _sketch(staged: DataFrame) -> np.ndarray:
    """Sum of the tasks' sketches; of fixed size on the driver."""
    sums = summed_counts(staged.where("part is not null").select("part", "task", "counts"))
    none = np.zeros(SKETCH_WIDTH // SKETCH_SLICES, np.int64)
    return np.concatenate([sums.get(part, none) for part in range(SKETCH_SLICES)])


def frequency_level(counts: np.ndarray) -> np.ndarray:
    """0 for a bucket that is as full as most; else a logarithm of what it has above that."""
    usual = np.median(counts)
    above = counts - usual - 6 * np.sqrt(usual + 1)
    return np.where(above > 0, np.log2(np.maximum(above, 1)) + 1, 0).astype(np.uint8)


def _roots(level: np.ndarray, similarity: tuple[int, int]):
    num, den = similarity

    def run(batches) -> Iterator[pa.RecordBatch]:
        seen = set()
        for rows in slices(batches):
            tokens, keys, sizes, frequent = [], [], [], []
            for text in byte_texts(rows.column(0)):
                s = shingle_set(text)
                if not len(s) or (key := _key(s)) in seen:
                    continue
                seen.add(key)
                own = level[_bucket(s)]
                first = np.argsort(own, kind="stable")[: len(s) + (-len(s) * num) // den + 1]
                tokens.append(s[first])
                keys.append(np.full(len(first), key, np.int64))
                sizes.append(np.full(len(first), len(s), np.int32))
                frequent.append(own[first] > 0)
            if tokens:
                columns = [np.concatenate(c) for c in (tokens, keys, sizes, frequent)]
                columns[0] = columns[0].view(np.int64)
                arrays = [pa.array(c) for c in columns]
                yield pa.RecordBatch.from_arrays(arrays, ["token", "key", "n", "frequent"])

    return run


def _blocks(batches, names: list[str]) -> Iterator[dict[str, list]]:
    """Columns of each block of a partition that is sorted by block."""
    block, columns = None, None
    for rows in slices(batches, 64):
        data = rows.to_pydict()
        for at, own in enumerate(data["block"]):
            if own != block:
                if columns is not None:
                    yield columns
                block, columns = own, {n: [] for n in names}
            for n in names:
                columns[n].append(data[n][at])
    if columns is not None:
        yield columns


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = ([x[i] for x in found] for i in (0, 1))
    arrays = [pa.array(a, pa.int64()), pa.array(b, pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, ["a", "b"])


def _start(components: list[int | None]) -> Union:
    """Positions of a block, joined where their components are already one."""
    groups, first = Union(len(components)), {}
    for at, c in enumerate(components):
        if c is not None:
            groups.join(at, first.setdefault(c, at))
    return groups


def _tie_candidates(similarity: tuple[int, int]):
    """Ties the sets of each block that their tree cannot keep apart."""

    def run(batches):
        for block in _blocks(batches, ["key", "component", "n", "signature"]):
            keys, groups, found = block["key"], _start(block["component"]), []
            for i, j in candidate_pairs(block["n"], block["signature"], *similarity):
                for x, y in zip(i.tolist(), j.tolist(), strict=True):
                    if groups.find(x) != groups.find(y):
                        groups.join(x, y)
                        found.append((keys[x], keys[y]))
            if found:
                yield _edges(found)

    return run


def _link(similarity: tuple[int, int]):
    """Links of each block: proposed by the tree, decided by the whole sets."""
    num, den = similarity

    def run(batches):
        for block in _blocks(_with_sets(batches), ["key", "component", "tokens"]):
            keys = block["key"]
            sets = [np.frombuffer(t, np.uint64) for t in block["tokens"]]
            groups = _start(block["component"])
            sizes = [len(s) for s in sets]
            found = []
            for i, j in candidate_pairs(sizes, [bitmap(s) for s in sets], num, den):
                for x, y in zip(i.tolist(), j.tolist(), strict=True):
                    if groups.find(x) == groups.find(y):
                        continue
                    both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    if den * both >= num * (sizes[x] + sizes[y] - both):
                        groups.join(x, y)
                        found.append((keys[x], keys[y]))
            if found:
                yield _edges(found)

    return run


def _with_sets(batches) -> Iterator[pa.RecordBatch]:
    """The rows with whole shingle sets in place of texts; repeats of a set are left out."""
    last = None
    for rows in slices(batches, 64):
        data = {n: rows.column(n).to_pylist() for n in ("block", "key", "component")}
        texts = byte_texts(rows.column(rows.schema.get_field_index("text")))
        out = {n: [] for n in ("block", "key", "component", "tokens")}
        for block, key, component, text in zip(*data.values(), texts, strict=True):
            if (block, key) == last:
                continue
            tokens = shingle_set(text)
            if _key(tokens) == key:  # else another row of the same doc_id
                last = (block, key)
                for n, v in zip(out, (block, key, component, tokens.tobytes()), strict=True):
                    out[n].append(v)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        arrays = [pa.array(v, t) for v, t in zip(out.values(), types, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, list(out))


def _by_block(rows: DataFrame, run) -> DataFrame:
    dealt = rows.drop("rep", "doc_id").repartition("block").sortWithinPartitions("block", "key")
    return dealt.mapInArrow(run, "a long, b long")


def _candidate_edges(docs: DataFrame, one: DataFrame, level, similarity) -> DataFrame:
    num, den = similarity
    roots = docs.select("text").mapInArrow(
        _roots(level, similarity), "token long, key long, n int, frequent boolean"
    )
    by_root = Window.partitionBy("token").orderBy("n", "key")
    roots = roots.withColumn("before", F.lag("key").over(by_root))
    roots = roots.where("before is null or before != key")
    fits = lambda small, large: F.coalesce(den * small >= num * large, F.lit(False))
    roots = roots.withColumns(
        {
            "before": F.lag("key").over(by_root),
            "fits": fits(F.lag("n").over(by_root), F.col("n")),
            "fits_next": fits(F.col("n"), F.lead("n").over(by_root)),
        }
    ).where("fits or fits_next")
    # a gap in size that no link can cross starts a tree of its own
    so_far = by_root.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    roots = roots.withColumn("tree", F.count_if(~F.col("fits")).over(so_far))
    roots = roots.withColumn("sets", F.count("*").over(Window.partitionBy("token", "tree")))
    most = F.when(F.col("frequent"), FREQUENT_ROOT_SETS).otherwise(ROOT_SETS)
    roots = roots.withColumn("large", F.col("sets") > most)
    roots = stage(roots.select("token", "tree", "n", "key", "before", "fits", "large"), "roots")
    chain = roots.where("large and fits")
    chain = chain.select(F.col("before").alias("a"), F.col("key").alias("b"))
    trees = (
        roots.where(~F.col("large"))
        .groupBy("token", "tree")
        .agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("sets"))
        .select("sets")
        .distinct()
        .select(F.xxhash64("sets").alias("block"), F.explode("sets.key").alias("key"))
    )
    none = F.lit(None).cast("long").alias("component")
    trees = stage(trees, "trees")
    signed = _near(one, "key", trees).select("key", "n", "signature", none)
    return _by_block(trees.join(signed, "key"), _tie_candidates(similarity)).union(chain)


def ngram_jaccard_join(
    docs: DataFrame, similarity: tuple[int, int] = SIMILARITY, block_sets: int = BLOCK_SETS
) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of 3/4 or more.

    Takes ``doc_id`` and ``text``, ignores other columns. Returns a row for each row of ``docs``:
    ``doc_id``, ``n_shingles`` and ``component_id``, the smallest ``doc_id`` that links
    reach. A null or blank text has no shingles and is its own component. Repeated rows
    come back as often as they came; a row without ``doc_id`` links with nothing and has no
    component. No rows give no rows. Similarities below 1/2 are refused: the bitmaps of
    neighbouring sizes would not fold. Shingles and sets are compared by 64-bit hashes.
    """
    num, den = similarity
    if 2 * num < den:
        raise ValueError("the similarity must be 1/2 or more")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    named = docs.where("doc_id is not null")
    staged = stage(docs.mapInArrow(_sets, SETS_SCHEMA), "sets")
    rows = staged.where("part is null").select("doc_id", "key", "n", "signature")
    one = rows.where("key is not null and doc_id is not null").groupBy("key")
    one = stage(
        one.agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("signature").alias("signature")),
        "one",
    )
    level = frequency_level(_sketch(staged))
    groups = components(_candidate_edges(named, one, level, similarity))
    signed = lambda wanted: wanted.join(
        _near(one, "key", wanted).select("key", "n", "signature"), "key"
    )
    ties = _components_within(groups, one, signed, _tie_candidates(similarity), block_sets)
    read = lambda wanted: _with_texts(named, wanted)
    links = _components_within(ties, one, read, _link(similarity), block_sets)
    root = F.coalesce("root", "key").alias("root")
    member = one.select("key", "rep").join(links.withColumnRenamed("node", "key"), "key", "left")
    member = member.select("key", "rep", root)
    smallest = member.groupBy("root").agg(F.min("rep").alias("component_id"))
    component = member.join(smallest, "root").select("key", "component_id")
    component_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return rows.join(component, "key", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), component_id.alias("component_id")
    )


def _near(rows: DataFrame, column: str, wanted: DataFrame, name: str | None = None) -> DataFrame:
    """The rows whose ``column`` may be among ``wanted``; a join then decides.

    A broadcast of at most ``FILTER_BUCKETS`` hash values keeps most others out of the shuffle.
    """
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BUCKETS))
    some = wanted.select(bucket(name or column).alias("b")).distinct()
    return rows.join(F.broadcast(some), bucket(column) == F.col("b"), "left_semi")


def _with_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts of ``wanted(rep, ...)``."""
    near = _near(docs, "doc_id", wanted, "rep")
    return near.join(wanted, F.col("doc_id") == F.col("rep"))


def _components_within(groups: DataFrame, one: DataFrame, attach, run, block_sets: int) -> DataFrame:
    """Components of the members of each group, by edges found in blocks of bounded size.

    ``attach`` adds what ``run`` compares to rows of ``block, key, rep, component``. A group of more
    than ``block_sets`` is dealt into blocks twice at random, which leaves most of what belongs
    together in one component. All that is outside the largest one then meets all of the
    group, block by block, so the components that come out are those of all pairs.
    """
    group = groups.select(F.col("node").alias("key"), F.col("root").alias("group"))
    sized = group.groupBy("group").agg(F.ceil(F.count("*") / block_sets).alias("parts"))
    group = stage(group.join(sized, "group").join(one.select("key", "rep"), "key"), "groups")
    deal = [
        F.xxhash64("group", F.lit(n), F.pmod(F.xxhash64("key", F.lit(n)), F.col("parts")))
        for n in (1, 2)
    ]
    blocks = F.when(F.col("parts") == 1, F.array(F.xxhash64("group"))).otherwise(F.array(*deal))
    none = F.lit(None).cast("long").alias("component")
    wanted = group.select(F.explode(blocks).alias("block"), "key", "rep", none)
    found = components(_by_block(attach(wanted), run))
    large = group.where("parts > 1")
    if large.isEmpty():
        return found
    component = F.coalesce("root", "key").alias("component")
    large = large.join(found.withColumnRenamed("node", "key"), "key", "left")
    large = stage(large.select("key", "rep", "group", "parts", component), "large")
    counted = large.groupBy("group", "component").agg(F.count("*").alias("n"))
    rest = counted.groupBy("group").agg(
        F.max_by("component", F.struct("n", "component")).alias("main"),
        F.ceil((F.sum("n") - F.max("n")) / block_sets).cast("int").alias("rests"),
    )
    rest = stage(rest.where("rests > 0"), "rest")
    if rest.isEmpty():
        return found
    part = F.pmod(F.xxhash64("key", F.lit(3)), F.col("parts"))
    own = F.pmod(F.xxhash64("key", F.lit(4)), F.col("rests"))
    meets = F.transform(
        F.sequence(F.lit(0), F.col("rests") - 1), lambda r: F.xxhash64("group", r.cast("long"), part)
    )
    asks = F.transform(
        F.sequence(F.lit(0), F.col("parts").cast("int") - 1),
        lambda p: F.xxhash64("group", own.cast("long"), p.cast("long")),
    )
    both = F.when(F.col("component") == F.col("main"), meets).otherwise(F.array_union(meets, asks))
    wanted = large.join(rest, "group").select(F.explode(both).alias("block"), "key", "rep", "component")
    return components(found.toDF("a", "b").union(_by_block(attach(wanted), run)))
