"""Word lookup tables (gazetteers, lexicons, glossaries) applied to token arrays.

Two ways, the same result. In both, the smallest value of a repeated key counts:

* a table within the size bound becomes one constant, an array of small hash buckets.
  Every token is looked up inside its own row, so no row is exploded or shuffled;
* a larger table is joined with the distinct tokens of blocks of rows, and the rows of a block
  look their tokens up in what that found. Rows get a number of their own and are written with
  it, so repeated or null ids of the caller do no harm. No token is shuffled once per occurrence.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterable, Mapping
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructType

from postlens.sources.staging import stage

MAX_CONSTANT_ROWS = 500_000
MAX_CONSTANT_BYTES = 16 << 20
MAX_SALTS = 256
#: A token with more than this share of all tokens is hot; there are fewer of them than its inverse.
HOT_SHARE = 1 / 500
#: About so many tokens of rows are looked up by one call; see ``_blocks``.
BLOCK_TOKENS = 1 << 19
ROW_ID = "_row_id"


def word_frame(spark: SparkSession, **columns: Iterable[str]) -> DataFrame:
    """A DataFrame of a few driver-side string lists.

    Going through Arrow makes it a local relation, whose size the optimizer knows.
    """
    return spark.createDataFrame(
        pa.table({name: pa.array(list(values), pa.string()) for name, values in columns.items()})
    )


def join_salts(spark: SparkSession) -> int:
    """Over how many join keys one frequent word is spread."""
    return max(1, min(MAX_SALTS, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def with_row_id(df: DataFrame) -> DataFrame:
    """``df`` with a number for each row in ``ROW_ID``, written so that the numbers stay.

    A table that has such numbers is returned as it is. A stream cannot be numbered.
    """
    if ROW_ID in df.columns:
        return df
    if df.isStreaming:
        raise ValueError("a stream needs lookup tables within the constant bound")
    return stage(df.withColumn(ROW_ID, F.monotonically_increasing_id()), "rows")


def hot_tokens(tokens: DataFrame) -> list[str]:
    """Values of ``tokens(token)`` that hold more than ``HOT_SHARE`` of its rows."""
    counts = tokens.groupBy("token").agg(F.count("*").alias("n"))
    counts = stage(counts, "token-counts")
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    hot = counts.where((F.col("n") > total * HOT_SHARE) & F.col("token").isNotNull())
    return [r["token"] for r in hot.select("token").collect()]


class TokenTable:
    """A ``key -> value`` table, unique by key, held as a constant or as a DataFrame."""

    def __init__(
        self, value_type: str, pairs: Mapping[str, Any] | None, frame: DataFrame | None
    ) -> None:
        self.value_type = value_type
        self.pairs = pairs
        self.frame = frame

    @classmethod
    def of(
        cls,
        source: TokenTable | DataFrame | Mapping[str, Any] | Iterable[str],
        value_type: str | None = None,
        max_rows: int = MAX_CONSTANT_ROWS,
        max_bytes: int = MAX_CONSTANT_BYTES,
    ) -> TokenTable:
        """Wrap a dict, a plain word list, or a DataFrame with columns (key[, value]).

        A DataFrame is measured first. Only one within both bounds is fetched; anything
        larger stays a DataFrame and is joined. Null keys and null values are no entries. Of a
        repeated key the smallest value counts.
        """
        if isinstance(source, TokenTable):
            return source
        if not isinstance(source, DataFrame):
            if not isinstance(source, Mapping):
                source = {word: word for word in source}
            pairs = {k: v for k, v in source.items() if k is not None and v is not None}
            return cls(value_type or "string", pairs, None)
        frame = cls._unique(cls._as_pairs(source, value_type))
        value_type = frame.schema["value"].dataType.simpleString()
        entries = frame.select("key", F.to_json(F.struct("value")).alias("json"))
        entries = entries.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            size = entries.agg(
                F.count("*").alias("n"),
                F.sum(F.octet_length("key") + F.octet_length("json")).alias("b"),
            ).first()
            if size["n"] > max_rows or (size["b"] or 0) > max_bytes:
                return cls(value_type, None, frame)
            table = entries.toArrow()
            values = json.loads(f"[{','.join(table['json'].to_pylist())}]")
            pairs = dict(zip(table["key"].to_pylist(), (v["value"] for v in values), strict=True))
        finally:
            entries.unpersist()
        return cls(value_type, pairs, None)

    @classmethod
    def joined(cls, source: DataFrame, unique: bool = False) -> TokenTable:
        """Use the join without measuring, for tables that are themselves a long job.

        ``unique`` says that no key repeats, which saves grouping the table.
        """
        frame = cls._as_pairs(source)
        frame = frame if unique else cls._unique(frame)
        return cls(frame.schema["value"].dataType.simpleString(), None, frame)

    @staticmethod
    def _as_pairs(source: DataFrame, value_type: str | None = None) -> DataFrame:
        key = source.columns[0]
        value = F.col(source.columns[1] if len(source.columns) > 1 else key)
        if value_type:
            value = value.cast(value_type)
        frame = source.select(F.col(key).alias("key"), value.alias("value"))
        return frame.where(F.col("key").isNotNull() & F.col("value").isNotNull())

    @staticmethod
    def _unique(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("key").agg(F.min("value").alias("value"))

    @property
    def is_constant(self) -> bool:
        return self.pairs is not None

    def lookup(self) -> Callable[[Column], Column]:
        """``token -> value or null`` as a column expression; constant tables only.

        Spark searches a map value from front to back, so a single map would cost its
        whole length per token. Buckets of about two entries keep that constant.
        """
        if self.pairs is None:
            raise ValueError("this table is over the constant bound; join it instead")
        if not self.pairs:
            return lambda token: F.lit(None).cast(self.value_type)
        n = max(1, len(self.pairs) // 2)
        buckets: list[dict[str, Any]] = [{} for _ in range(n)]
        for key, value in self.pairs.items():
            buckets[zlib.crc32(key.encode("utf-8")) % n][key] = value
        constant = F.from_json(
            F.lit(json.dumps(buckets, ensure_ascii=False)),
            f"array<map<string,{self.value_type}>>",
        )

        def look_up(token: Column) -> Column:
            bucket = F.pmod(F.crc32(token.cast("binary")), F.lit(n)).cast("int")
            return F.try_element_at(F.get(constant, bucket), token)

        return look_up


def annotate_tokens(
    df: DataFrame,
    tokens: Column,
    table: TokenTable,
    out: str,
    keep_misses: bool = False,
    drop: tuple[str, ...] = (),
) -> DataFrame:
    """Add ``out``: ``array<struct<pos, token, value>>`` of the known tokens, in text order.

    ``keep_misses`` keeps unknown tokens too, with a null value. A null token array gives an
    empty result. Rows are told apart whatever their columns hold. Columns of ``drop`` are left out.
    """
    kind = f"array<struct<pos:int,token:string,value:{table.value_type}>>"
    empty = F.array().cast(kind)
    if table.is_constant:
        look_up = table.lookup()
        found = F.transform(
            tokens,
            lambda t, i: F.struct(i.alias("pos"), t.alias("token"), look_up(t).alias("value")),
        )
        if not keep_misses:
            found = F.filter(found, lambda s: s["value"].isNotNull())
        return df.withColumn(out, F.coalesce(found.cast(kind), empty)).drop(*drop)

    return _looked_up_in_blocks(df, tokens, table, out, keep_misses, kind, drop)


def _blocks(rows: DataFrame, tokens: Column) -> Column:
    """The block of each numbered row: a few per written partition, each of about ``BLOCK_TOKENS`` tokens.

    The upper half of a row number is its partition; the rows of one are dealt over its
    blocks by a hash, so long rows beside one another do not share one. Only the sizes of
    the partitions reach the driver.
    """
    part = F.shiftright(ROW_ID, 33)
    sizes = rows.groupBy(part.alias("part")).agg(F.sum(F.size(tokens)).alias("n")).collect()
    counts = [0] * (1 + max((r["part"] for r in sizes), default=0))
    for r in sizes:
        counts[r["part"]] = max(0, r["n"] or 0) // BLOCK_TOKENS
    several = {i: 1 + n for i, n in enumerate(counts) if n}
    if not several:
        return F.shiftleft(part, 20)
    n = F.get(F.lit([several.get(i, 1) for i in range(len(counts))]), part.cast("int"))
    return F.shiftleft(part, 20) + F.pmod(F.xxhash64(ROW_ID), n)


def _nullable(schema: StructType) -> StructType:
    """``schema`` without any promise that there are no nulls."""
    text = re.sub(r'"(nullable|containsNull|valueContainsNull)":false', r'"\1":true', schema.json())
    return StructType.fromJson(json.loads(text))


def _looked_up_in_blocks(
    df: DataFrame, tokens: Column, table: TokenTable, out: str, keep_misses: bool, kind: str,
    drop: tuple[str, ...] = (),
) -> DataFrame:
    """``annotate_tokens`` for a joined table: the rows are shuffled once, by block.

    The distinct tokens of each block meet the table, so a very frequent token is as many
    rows of that join as there are blocks. A block's rows then find their tokens among those.
    """
    rows = with_row_id(df)
    block = _blocks(rows, tokens)
    asked = rows.select(block.alias("_lookup_block"), F.explode(F.array_distinct(tokens)).alias("key"))
    known = asked.distinct().join(table.frame, "key").select("_lookup_block", "key", "value")
    dealt = rows.withColumn("_lookup_block", block).repartition("_lookup_block").withColumn("_lookup_tokens", tokens)
    kept = [c for c in df.columns if c != out and c not in drop]
    schema = _nullable(StructType([df.schema[c] for c in kept])).add(out, DataType.fromDDL(kind))
    types = {f.name: to_arrow_type(f.dataType) for f in schema}

    def look_up(posts: pa.Table, known: pa.Table) -> pa.Table:
        lists = posts.column("_lookup_tokens").combine_chunks()
        flat = lists.flatten()
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        begins = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        place = np.arange(len(flat)) - np.repeat(begins[:-1], sizes)
        at = pc.index_in(flat, value_set=known.column("key").combine_chunks())
        if not keep_misses:
            hit = at.is_valid().to_numpy(zero_copy_only=False)
            begins = np.concatenate([[0], np.cumsum(hit)])[begins]
            place, flat, at = place[hit], flat.filter(pa.array(hit)), at.drop_null()
        value = known.column("value").combine_chunks().take(at)
        found = pa.StructArray.from_arrays(
            [pa.array(place, pa.int32()), flat, value], ["pos", "token", "value"]
        )
        found = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), found).cast(types[out])
        # nested columns may come with or without a promise of no nulls inside
        own = [posts.column(c) for c in kept]
        own = [v.cast(types[c]) if pa.types.is_nested(v.type) else v for c, v in zip(kept, own, strict=True)]
        return pa.table([*own, found], [*kept, out])

    dealt = dealt.select(*[F.col(f"`{c}`") for c in kept], "_lookup_block", "_lookup_tokens")
    return dealt.groupBy("_lookup_block").cogroup(known.groupBy("_lookup_block")).applyInArrow(look_up, schema)
