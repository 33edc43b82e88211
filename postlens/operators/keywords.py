"""Keyword tags: which mapping keys sit inside a post's words, and what they imply."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens import columns as C
from postlens.functions import text as T
from postlens.functions.token_table import (
    ROW_ID,
    TokenTable,
    annotate_tokens,
    with_row_id,
)
from postlens.sources.staging import stage

MAPPING_REGIONS = ("EU", "USA")
MAX_CONSTANT_KEYS = 1_000


def unpivot_mapping(mapping: DataFrame, regions: tuple[str, ...] = MAPPING_REGIONS) -> DataFrame:
    """One row per (word, region): columns ``word, need_location, region, mapping``.

    A ``row_no`` column is kept when the table has one.
    """
    C.require_columns(mapping, "word", "need_location", *regions)
    ids = ["word", "need_location"] + (["row_no"] if "row_no" in mapping.columns else [])
    return mapping.unpivot(ids, list(regions), "region", "mapping")


def dedupe_mapping(
    unpivoted: DataFrame, regions: tuple[str, ...] = MAPPING_REGIONS
) -> DataFrame:
    """One condition per lower-cased word. Later regions, then later rows, win.

    For the conditions of one region only, filter the unpivoted table first.
    """
    rank = F.array_position(F.array(*[F.lit(r) for r in regions]), F.col("region"))
    order = [rank] + ([F.col("row_no")] if "row_no" in unpivoted.columns else [])
    order.append(F.col("mapping"))
    return (
        unpivoted.where(F.col("word").isNotNull() & (F.col("word") != ""))
        .groupBy(F.lower("word").alias("word"))
        .agg(F.max_by("mapping", F.struct(*order)).alias("mapping"))
    )


def live_keys(mapping: DataFrame, phrases: bool = False) -> DataFrame:
    """Keys that can match at all.

    A key is sought inside single words, so one with a blank or a hyphen is dead. With
    ``phrases`` a key of several words counts too and is sought in the whole text. Blanks
    alone are no key.
    """
    pattern = r"^[" + T.WORD_CHARS + (" " if phrases else "") + r"]+$"
    return mapping.where(F.col("word").rlike(pattern) & (F.trim("word") != ""))


def _joined_or_null(parts: list[Column]) -> Column:
    return F.nullif(F.concat_ws(", ", *parts), F.lit("")) if parts else F.lit(None).cast("string")


def map_conditions(
    df: DataFrame,
    text_col: str,
    mapping: DataFrame,
    phrases: bool = False,
    conditions_col: str | None = None,
    max_keys: int = MAX_CONSTANT_KEYS,
) -> DataFrame:
    """Add ``weather_topics`` (matched keys) and ``weather_temp`` (their conditions).

    Both are sorted, distinct and joined by ``", "``; null without a match. A key made of
    word characters lies inside one word exactly when it lies inside the lower-cased
    text, so a small key table is a chain of ``contains`` tests within generated code.
    A larger one goes through an equi-join on word fragments; rows are numbered and written
    first, so ids that repeat or are null do no harm. A key of several words (``phrases``) meets
    there only the posts that hold its rarest part, and is then sought around it.
    ``conditions_col`` names an extra array column with the single conditions.
    """
    C.require_columns(df, text_col)
    keys = live_keys(mapping, phrases).select("word", "mapping")
    rows = keys.limit(max_keys + 1).collect()
    if len(rows) > max_keys:
        return _map_conditions_joined(df, text_col, keys, conditions_col)

    text = F.lower(F.col(text_col))
    hit = {r["word"]: text.contains(r["word"]) for r in rows}
    topics = [F.when(hit[key], F.lit(key)) for key in sorted(hit)]
    by_condition: dict[str, Column] = {}
    for r in rows:
        if r["mapping"] is not None:
            known = by_condition.get(r["mapping"])
            by_condition[r["mapping"]] = hit[r["word"]] if known is None else known | hit[r["word"]]
    conditions = [F.when(by_condition[c], F.lit(c)) for c in sorted(by_condition)]
    df = df.withColumns(
        {C.WEATHER_TOPICS: _joined_or_null(topics), C.WEATHER_TEMP: _joined_or_null(conditions)}
    )
    if conditions_col:
        found = F.array_compact(F.array(*conditions)) if conditions else F.lit(None)
        df = df.withColumn(
            conditions_col,
            F.when(F.col(C.WEATHER_TOPICS).isNotNull(), found.cast("array<string>")),
        )
    return df


def match_keywords(
    df: DataFrame, text_col: str, mapping: DataFrame, out: str = "matched_keys", **options
) -> DataFrame:
    """Add the sorted array of matched keys; null without a match."""
    tagged = map_conditions(df.drop(C.WEATHER_TOPICS, C.WEATHER_TEMP), text_col, mapping, **options)
    return tagged.withColumn(out, F.split(C.WEATHER_TOPICS, ", ")).drop(
        C.WEATHER_TOPICS, C.WEATHER_TEMP
    )


def _map_conditions_joined(
    df: DataFrame, text_col: str, keys: DataFrame, conditions_col: str | None
) -> DataFrame:
    rows = with_row_id(df)
    keys = stage(keys, "mapping-keys")
    several = F.contains(F.col("word"), F.lit(" "))
    found = _joined_keys(rows, text_col, keys.where(~several))
    if not keys.where(several).isEmpty():
        found = found.unionByName(_joined_phrases(rows, text_col, keys.where(several)))
        merged = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
        found = found.groupBy("_id").agg(merged("_keys").alias("_keys"), merged("_conditions").alias("_conditions"))
    found = stage(found, "keys")
    out = rows.join(found, rows[ROW_ID] == found["_id"], "left").withColumns(
        {
            C.WEATHER_TOPICS: F.nullif(F.array_join("_keys", ", "), F.lit("")),
            C.WEATHER_TEMP: F.nullif(F.array_join("_conditions", ", "), F.lit("")),
        }
    )
    if conditions_col:
        out = out.withColumn(conditions_col, F.col("_conditions"))
    out = out.drop("_id", "_keys", "_conditions")
    return out if ROW_ID in df.columns else out.drop(ROW_ID)


# How a part of a phrase, cut at blanks, lies in a piece of a text, cut the same way.
_ENDS, _IS, _BEGINS = "ends", "is", "begins"


def phrase_parts(phrases: DataFrame) -> DataFrame:
    """``word, kind, part``: what must be in a post that holds a phrase.

    Between blanks a phrase is found in a text where its first part ends a piece, its inner parts
    are the next pieces and its last part begins the one after. Empty ends ask for nothing.
    """
    parts = phrases.select("word", F.split("word", " ").alias("p"))
    parts = parts.select("word", F.size("p").alias("n"), F.posexplode("p").alias("i", "part"))
    kind = F.when(F.col("i") == 0, _ENDS).when(F.col("i") == F.col("n") - 1, _BEGINS).otherwise(_IS)
    parts = parts.select("word", kind.alias("kind"), "part").distinct()
    return parts.where((F.col("kind") == _IS) | (F.col("part") != ""))


def _piece_parts(piece: Column, lengths: dict[str, list[int]]) -> Column:
    """The parts that a piece of text can answer to."""

    def cuts(kind: str, cut: Callable[[Column, Column], Column]) -> Column:
        of_kind = F.array(*[F.lit(n) for n in lengths.get(kind, [])]).cast("array<int>")
        fitting = F.filter(of_kind, lambda n: n <= F.length(piece))
        return F.transform(
            fitting, lambda n: F.struct(F.lit(kind).alias("kind"), cut(piece, n).alias("part"))
        )

    whole = F.array(F.struct(F.lit(_IS).alias("kind"), piece.alias("part")))
    return F.flatten(F.array(whole, cuts(_ENDS, F.right), cuts(_BEGINS, F.left)))


def _joined_phrases(rows: DataFrame, text_col: str, phrases: DataFrame) -> DataFrame:
    """``_id, _keys, _conditions`` of the posts that hold a phrase, for any number of phrases.

    An index of the distinct pieces of the posts gives how many posts can answer to each part;
    a phrase is anchored at its rarest part, and one with a part that no post has
    is done with. Only posts with the anchor meet the phrase, which is sought in the pieces around it.
    """
    text = F.lower(F.col(text_col))
    parts = stage(phrase_parts(phrases), "phrase-parts")
    sizes = parts.where(F.col("kind") != _IS).groupBy("kind")
    sizes = sizes.agg(F.sort_array(F.collect_set(F.length("part"))).alias("n")).collect()
    lengths = {r["kind"]: r["n"] for r in sizes}
    most = phrases.agg(F.max(F.size(F.split("word", " "))).alias("n")).first()["n"]
    pieces = F.split(text, " ")
    index = rows.select(F.explode(F.array_distinct(pieces)).alias("token"))
    index = index.groupBy("token").agg(F.count("*").alias("posts"))
    index = index.select("token", "posts", F.inline(_piece_parts(F.col("token"), lengths)))
    asked = parts.select("kind", "part").distinct()
    index = stage(index.join(asked, ["kind", "part"]), "piece-index")
    common = index.groupBy("kind", "part").agg(F.sum("posts").alias("posts"))
    needed = parts.groupBy("word").agg(F.count("*").alias("needed"))
    # by posts first; of equally rare parts the longest, then any one, the same each time
    rank = F.struct("posts", -F.length("part"), "kind", "part")
    anchors = (
        parts.join(common, ["kind", "part"])
        .groupBy("word")
        .agg(F.count("*").alias("known"), F.min_by(F.struct("kind", "part"), rank).alias("at"))
        .join(needed, "word")
        .where("known = needed")
        .select("word", "at.kind", "at.part")
    )
    hosts = index.select("kind", "part", "token").join(anchors, ["kind", "part"])
    hosts = stage(hosts.groupBy("token").agg(F.collect_set("word").alias("words")), "anchors")
    # a block of posts meets the phrases of its distinct pieces; no post and phrase is a row of a join
    posts = rows.select(F.col(ROW_ID), pieces.alias("_pieces"))
    near = annotate_tokens(posts, F.col("_pieces"), TokenTable.joined(hosts, unique=True), "_hits")

    def around(hit: Column) -> Column:
        """The pieces that a phrase with this one as its anchor can reach."""
        start = F.greatest(hit["pos"] - (most - 2), F.lit(1))
        return F.array_join(F.slice("_pieces", start, hit["pos"] + most - start + 1), " ")

    asked = F.transform("_hits", lambda h: F.struct(around(h).alias("at"), h["value"].alias("words")))
    held = F.transform(asked, lambda s: F.filter(s["words"], lambda w: F.contains(s["at"], w)))
    # outer, else Spark works the array out once more to see whether it is empty
    found = near.select(F.col(ROW_ID).alias("_id"), F.explode_outer(F.array_distinct(F.flatten(held))).alias("word"))
    return (
        found.join(phrases.select("word", "mapping"), "word")
        .groupBy("_id")
        .agg(
            F.collect_set("word").alias("_keys"),
            F.collect_set("mapping").alias("_conditions"),
        )
    )


def _joined_keys(rows: DataFrame, text_col: str, keys: DataFrame) -> DataFrame:
    """``_id, _keys, _conditions`` of the posts with a match, for large key tables.

    Every fragment of a distinct word that is as long as some key is joined with the keys,
    then posts look up the matching words.
    """
    lengths = keys.agg(F.sort_array(F.collect_set(F.length("word"))).alias("n")).first()["n"]
    words = F.array_distinct(F.regexp_extract_all(F.lower(text_col), F.lit(T.WORD), F.lit(0)))
    # the words are read four times below
    texts = stage(rows.select(F.col(ROW_ID), words.alias("_words")), "post-words")
    in_post = texts.select(F.explode("_words").alias("token"))

    def fragments(word: Column) -> Column:
        return F.array_distinct(
            F.flatten(
                F.transform(
                    F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(word)),
                    lambda n: F.transform(
                        F.sequence(F.lit(1), F.length(word) - n + 1), lambda i: word.substr(i, n)
                    ),
                )
            )
        )

    word_keys = (
        in_post.select("token")
        .distinct()
        .select("token", F.explode(fragments(F.col("token"))).alias("word"))
        .join(keys, "word")
        .groupBy("token")
        .agg(
            F.collect_set("word").alias("keys"),
            F.collect_set("mapping").alias("conditions"),
        )
        .select("token", F.struct("keys", "conditions").alias("value"))
    )
    # a word's keys are worked out once and written; the posts look their words up by blocks
    table = TokenTable.joined(stage(word_keys, "word-keys"), unique=True)
    hits = annotate_tokens(texts, F.col("_words"), table, "_hits", drop=("_words",)).where(F.size("_hits") > 0)

    def merged(name: str) -> Column:
        return F.array_sort(
            F.array_distinct(F.flatten(F.transform("_hits", lambda h: h["value"][name])))
        )

    return hits.select(
        F.col(ROW_ID).alias("_id"), merged("keys").alias("_keys"), merged("conditions").alias("_conditions")
    )
