"""Secret scans: spans of likely credentials, told from copied examples by who owns them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlens.sources.staging import stage

# The kinds in the order in which they are listed, and their patterns.
ASSIGN = (
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"""
    r"""|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
# A run that is long enough is the whole run: a shorter one has no long one inside.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
# Candidates that the method adds: only who owns them can tell them from names and examples.
# Every repetition has a bound or a class of its own, so a search takes linear time.
PREFIXED = (
    r"(github_pat_|gh[opsur]_|glpat-|[rs]k_live_|sk-|npm_|xox[abprs]-|AIza)[A-Za-z0-9_-]{16,}"
)
DOTTED = r"eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
LOGIN = r"[a-z][a-z0-9+.-]{1,15}://[^\x00-\x20:/@]{1,64}:[^\x00-\x20:/@]{6,128}@[A-Za-z0-9.-]{1,255}"
PEM = (
    r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\x09-\x0D\x20]{16,}"
    r"-----END [A-Z ]{0,20}PRIVATE KEY-----"
)
# Whole runs: short ones are "mixed", those from MIN_OPAQUE characters on "opaque".
RUN = r"[A-Za-z0-9+/_-]{12,}"
KINDS = ("assign", "access", "hex", "prefixed", "dotted", "login", "pem", "mixed", "opaque")
PATTERNS = (ASSIGN, ACCESS, HEX, PREFIXED, DOTTED, LOGIN, PEM, RUN)
#: What a text must contain for a pattern to be worth a search.
NEEDS = {4: "eyJ", 5: "://", 6: "PRIVATE KEY-----"}
BASE_KINDS, SHAPED_KINDS, MIXED_KIND, OPAQUE_KIND = 3, 7, 7, 8
MIN_ASSIGNED, MIN_OPAQUE = 12, 20
#: Bits for each character that a mixed string has at least; words and dates have fewer.
MIN_ENTROPY = 3.0
#: Characters of an opaque string for each "/", "_", "+" or "-" in it; paths and slugs have fewer.
CHARS_PER_JOINT = 7
_HIT = "array<struct<kind:int,nth:int,gap:int,value:string>>"
_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _hits(text: Column, kind: int) -> Column:
    """Leftmost matches of a kind with the lengths of the pieces of text before them."""
    pattern = PATTERNS[kind]
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    hits = F.transform(
        F.arrays_zip(gaps.alias("gap"), found.alias("value")),
        lambda s, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("nth"), s["gap"].alias("gap"), s["value"].alias("value")
        ),
    )
    asked = text.rlike(pattern)
    asked = F.contains(text, F.lit(NEEDS[kind])) & asked if kind in NEEDS else asked
    return F.when(asked, F.filter(hits, lambda s: s["value"].isNotNull())).otherwise(F.array().cast(_HIT))


def entropy(value: Column) -> Column:
    """Bits for each character of a string, by how often it has each of its characters."""
    size = F.length(value)
    times = lambda c: size - F.length(F.replace(value, c, F.lit("")))
    each = F.transform(F.array_distinct(F.split(value, "")), lambda c: times(c) * F.log2(times(c)))
    return F.log2(size) - F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / size


def _counts(kind: Column, value: Column) -> Column:
    """Whether a match of a kind is a span or candidate at all."""
    assigned = F.length(F.regexp_extract(value, ASSIGN, 2)) >= MIN_ASSIGNED
    has = lambda c: value.rlike(c)
    joints = F.length(value) - F.length(F.translate(value, "+/_-", ""))
    mixed = has("[0-9]") & has("[a-z]") & has("[A-Z]") & (joints == 0) & (entropy(value) >= MIN_ENTROPY)
    opaque = has("[0-9]") & has("[A-Za-z]") & (joints * CHARS_PER_JOINT <= F.length(value))
    return (
        F.when(kind == 0, assigned).when(kind == MIXED_KIND, mixed).when(kind == OPAQUE_KIND, opaque)
        .otherwise(True)
    )


def placed_spans(scanned: DataFrame) -> DataFrame:
    """``scanned(row, hits, ...)`` as a row per span with ``start`` and ``end``.

    Starts are running sums over the matches of a text and kind, ends of what stands before and
    after them running extremes: a text with very many matches is work in proportion. A candidate
    that touches a base span is dropped, and so is a mixed or opaque one that
    touches a shaped one. ``rank`` orders the three.
    """
    rows = scanned.select(*[c for c in scanned.columns if c != "hits"], F.inline("hits"))
    by_kind = Window.partitionBy("row", "kind").orderBy("nth")
    rows = rows.withColumn("size", F.length("value"))
    end = F.sum(F.col("gap") + F.col("size")).over(by_kind).cast("int")
    rows = rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("size"))
    opaque = (F.col("kind") == MIXED_KIND) & (F.col("size") >= MIN_OPAQUE)
    rows = rows.withColumn("kind", F.when(opaque, OPAQUE_KIND).otherwise(F.col("kind")))
    rows = rows.where(_counts(F.col("kind"), F.col("value"))).drop("nth", "gap", "size")
    rank = F.when(F.col("kind") < BASE_KINDS, 0).when(F.col("kind") < SHAPED_KINDS, 1).otherwise(2)
    rows = rows.withColumn("rank", rank)
    # both run from one end: a frame that ends at the last row would be summed anew for each row
    up_to_here = (Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("row").orderBy("start").rangeBetween(*up_to_here)
    after = Window.partitionBy("row").orderBy(F.desc("start")).rangeBetween(*up_to_here)

    def touched(rank: int) -> Column:
        own = F.col("rank") == rank
        left = F.max(F.when(own, F.col("end"))).over(before) > F.col("start")
        right = F.min(F.when(own, F.col("start"))).over(after) < F.col("end")
        return F.coalesce(left, F.lit(False)) | F.coalesce(right, F.lit(False))

    rows = rows.withColumns({"by_base": touched(0), "by_shaped": touched(1)})
    free = (F.col("rank") == 0) | (~F.col("by_base") & ((F.col("rank") == 1) | ~F.col("by_shaped")))
    return rows.where(free).drop("by_base", "by_shaped")


def joined(spans: Column) -> Column:
    """``kind:start:end`` by start and kind, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(
            spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])
        ),
        ",",
    )


def secret_scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner: Column | None = None,
    repository: Column | None = None,
    live_owners: int = 1,
    live_repositories: int = 3,
) -> DataFrame:
    """Base spans of each text and the candidates that ownership shows as live credentials.

    Returns, for each row, its ``id``, the arrays ``base`` and ``added`` of (start, kind, end,
    value), and ``n_live`` and ``n_example``, which count all spans and candidates by the
    verdict on their value: a value is live if at most ``live_owners`` owners and
    ``live_repositories`` repositories of the corpus hold it, else a copied example. Base spans
    stay whatever the verdict; candidates (tokens by their prefix or shape, logins in addresses,
    private keys, and strings that look random) are added only if live. By default the owner is
    ``source`` and the repository ``source`` and ``lang``; nulls are one owner, one repository.

    Candidates are hashed (SHA-256) and made distinct by (hash, repository, owner) before they are
    counted, so a value that a third of the corpus holds arrives once for each task. Texts are
    scanned once and never shuffled: the matches are a written table. A null text is empty.
    Rows are told apart by numbers of their own, so ids may repeat or be null; only the named
    columns are read. An empty table gives no rows.
    """
    owner = F.col("source") if owner is None else owner
    repository = F.struct("source", "lang") if repository is None else repository
    text = F.coalesce(F.col(text_col), F.lit(""))
    scanned = docs.select(
        F.col(id_col).alias("id"), owner.alias("owner"), repository.alias("repository"), text.alias("text")
    )
    hits = F.concat(*[_hits(F.col("text"), k) for k in range(len(PATTERNS))])
    scanned = scanned.select("id", "owner", "repository", hits.alias("hits"))
    scanned = stage(scanned.withColumn("row", F.monotonically_increasing_id()), "hits")
    spans = placed_spans(scanned.where(F.size("hits") > 0).drop("id"))
    secret = F.when(
        F.col("kind") == 0, F.regexp_extract("value", ASSIGN, 2)
    ).otherwise(F.col("value"))
    spans = stage(spans.withColumn("hash", F.sha2(secret, 256)), "spans")
    held = spans.select("hash", "repository", "owner").distinct()
    owners = held.groupBy("hash", "owner").agg(F.count("*").alias("repositories"))
    owners = owners.groupBy("hash").agg(
        F.count("*").alias("owners"), F.sum("repositories").alias("repositories")
    )
    live = (F.col("owners") <= live_owners) & (F.col("repositories") <= live_repositories)
    verdicts = spans.join(owners.select("hash", live.alias("live")), "hash")
    span = F.struct("start", "kind", "end", "value")
    listed = lambda test: F.array_sort(F.collect_list(F.when(test, span)))
    verdicts = verdicts.groupBy("row").agg(
        listed(F.col("rank") == 0).alias("base"),
        listed((F.col("rank") > 0) & F.col("live")).alias("added"),
        F.count_if("live").alias("n_live"),
        F.count_if(~F.col("live")).alias("n_example"),
    )
    none = F.array().cast(_SPAN)
    return scanned.select("row", "id").join(verdicts, "row", "left").select(
        "id",
        F.coalesce("base", none).alias("base"),
        F.coalesce("added", none).alias("added"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"),
        F.coalesce("n_example", F.lit(0)).alias("n_example"),
    )


def _last_end(done: Column) -> Column:
    return F.coalesce(F.get(done, F.size(done) - 1)["end"], F.lit(0))


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with each span, overlapping ones as one, replaced by a mark."""
    merged = F.aggregate(
        F.array_sort(spans),
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda done, s: F.when(
            s["start"] < _last_end(done),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(
                    F.struct(
                        F.get(done, F.size(done) - 1)["start"].alias("start"),
                        F.greatest(_last_end(done), s["end"]).alias("end"),
                    )
                ),
            ),
        ).otherwise(F.concat(done, F.array(F.struct(s["start"], s["end"])))),
    )
    starts = F.concat(F.array(F.lit(0)), F.transform(merged, lambda s: s["end"]))
    ends = F.concat(F.transform(merged, lambda s: s["start"]), F.array(F.length(text)))
    pieces = F.transform(
        F.arrays_zip(starts.alias("a"), ends.alias("b")),
        lambda p: F.substr(text, p["a"] + 1, p["b"] - p["a"]),
    )
    return F.when(F.size(spans) > 0, F.array_join(pieces, mark)).otherwise(text)
