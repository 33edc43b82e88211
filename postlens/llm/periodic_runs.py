"""Runs of periodically repeated words, found exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import WORD, byte_texts, slices
from postlens.llm.recompression import Grammar

MIN_LENGTH = 24
MIN_REPEATS = 3
#: Words that a candidate of the grid compares before its extensions are asked for.
PROBE = 8
#: Words that a task looks at together; a longer text is looked at alone.
BATCH_WORDS = 1 << 18
_GRID_CHUNK = 1 << 21
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SCHEMA = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _probes(names: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """A hash of the ``PROBE`` words from each position on; equal words give equal hashes."""
    mixed = (names.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(31)
    width = 1
    while width < PROBE:
        after = np.zeros_like(mixed)
        after[:-width] = mixed[width:]
        mixed = (mixed * np.uint64(0xD6E8FEB86659FD93)) ^ (after * np.uint64(0xA0761D6478BD642F))
        mixed ^= mixed >> np.uint64(29)
        width *= 2
    return mixed ^ (owner.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB))


def _grid(n: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidates ``(position, period)`` of the periods from ``low`` to below ``high``.

    Each period has a position every ``max(PROBE, period)`` words. A run of period q and at least
    max(24, 3q) words matches itself q words on over max(24 - q, 2q) words, which holds
    a position of the grid with PROBE matching words behind it.
    """
    periods = np.arange(low, high)
    step = np.maximum(PROBE, periods)
    count = np.maximum(0, (n - PROBE - periods) // step + 1)
    period = np.repeat(periods, count)
    nth = np.arange(len(period)) - np.repeat(np.cumsum(count) - count, count)
    return nth * np.repeat(step, count), period


def _candidates(probes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The candidates of one text whose probes are equal, by rising period, in bounded pieces."""
    n = len(probes)
    most = n // MIN_REPEATS
    low = 1
    while low <= most:
        high = min(most + 1, low + max(1, _GRID_CHUNK * max(low, PROBE) // n))
        at, period = _grid(n, low, high)
        hit = probes[at] == probes[at + period]
        yield at[hit], period[hit]
        low = high


def _repeating(probes: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """Numbers of the texts that have some probe twice; no other text can have a run."""
    order = np.argsort(probes, kind="stable")
    twice = probes[order][1:] == probes[order][:-1]
    some = np.zeros(texts, bool)
    some[owner[order][1:][twice]] = True
    return np.flatnonzero(some)


def _open(at: np.ndarray, period: np.ndarray, known: list[np.ndarray], n: int) -> np.ndarray:
    """False for candidates inside a long known run whose period divides theirs.

    They extend to that very run. Only runs over a 64th of the text are looked at.
    """
    new = np.ones(len(at), bool)
    for rows in known:
        for start, length, own in rows[64 * rows[:, 1] >= n].tolist():
            inside = (at >= start) & (at + period < start + length)
            new &= ~(inside & (period % own == 0))
    return new


def _smallest_periods(rows: np.ndarray) -> np.ndarray:
    """One row per stretch: several periods of one stretch are multiples of the smallest."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[fresh]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def find_runs(texts: list[list[bytes]]) -> list[np.ndarray]:
    """Per text its runs ``(start, length, period)``, sorted by start, then period.

    A run is a stretch of words with smallest period q, at least 24 and 3q words long, that
    cannot be extended with that period. All texts share one grammar; a word that
    occurs nowhere else ends each.
    """
    names: dict[bytes, int] = {}
    sizes = np.array([len(t) for t in texts], np.int64)
    flat = np.fromiter((names.setdefault(w, len(names)) for t in texts for w in t), np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    offset = np.cumsum(sizes) - sizes
    probes = _probes(flat, owner)
    parts, pending, length = [], [], 0
    for t in _repeating(probes, owner, len(texts)).tolist():
        own = slice(offset[t], offset[t] + sizes[t])
        parts += [flat[own], np.array([len(names) + t])]
        pending.append((t, length, _candidates(probes[own])))
        length += int(sizes[t]) + 1
    found: list[list[np.ndarray]] = [[] for _ in texts]
    grammar = Grammar.build(np.concatenate(parts)) if parts else None
    mirrored = grammar.mirrored() if grammar else None
    while pending:
        asked, still = [], []
        for t, base, pieces in pending:
            piece = next(pieces, None)
            if piece is None:
                continue
            still.append((t, base, pieces))
            at, period = piece
            new = _open(at, period, found[t], sizes[t])
            asked.append((t, base, at[new] + base, period[new]))
        pending = still
        asked = [a for a in asked if len(a[2])]
        if not asked:
            continue
        one = np.concatenate([a[2] for a in asked])
        period = np.concatenate([a[3] for a in asked])
        ahead = grammar.extension(one, one + period)
        back = mirrored.extension(length - one, length - one - period)
        rows = np.stack([one - back, ahead + back + period, period], axis=1)
        enough = rows[:, 1] >= np.maximum(MIN_LENGTH, MIN_REPEATS * period)
        ends = np.cumsum([len(a[2]) for a in asked])
        for (t, base, at, _), end in zip(asked, ends.tolist(), strict=True):
            own = slice(end - len(at), end)
            kept = rows[own][enough[own]] - np.array([base, 0, 0])
            if len(kept):
                found[t].append(_smallest_periods(kept))
    none = np.empty((0, 3), np.int64)
    return [_smallest_periods(np.concatenate([none, *own])) for own in found]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """False for the words that some run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:-1]) == 0


def _described(words: list[list[bytes]]) -> tuple[list[int], list[list[dict]], list[bytes]]:
    found = find_runs(words)
    runs = [
        [dict(zip(("start", "length", "period"), r, strict=True)) for r in own.tolist()]
        for own in found
    ]
    collapsed = []
    for text, own in zip(words, found, strict=True):
        if len(own):
            text = [text[i] for i in np.flatnonzero(kept_words(len(text), own))]
        collapsed.append(b" ".join(text))
    return [len(t) for t in words], runs, collapsed


def _groups(batches, column: str) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Pieces of the batches with about ``BATCH_WORDS`` words each."""
    for batch in slices(batches):
        texts = [t.split() for t in byte_texts(batch.column(column))]
        begin = held = 0
        for i, words in enumerate(texts):
            if i > begin and held + len(words) > BATCH_WORDS:
                yield batch.slice(begin, i - begin), texts[begin:i]
                begin, held = i, 0
            held += len(words)
        yield batch.slice(begin), texts[begin:]


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_words, runs, collapsed`` for each row: all runs, and the text without repeats.

    Words are what lies between ASCII white space. ``runs`` is sorted by start, then period.
    ``collapsed`` joins the words that no run holds after its first period by one
    blank. A null or empty text has no words, no runs and an empty ``collapsed``; ids
    may repeat or be null, every row is looked at on its own. Only the two named columns are
    read, so other columns do not matter. No shuffle; an empty table gives no rows.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def found(batches):
        for batch, words in _groups(batches, "text"):
            n_words, runs, collapsed = _described(words)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(n_words, pa.int64()),
                    pa.array(runs, pa.list_(_RUN)),
                    pa.array(collapsed, pa.binary()).cast(pa.string()),
                ],
                ["id", "n_words", "runs", "collapsed"],
            )

    return rows.mapInArrow(found, f"id {kind}, {SCHEMA}")


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; ties: start, then period.

    Null if there is none. ``runs`` is sorted by start and period, so the first of equals stays.
    """

    def better(best: Column, run: Column) -> Column:
        wide = lambda a, b: a.cast("decimal(19,0)") * b.cast("decimal(19,0)")
        beats = wide(run["length"], best["period"]) > wide(best["length"], run["period"])
        return F.when(best.isNull() | beats, run).otherwise(best)

    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    return F.aggregate(runs, none, better)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))


def repeated(words: Column, start: Column, period: Column) -> Column:
    """``words`` joined by blanks, those from ``start`` on repeating every ``period`` words."""
    source = lambda i: F.when(i < start, i).otherwise(start + (i - start) % period)
    return F.array_join(
        F.transform(words, lambda w, i: F.get(words, source(i).cast("int"))), " "
    )


def as_text(runs: Column) -> Column:
    """One line ``start,length,period`` for each run."""
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    return F.array_join(F.transform(runs, lambda r: F.concat(line(r), F.lit("\n"))), "")
