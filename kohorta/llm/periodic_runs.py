"""Periodic runs of words, found by string synchronising sets at dyadic scales.

A run is a stretch of words with smallest period q (words q apart are identical) and at least ``exponent * q`` and
``least`` words, which no neighbouring word extends keeping the period.  The texts of an Arrow batch are laid end
to end, each closed by a mark that occurs once, so that no run crosses documents.

*Scale t* (2, 4, 8, ...) serves the periods from 2t to 4t - 1.  A position is synchronising if, among the hashes of
the strings of t words that start in the t + 1 positions from it on, the least is the first's or the last's.  That
depends on its next 2t words only, and any t + 1 positions hold one.  Each synchronising position is paired with the
next one that has equal 4t words before it: their distance is proposed as a period.  In a run with
smallest period p in that range some position s >= start + t, s <= start + 2t is synchronising, s + p has
the same 4t words, and no position between has, as 4t words are more than p.

*Highly periodic regions* would make every position synchronising.  Periods 1 to 3 are found by comparing words
directly, and a position is left out at scale t if the words from t before it to 4t after it lie in a known run with
a period of t at most.  Two periods p < 4t and q <= t can't share those 5t words (Fine and Wilf), so the s and s + p of
the last paragraph are never left out; and such a run has 5q words, so it is known by then.

Proposals are verified on the words themselves and extended as far as they go, and one whose period is a multiple of
a smaller one goes; so hashes (64 bits) decide what is looked at, never what is a run.  ``exponent`` is 4 or more,
which the proof needs.

Defined results: null and empty texts have no words and no runs; rows are judged by themselves, equal ids or not; ids
of any type pass through, null too; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import frugal, let, slices, small_batches, words_of

LEAST, EXPONENT = 6, 4
#: Periods that are found by comparing words directly.
SMALL = (1, 2, 3)
#: Bytes of text that are laid end to end, or one text.
TEXT_BYTES = 2 << 20
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _shifted(x: np.ndarray, by: int, fill: int = 0) -> np.ndarray:
    return np.r_[x[by:], np.full(min(by, len(x)), fill, dtype=x.dtype)]


def _doubled(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of strings of twice the size from those of ``size``."""
    return _mixed(h * np.uint64(0x9E3779B97F4A7C15) + _shifted(h, size) + np.uint64(size))


def synchronising(h: np.ndarray, t: int) -> np.ndarray:
    """The positions that scale ``t`` selects; ``h``: the hashes of the strings of ``t`` symbols."""
    least, size = h, 1
    top = np.iinfo(np.uint64).max
    while size < t:
        least = np.minimum(least, _shifted(least, size, top))
        size *= 2
    last = _shifted(h, t, top)
    return np.flatnonzero(np.minimum(least, last) == np.minimum(h, last))


def _extent(w: np.ndarray, at: int, p: int) -> tuple[int, int]:
    """The longest stretch (start, end) around ``at`` whose words recur ``p`` later."""
    end, step = at, 256
    while end + p < len(w):
        same = w[end : end + step]
        other = w[end + p : end + p + step]
        differ = np.flatnonzero(same[: len(other)] != other)
        if len(differ):
            end += int(differ[0])
            break
        end, step = end + len(other), step * 2
    start, step = at, 256
    while start > 0:
        low = max(0, start - step)
        differ = np.flatnonzero(w[low:start] != w[low + p : start + p])
        if len(differ):
            start = low + int(differ[-1]) + 1
            break
        start, step = low, step * 2
    return start, end + p


def _smallest(w: np.ndarray, start: int, p: int) -> bool:
    """Whether no divisor of ``p`` is a period of the stretch with period ``p`` at ``start``."""
    rest, f = p, 2
    while rest > 1:
        if rest % f == 0:
            q = p // f
            if np.array_equal(w[start : start + p], w[start + q : start + q + p]):
                return False
            while rest % f == 0:
                rest //= f
        f = f + 1 if f * f <= rest else max(rest, f + 1)
    return True


def _small_runs(w: np.ndarray, p: int, least: int) -> list[tuple[int, int, int]]:
    same = np.zeros(len(w) + 2, dtype=np.int8)
    same[1 : len(w) - p + 1] = w[:-p] == w[p:]
    edges = np.flatnonzero(np.diff(same))
    start, end = edges[::2], edges[1::2] + p
    found = np.flatnonzero(end - start >= least)
    return [(int(a), int(b), p) for a, b in zip(start[found], end[found], strict=True) if _smallest(w, int(a), p)]


def find_runs(words: np.ndarray, bounds: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> np.ndarray:
    """(text, start, length, period) of all runs, sorted; ``words``: numbers (0 or more) of the words of texts end to end."""
    if exponent < 4:
        raise ValueError(f"the exponent must be 4 or more; got {exponent}")
    sizes = np.diff(bounds)
    n = len(sizes)
    text = np.repeat(np.arange(n), sizes)
    w = np.empty(len(words) + n, dtype=np.int64)
    w[np.arange(len(words)) + text] = words
    first = bounds[:-1] + np.arange(n)  # of each text in w
    w[first + sizes] = -1 - np.arange(n)
    found: list[tuple[int, int, int]] = []
    for p in SMALL:
        if len(w) > p:
            found += _small_runs(w, p, max(least, exponent * p))
    longest = int(sizes.max()) if n else 0
    t = (SMALL[-1] + 1) // 2
    if longest < 2 * exponent * t:
        return _by_text(found, first)
    place = np.arange(len(w))
    size = np.repeat(sizes, sizes + 1)
    h = _doubled(_mixed(w.view(np.uint64) + np.uint64(0x632BE59BD9B4E019)), 1)
    h2 = _doubled(h, 2)
    while longest >= 2 * exponent * t:
        active = size >= 2 * exponent * t  # texts that can hold a run with a period of this scale
        if not active.all():
            place, size, h, h2 = place[active], size[active], h[active], h2[active]
        h4 = _doubled(h2, 2 * t)
        at = synchronising(h, t)
        s, context = place[at], h4[at]
        known = [(a + t, b - 4 * t) for a, b, p in found if p <= t and b - a >= 5 * t]
        if known:
            low, high = np.sort(np.array(known), axis=0).T
            out = np.searchsorted(low, s, side="right") > np.searchsorted(high, s, side="left")
            s, context = s[~out], context[~out]
        order = np.argsort(context, kind="stable")
        s, context = s[order], context[order]
        gap = s[1:] - s[:-1]
        pair = np.flatnonzero((context[1:] == context[:-1]) & (gap >= 2 * t) & (gap < 4 * t))
        a, p = s[pair], gap[pair]
        order = np.lexsort((a, p))
        a, p = a[order], p[order]
        new = np.r_[True, (p[1:] != p[:-1]) | (a[1:] > a[:-1] + 4 * t)] if len(a) else np.zeros(0, dtype=bool)
        seen = (0, 0)  # a period and where its last stretch ended
        for at_, p_ in zip(a[new].tolist(), p[new].tolist(), strict=True):
            if p_ == seen[0] and at_ + p_ < seen[1]:
                continue
            start, end = _extent(w, at_, p_)
            seen = (p_, end)
            if end - start >= max(least, exponent * p_) and _smallest(w, start, p_):
                found.append((start, end, p_))
        h, h2, t = h2, h4, 2 * t
    return _by_text(found, first)


def _by_text(found: list[tuple[int, int, int]], first: np.ndarray) -> np.ndarray:
    if not found:
        return np.zeros((0, 4), dtype=np.int64)
    start, end, period = np.unique(np.array(found, dtype=np.int64), axis=0).T
    text = np.searchsorted(first, start, side="right") - 1
    return np.c_[text, start - first[text], end - start, period]


@frugal
def _runs_of(batches: Iterator[pa.RecordBatch], least: int, exponent: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", TEXT_BYTES):
        texts = [(x or b"").split() for x in batch.column("text").cast(pa.binary()).to_pylist()]  # parts at ASCII white space
        bounds = np.r_[0, np.cumsum([len(x) for x in texts])].astype(np.int64)
        numbers: dict[bytes, int] = {}
        fresh = count()
        words = np.fromiter((number for x in texts for number in map(numbers.setdefault, x, fresh)), dtype=np.int64, count=int(bounds[-1]))
        del numbers
        runs = find_runs(words, bounds, least, exponent)
        ends = np.searchsorted(runs[:, 0], np.arange(len(texts) + 1))
        collapsed = []
        for i, x in enumerate(texts):
            own = runs[ends[i] : ends[i + 1]]
            if len(own):
                stays = np.ones(len(x), dtype=bool)
                for start, length, period in own[:, 1:].tolist():
                    stays[start + period : start + length] = False
                x = [x[j] for j in np.flatnonzero(stays).tolist()]
            collapsed.append(b" ".join(x))
        struct = pa.StructArray.from_arrays([pa.array(runs[:, j]) for j in (1, 2, 3)], ["start", "length", "period"])
        listed = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), struct)
        n_words = pa.array(np.diff(bounds))
        yield pa.RecordBatch.from_arrays([batch.column("id"), n_words, listed.cast(RUNS), pa.array(collapsed, pa.binary()).cast(pa.string())], ["id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """(``key``, n_words, runs, collapsed) of every row.

    ``runs``: the runs' start, length and period in words, by start, then period; ``collapsed``: the words that no run
    holds after its first period, joined by one space.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    made = rows.mapInArrow(
        lambda it: _runs_of(it, least, exponent), f"id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    )
    return made.select(F.col("id").alias(key), "n_words", "runs", "collapsed")


def longest_run(runs: Column) -> Column:
    """Of an array of runs the one of greatest length; of equal ones the first by start, then period; null if there is none."""
    longest = F.array_max(F.transform(runs, lambda r: r["length"]))
    return let(longest, lambda n: F.get(F.filter(runs, lambda r: r["length"] == n), F.lit(0)))


def runs_digest(runs: Column) -> Column:
    """SHA-256 of one line ``start,length,period`` for each run."""
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return F.sha2(F.concat_ws("", lines), 256)


def with_planted_runs(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(``key``, text): a tenth of the documents, chosen by their ids' checksum, repeat a stretch of words up to the end.

    With h the checksum of the decimal id and g = h div 10, where h mod 10 = 0 every word i >= a = g mod n becomes word
    a + (i - a) mod p, with p = 1 + (n - a) div (3 + g mod 8).  Other texts, those of null ids and texts without words stay.
    """
    h = F.crc32(F.col(key).cast("string"))
    g = F.floor(h / 10)

    def planted(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        period = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
        at = let(F.struct(a.alias("a"), period.alias("p")), lambda x: F.transform(
            F.sequence(F.lit(0), n - 1), lambda i: F.get(words, F.when(i < x["a"], i).otherwise(x["a"] + (i - x["a"]) % x["p"]))
        ))
        return F.when(n > 0, F.array_join(at, " ")).otherwise(F.lit(""))

    made = F.when(h % 10 == 0, let(words_of(F.coalesce(F.col(text), F.lit(""))), planted)).otherwise(F.col(text))
    return docs.select(F.col(key), made.alias("text"))
