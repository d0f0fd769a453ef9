"""Removal of long repeated strings (exact substring deduplication), counted in bytes or in words.

A text is a row of symbols: its bytes, or its words (longest runs of other characters than ASCII white space,
which parts them and doesn't count).  A symbol goes when some string of ``length`` symbols that covers it also
starts anywhere else in the collection, the same document included.  Strings never cross documents and are
judged on the input.  With a word goes the white space after it.

How it works.  Every window of ``length`` symbols chooses an *anchor*: the leftmost of its strings of ``gram``
symbols with the least hash.  The choice depends on the window's symbols only, so equal windows choose
anchors with equal symbols at equal offsets.  Consecutive windows with the same anchor form a *run*, about
``(length - gram) / 2`` windows long, and only runs are shuffled, not positions:

1. runs are keyed by the anchor's hash and by a hash of all symbols that the run covers; a key found twice
   means that every window of those runs is repeated;
2. where an anchor's symbols occur in runs with different symbols (the ends of a repeated passage, an edited
   word), one run for each key gives its windows, which are hashed and compared by themselves.

The columns of the anchors' contexts are thus merged as whole spans rather than one symbol a round; the
README says why the column-wise construction, which ``columnwise`` holds, cannot be run over a whole corpus.
Hashes have 64 bits; runs are compared below an anchor hash of 64 more.

Defined results: null and empty texts have no symbols and lose none; repeated rows are documents of their own, so
that their symbols repeat (rows that are equal in id and text share their spans); the kept bytes are decoded
without what is left of characters that were cut; other columns pass through; ids may be of any type.

A report can also count the words that repeated strings of words cover, beside what it removes: a passage of 50 words
often has fewer bytes than a string counted in bytes must have.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, frugal, joined_bytes, shared_dir, shuffles_dropped, slices, small_batches, whole_text

#: Lengths of strings and of anchors: in bytes, and in words.
LENGTH, GRAM = 400, 220
WORDS, WORD_GRAM = 50, 20
BYTE_UNIT, WORD_UNIT = "byte", "word"
#: Columns of a report that counts repeated words too.
PASSAGES = ("n_repeat_words", "n_passages")
#: Bytes of text handled at once; also the most symbols of one document.
PIECE = 1 << 18
#: Longer words are hashed one by one.
LONG_WORD = 1 << 10
_BASE = 0x9E3779B97F4A7C15
_POS_BITS = 22


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xA24BAED4963EE407)
    return h ^ (h >> np.uint64(32))


class Hasher:
    """Polynomial hashes of any string of a piece's symbols, modulo 2**64; ``value`` has bytes' random values."""

    def __init__(self, size: int = PIECE + 1):
        self.value = np.random.default_rng(20240607).integers(0, 2**64, 256, dtype=np.uint64)
        self.power = self._powers(_BASE, size)
        self.inverse = self._powers(pow(_BASE, -1, 2**64), size)

    @staticmethod
    def _powers(base: int, size: int) -> np.ndarray:
        out = np.full(size, base, dtype=np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def load(self, symbols: np.ndarray) -> np.ndarray:
        """Running sums of symbols: of bytes, or of words' hashes."""
        sums = np.zeros(len(symbols) + 1, dtype=np.uint64)
        values = self.value[symbols] if symbols.dtype == np.uint8 else symbols
        np.cumsum(values * self.power[: len(symbols)], out=sums[1:])
        return sums

    def at(self, sums: np.ndarray, start: np.ndarray, length) -> np.ndarray:
        return _mix((sums[start + length] - sums[start]) * self.inverse[start])


def _sliding_least(key: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` consecutive keys, by block-wise running minima from both sides."""
    n = len(key)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = key
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def runs(hasher: Hasher, data: np.ndarray, bounds: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Runs of windows with one anchor over documents' symbols laid end to end.

    ``bounds``: the documents' first symbols and the end.  Returns arrays (document, first window's start,
    windows, anchor hash, span hash), in order.
    """
    none = np.zeros(0, dtype=np.int64)
    if len(data) < length:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    sums = hasher.load(data)
    sizes = np.diff(bounds)
    at = np.arange(len(data) - gram + 1, dtype=np.int64)
    grams = hasher.at(sums, at, gram)
    mask = np.uint64((1 << _POS_BITS) - 1)
    least = _sliding_least((grams & ~mask) | at.view(np.uint64), length - gram + 1)
    anchor = (least & mask).astype(np.int64)
    valid = np.zeros(len(data) + 1, dtype=np.int32)
    full = sizes >= length
    np.add.at(valid, bounds[:-1][full], 1)
    np.add.at(valid, bounds[1:][full] - length + 1, -1)
    start = np.flatnonzero(np.cumsum(valid)[: len(anchor)])
    if not len(start):
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    chosen = anchor[start]
    new = np.flatnonzero(np.r_[True, (chosen[1:] != chosen[:-1]) | (np.diff(start) != 1)])
    first, count = start[new], np.diff(np.r_[new, len(start)])
    a = chosen[new]
    span = hasher.at(sums, first, count + length - 1)
    span = _mix(span ^ ((a - first).astype(np.uint64) << np.uint64(32)) ^ count.astype(np.uint64))
    doc = np.searchsorted(bounds, first, side="right") - 1
    return doc, first - bounds[doc], count.astype(np.int64), grams[a], span


_hasher: list[Hasher] = []


def hasher() -> Hasher:
    """One a worker process."""
    if not _hasher:
        _hasher.append(Hasher())
    return _hasher[0]


def word_places(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first bytes, ends, bounds in words) of the words of documents' bytes laid end to end."""
    black = (data != 0x20) & ((data < 0x09) | (data > 0x0D))
    new = np.r_[True, ~black[:-1]] if len(data) else black
    new[bounds[:-1][bounds[:-1] < len(data)]] = True
    last = np.r_[~black[1:], True] if len(data) else black
    last[bounds[1:][bounds[1:] > 0] - 1] = True
    first, end = np.flatnonzero(black & new), np.flatnonzero(black & last) + 1
    return first, end, np.searchsorted(first, bounds)


def word_hashes(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the words between bytes ``first`` and ``end``."""
    out = np.empty(len(first), dtype=np.uint64)
    done = 0
    while done < len(first):  # as many words as fit a piece
        to = max(done + 1, int(np.searchsorted(end, first[done] + PIECE, side="right")))
        a, b = first[done:to], end[done:to]
        short = np.flatnonzero(b - a <= LONG_WORD)
        if len(short):
            low, high = a[short[0]], b[short[-1]]
            out[done + short] = hasher().at(hasher().load(data[low:high]), a[short] - low, (b - a)[short])
        for i in np.flatnonzero(b - a > LONG_WORD).tolist():
            out[done + i] = int.from_bytes(blake2b(data[a[i] : b[i]].tobytes(), digest_size=8).digest(), "little")
        done = to
    return out


def _pieces(batches: Iterator[pa.RecordBatch], length: int, unit: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, int]]:
    """(rows, their symbols, bounds, symbols before): whole documents, or one that is cut into overlapping pieces."""
    for batch in slices(batches, "text", PIECE):
        data, bounds = joined_bytes(batch.column("text"))
        if unit == WORD_UNIT:
            first, end, bounds = word_places(data, bounds)
            data = word_hashes(data, first, end)
        if len(data) <= PIECE:
            yield batch, data, bounds, 0
        else:
            for at in range(0, len(data) - length + 1, PIECE - length + 1):
                piece = data[at : at + PIECE]
                yield batch, piece, np.array([0, len(piece)]), at


@frugal
def _runs(batches: Iterator[pa.RecordBatch], length: int, gram: int, unit: str) -> Iterator[pa.RecordBatch]:
    """One row for each document and span; where a document has a span several times (periodic text), ``more`` has the other starts."""
    for batch, data, bounds, before in _pieces(batches, length, unit):
        doc, start, count, anchor, span = runs(hasher(), data, bounds, length, gram)
        order = np.lexsort((start, span, doc))
        doc, start, count, anchor, span = (x[order] for x in (doc, start, count, anchor, span))
        new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (span[1:] != span[:-1])]) if len(doc) else doc
        size = np.diff(np.r_[new, len(doc)])
        rest = np.ones(len(doc), dtype=bool)
        rest[new] = False
        more = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size - 1)], pa.int32()), pa.array(start[rest] + before), mask=pa.array(size == 1))
        columns = [batch.column("k").take(pa.array(doc[new])), *map(pa.array, (start[new] + before, count[new], anchor[new].view(np.int64), span[new].view(np.int64)))]
        yield pa.RecordBatch.from_arrays([*columns, more], ["k", "start", "count", "anchor", "span", "more"])


@frugal
def _windows(batches: Iterator[pa.RecordBatch], length: int, unit: str) -> Iterator[pa.RecordBatch]:
    """Hashes of the windows of the wanted runs; those of runs that are repeated as a whole count as others' partners only."""
    for batch, data, bounds, before in _pieces(batches, length, unit):
        sums = hasher().load(data)
        wanted = batch.column("wanted")
        each = np.diff(wanted.offsets.to_numpy())
        fields = wanted.flatten().flatten()
        start, count, whole = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in fields)
        doc = np.repeat(np.arange(batch.num_rows), each)
        room = np.diff(bounds)[doc] - length + 1
        first, last = np.maximum(start - before, 0), np.minimum(start - before + count, room)
        keep = last > first
        doc, first, whole, n = doc[keep], first[keep], whole[keep], (last - first)[keep]
        row = np.repeat(np.arange(len(n)), n)
        at = first[row] + np.arange(len(row)) - np.r_[0, np.cumsum(n)][row]
        for i in range(0, len(row), 200_000):
            r, a = row[i : i + 200_000], at[i : i + 200_000]
            hashed = hasher().at(sums, bounds[doc[r]] + a, length)
            places = np.where(whole[r] > 0, -1, a + before)
            yield pa.RecordBatch.from_arrays([pa.array(hashed.view(np.int64)), batch.column("k").take(pa.array(doc[r])), pa.array(places)], ["hash", "k", "start"])


@frugal
def _twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by hash, those (k, start) whose hash occurs twice; only the last row is carried over."""
    last: tuple | None = None  # hash, k, start, whether found
    for batch in batches:
        if not batch.num_rows:
            continue
        h, k, start = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("hash", "k", "start"))
        same = h[1:] == h[:-1]
        twice = np.r_[False, same] | np.r_[same, False]
        out_k, out_start = [], []
        if last is not None and last[0] == h[0]:
            twice[0] = True
            if not last[3]:
                out_k.append(last[1])
                out_start.append(last[2])
        keep = twice & (start >= 0)
        found_k = np.r_[np.array(out_k, dtype=np.int64), k[keep]]
        found = np.r_[np.array(out_start, dtype=np.int64), start[keep]]
        own = found >= 0
        yield pa.RecordBatch.from_arrays([pa.array(found_k[own]), pa.array(found[own])], ["k", "start"])
        last = (h[-1], k[-1], start[-1], bool(twice[-1]))


def merged(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs of symbols that the spans cover."""
    if not len(first):
        return first, end
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(end[order])
    new = np.r_[True, first[1:] > reach[:-1]]
    last = np.r_[np.flatnonzero(new)[1:] - 1, len(first) - 1]
    return first[new], reach[last]


def _covered(spans: pa.Scalar, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of the maximal runs of symbols that a row's spans of strings cover."""
    if not spans.is_valid:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    first, count = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in spans.values.flatten())
    return merged(first, first + count + length - 1)


@frugal
def _cut(batches: Iterator[pa.RecordBatch], length: int, unit: str, with_text: bool, words: int | None = None) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", PIECE):
        n_bytes, removed, n_spans, digests, texts, n_words, n_passages = [], [], [], [], [], [], []
        spans = batch.column("spans")
        for row, text in enumerate(batch.column("text").to_pylist()):
            data = (text or "").encode()
            gone = 0
            kept = data
            first, end = _covered(spans[row], length)
            if len(first):
                if unit == WORD_UNIT:
                    starts, *_ = word_places(np.frombuffer(data, dtype=np.uint8), np.array([0, len(data)]))
                    places = np.r_[starts, len(data)]
                    first, end = places[first], places[end]
                gone = int((end - first).sum())
                kept = b"".join(data[a:b] for a, b in zip([0, *end.tolist()], [*first.tolist(), len(data)], strict=True))
            n_bytes.append(len(data))
            removed.append(gone)
            n_spans.append(len(first))
            if with_text:
                texts.append(kept.decode("utf-8", "ignore"))
            else:
                digests.append(sha256(kept).hexdigest())
            if words:
                first, end = _covered(batch.column("passages")[row], words)
                n_words.append(int((end - first).sum()))
                n_passages.append(len(first))
        counts = [pa.array(x, pa.int64()) for x in (n_bytes, removed, n_spans)]
        more = [pa.array(x, pa.int64()) for x in (n_words, n_passages)] if words else []
        rest = [i for i, name in enumerate(batch.schema.names) if name not in ("text", "spans", "passages")]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in rest), *counts, pa.array(texts if with_text else digests, pa.string()), *more],
            [*(batch.schema.names[i] for i in rest), "n_bytes", "n_removed", "n_spans", "kept_text" if with_text else "kept_sha256", *PASSAGES[: len(more)]],
        )


def repeated_spans(made: DataFrame, length: int = LENGTH, gram: int = GRAM, unit: str = BYTE_UNIT) -> DataFrame:
    """(k, spans) of rows (k, doc), ``doc`` being a struct with the field text: for each document with repeated windows, runs (start, count) of their starts.

    Anchors and spans are counted before anything is joined by them, so that a common passage is one row a task
    then; the joins that follow give back single runs, and adaptive execution can split their hot keys.  All runs go, with
    what was shuffled for them, once the busy ones are stored.
    """
    spark = made.sparkSession
    scratch = Scratch(spark)
    least = length if unit == BYTE_UNIT else 2 * length - 1  # bytes of the shortest text that holds a window
    texts = made.select("k", F.col("doc.text").alias("text")).where(F.octet_length("text") >= least)
    found = scratch.stored(
        texts.mapInArrow(lambda it: _runs(it, length, gram, unit), "k bigint, start bigint, count bigint, anchor bigint, span bigint, more array<bigint>"), "runs"
    )
    times = F.when(F.col("more").isNull(), 1).otherwise(F.size("more") + 1)
    anchors = found.groupBy("anchor").agg(F.sum(times).alias("n"), (F.min("span") < F.max("span")).alias("mixed")).where("n > 1").select("anchor", "mixed")
    with shuffles_dropped(spark):
        busy = scratch.stored(found.join(anchors, "anchor"), "busy")
    scratch.release("busy")
    groups = busy.groupBy("anchor", "span", "mixed").agg(F.sum(times).alias("n"), F.min(F.struct("k", "start", "count")).alias("one"))

    wanted = groups.where("mixed").select("one.*", (F.col("n") > 1).cast("int").alias("whole"))
    wanted = wanted.groupBy("k").agg(F.collect_list(F.struct("start", "count", "whole")).alias("wanted"))
    windows = made.join(wanted, "k").mapInArrow(lambda it: _windows(_flat(it), length, unit), "hash bigint, k bigint, start bigint")
    twice = windows.repartition("hash").sortWithinPartitions("hash", "k", "start").mapInArrow(_twice, "k bigint, start bigint")
    starts = F.concat(F.array("start"), F.coalesce("more", F.array().cast("array<bigint>")))
    whole = busy.join(groups.where("n > 1").select("anchor", "span"), ["anchor", "span"]).select("k", F.explode(starts).alias("start"), "count")
    spans = whole.unionByName(twice.select("k", "start", F.lit(1).cast("long").alias("count")))
    return spans.groupBy("k").agg(F.collect_set(F.struct("start", "count")).alias("spans"))


def _flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The fields of the struct ``doc`` as columns; both joins carry the whole struct, so that they share one shuffle of the texts."""
    for batch in batches:
        doc = batch.column("doc")
        rest = [n for n in batch.schema.names if n != "doc"]
        fields = [f.name for f in doc.type]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), *(doc.field(i) for i in range(len(fields)))], [*rest, *fields])


def _key(text: str, key: str):
    return F.xxhash64(F.col(key), whole_text(text))


def _spanned(docs: DataFrame, head, text: str, key: str, length: int, gram: int, unit: str, words: int | None = None) -> tuple[DataFrame, str]:
    """(doc, spans) of every row, ``doc`` being a struct of ``head`` and the text, and the type of ``head``; with ``words`` also passages, the spans in words."""
    if unit not in (BYTE_UNIT, WORD_UNIT):
        raise ValueError(f"unknown unit {unit!r}")
    if not 0 < gram <= length:
        raise ValueError(f"anchors of {gram} don't fit strings of {length}")
    shared_dir(docs.sparkSession)
    small_batches(docs.sparkSession)
    made = docs.select(_key(text, key).alias("k"), F.struct(head.alias("head"), whole_text(text).alias("text")).alias("doc"))
    joined = made.join(repeated_spans(made, length, gram, unit), "k", "left")
    if words:
        passages = repeated_spans(made, words, max(1, words * WORD_GRAM // WORDS), WORD_UNIT).withColumnRenamed("spans", "passages")
        joined = joined.join(passages, "k", "left")
    return joined.drop("k"), made.schema["doc"].dataType["head"].dataType.simpleString()


def removal_report(
    docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, gram: int = GRAM, unit: str = BYTE_UNIT, words: int | None = None
) -> DataFrame:
    """(``key``, n_bytes, n_removed, n_spans, kept_sha256) of every row.

    With ``words`` also n_repeat_words and n_passages: the words that are covered by strings of so many words which also
    start anywhere else, and the maximal runs of such words.  They remove nothing.
    """
    joined, kind = _spanned(docs, F.col(key), text, key, length, gram, unit, words)
    more = PASSAGES if words else ()
    schema = ", ".join([f"head {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string", *(f"{c} bigint" for c in more)])
    cut = joined.mapInArrow(lambda it: _cut(_flat(it), length, unit, False, words), schema)
    return cut.select(F.col("head").alias(key), "n_bytes", "n_removed", "n_spans", "kept_sha256", *more)


def without_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, gram: int = GRAM, unit: str = BYTE_UNIT) -> DataFrame:
    """``docs`` with the repeated symbols cut out of their texts."""
    joined, kind = _spanned(docs, F.struct(*[docs[c] for c in docs.columns if c != text]), text, key, length, gram, unit)
    done = joined.mapInArrow(lambda it: _cut(_flat(it), length, unit, True), f"head {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_text string")
    return done.select(*[F.col("kept_text").alias(text) if c == text else F.col(f"head.`{c}`").alias(c) for c in docs.columns])
