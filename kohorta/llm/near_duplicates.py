"""Near-duplicate classes by ProbMinHash, banding and exact verification.

Shingles are runs of five words (a shorter text is one shingle); a shingle's weight is 1 + log2 of its
count.  ProbMinHash: every shingle sends arrivals of a Poisson process whose rate is its weight, each to a
register drawn at random; a register keeps the earliest arrival's shingle, and a shingle stops once its
next arrival is later than every register's.  Registers agree with the probability Jaccard similarity of the
weighted sets.  That can be far below the Jaccard similarity of the sets, if one of two near copies repeats
a line.  So a document that repeats a shingle has a second signature, with all weights one, whose registers
agree with the Jaccard similarity of the sets; without repeats both signatures are the same.  Documents with
an equal band in any of their signatures are candidates; candidates count as linked if the
exact Jaccard similarity of their shingle sets reaches ``similarity``; classes are the linked components.

Groups are never expanded into all pairs.  Equal texts are one node from the start.  In each bucket all
nodes are first compared with the most central one (that with the least share of shingles that no other
candidate has), then, where several components remain, with another one; last, nodes of a bucket that are
still in different components are compared with each other, whatever their number, a pair of blocks of them at a
time, so that a large bucket is spread over many tasks.  There, pairs go without a
comparison only if a bound keeps them below the similarity: outside the central node's set, two sets can
share no shingle that only one candidate has; inside it, they differ by at least the difference of what either
lacks.  So no candidate pair between different components goes unchecked.

Defined results: equal texts are in one class, empty and null ones included; a text without words is near
no other; the class id is the least document id of the class; null ids are kept and count as the least.
Ids are whole numbers, or texts of them: others raise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, boxed, frugal, shared_dir, slices, small_batches, whole_text, words_of, SHINGLE_WORDS
from .components import components

BANDS, ROWS = 25, 5
SIMILARITY = 0.8
#: Nodes of a bucket that are compared with as many others in one group of a shuffle.
BLOCK = 512
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = x + _GOLDEN
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray, bounds: np.ndarray, k: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, count) of the distinct shingles of texts laid end to end, sorted by document.

    ``words``: hashes of words; a text with fewer than ``k`` words, but some, is one shingle.
    """
    sizes = np.diff(bounds)
    words = words.view(np.uint64)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(words)) - bounds[doc]
    hashed = np.zeros(len(words), dtype=np.uint64)
    padded = np.r_[words, np.zeros(k, dtype=np.uint64)]
    left = sizes[doc] - place
    for i in range(k):
        hashed = np.where(left > i, mix(hashed ^ padded[i : i + len(words)]), hashed)
    keep = (left >= k) | ((sizes[doc] < k) & (place == 0))
    doc, hashed = doc[keep], hashed[keep]
    order = np.lexsort((hashed, doc))
    doc, hashed = doc[order], hashed[order]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (hashed[1:] != hashed[:-1])] if len(doc) else np.zeros(0, dtype=bool)
    first = np.flatnonzero(new)
    return doc[first], hashed[first], np.diff(np.r_[first, len(doc)])


def signatures(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, registers: int) -> np.ndarray:
    """ProbMinHash signatures of ``n`` weighted sets; a set without shingles has zeros."""
    least = np.full(n * registers, np.inf)
    winner = np.zeros(n * registers, dtype=np.uint64)
    time, step = np.zeros(len(doc)), 0
    while len(doc):
        step += 1
        drawn = mix(shingle + np.uint64(step * 0xD1B54A32D192ED03 % 2**64))
        time = time - np.log(((drawn >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / weight
        at = doc * registers + (mix(drawn) % np.uint64(registers)).astype(np.int64)
        better = time < least[at]
        to, when, what = at[better], time[better], shingle[better]
        np.minimum.at(least, to, when)
        won = when == least[to]
        winner[to[won]] = what[won]
        latest = least.reshape(n, registers).max(axis=1)
        live = time < latest[doc]
        doc, shingle, weight, time = doc[live], shingle[live], weight[live], time[live]
    return winner.reshape(n, registers)


def _keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """The hashes of each signature's bands; equal ones are of the same band."""
    key = np.zeros((len(signature), bands), dtype=np.uint64)
    for i in range(rows):
        key = mix(key ^ signature[:, i::rows])
    return mix(key + np.arange(bands, dtype=np.uint64)).view(np.int64)


@frugal
def _bands(batches: Iterator[pa.RecordBatch], bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "words", 250_000):
        words = batch.column("words")
        n = batch.num_rows
        flat = words.flatten().to_numpy(zero_copy_only=False)
        bounds = np.r_[0, np.cumsum(np.diff(words.offsets.to_numpy()))]
        doc, shingle, count = shingles(flat, bounds)
        weighted = _keys(signatures(doc, shingle, 1 + np.log2(count), n, bands * rows), bands, rows)
        key = np.c_[weighted, weighted]
        repeats = np.zeros(n, dtype=bool)
        repeats[doc[count > 1]] = True
        some = repeats[doc]
        place = np.cumsum(repeats) - 1
        key[repeats, bands:] = _keys(signatures(place[doc[some]], shingle[some], np.ones(some.sum()), repeats.sum(), bands * rows), bands, rows)
        has = np.zeros(n, dtype=bool)
        has[doc] = True
        new = np.c_[np.ones((n, bands), dtype=bool), key[:, bands:] != weighted] & has[:, None]
        lists = pa.ListArray.from_arrays(np.r_[0, np.cumsum(new.sum(axis=1))].astype(np.int32), key[new])
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("node"), lists], ["id", "node", "bands"])


@frugal
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "words", 250_000):
        words = batch.column("words")
        bounds = np.r_[0, np.cumsum(np.diff(words.offsets.to_numpy()))]
        doc, shingle, _ = shingles(words.flatten().to_numpy(zero_copy_only=False), bounds)
        ends = np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.ListArray.from_arrays(ends, shingle.view(np.int64))], ["node", "shingles"])


def _word_hashes(text: Column) -> Column:
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def _node(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v, a, b, shared) of pairs (u, v): their sets' sizes and how many shingles they share."""
    a = pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("x")), "u")
    both = a.join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("y")), "v")
    return both.select("u", "v", F.size("x").alias("a"), F.size("y").alias("b"), F.size(F.array_intersect("x", "y")).alias("shared"))


def _linked(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose sets are similar."""
    return _overlaps(pairs, sets).where(_similar(similarity)).select("u", "v")


def _similar(similarity: float) -> Column:
    return F.col("shared") >= similarity * (F.col("a") + F.col("b") - F.col("shared"))


def _blocks(rest: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """The two sides of the comparison of each bucket's nodes, keyed by bucket and a pair of blocks, low <= high.

    A bucket has one block for every ``block`` of its nodes, so a key has about twice as many rows on a side at most, however
    large the bucket is; a node goes to the keys that its block is the low one of on the left, and the high one on the right.
    """
    many = rest.groupBy("bucket").agg(F.ceil(F.count("*") / block).alias("blocks"))
    dealt = rest.join(many, "bucket").withColumn("at", F.pmod(F.xxhash64("node"), F.col("blocks")))
    columns = ("node", "part", "size", "own", "lacks", "extra")
    left = dealt.select("bucket", F.col("at").alias("low"), F.explode(F.sequence("at", F.col("blocks") - 1)).alias("high"), *columns)
    renamed = [F.col(c).alias(f"other_{c}") for c in columns]
    return left, dealt.select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), "at")).alias("low"), F.col("at").alias("high"), *renamed)


def _classes(docs: DataFrame, text: str, key: str, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(id, node) of every row, and (node, part, least) of every node."""
    shared_dir(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    small_batches(docs.sparkSession)
    t = whole_text(text)
    made = docs.select(F.col(key).cast("long").alias("id"), _node(t).alias("node"), _word_hashes(t).alias("words"))
    rows_of = scratch.stored(
        made.mapInArrow(lambda it: _bands(it, bands, rows), "id bigint, node binary, bands array<bigint>"), "bands"
    )
    nodes = rows_of.groupBy("node").agg(F.min(F.coalesce("id", F.lit(-(2**63)))).alias("least"), F.min("bands").alias("bands"))
    member = nodes.select("node", F.explode("bands").alias("bucket"))
    several = member.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    shared = scratch.stored(member.join(several, "bucket"), "members")

    wanted = shared.select("node").distinct().join(nodes.select("node", "least"), "node")
    texts = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))).alias("least"), t.alias("text"))
    found = texts.join(wanted, "least").where(_node(F.col("text")) == F.col("node"))
    sets = scratch.stored(
        found.select("node", _word_hashes(F.col("text")).alias("words")).mapInArrow(_sets, "node binary, shingles array<bigint>").dropDuplicates(["node"]), "sets"
    )

    of_one = sets.select("node", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n"), F.first("node").alias("node")).where("n = 1")
    own = of_one.groupBy("node").agg(F.count("*").alias("own"))
    sizes = scratch.stored(
        sets.select("node", F.size("shingles").alias("size")).join(own, "node", "left").select("node", "size", F.coalesce("own", F.lit(0)).alias("own")), "sizes"
    )
    sized = shared.join(sizes, "node")
    central = sized.groupBy("bucket").agg(F.min(F.struct(F.col("own") / F.col("size"), "node")).alias("low"), F.max("node").alias("high"))
    members = scratch.stored(sized.join(central.select("bucket", "low.node", "high").withColumnRenamed("node", "low"), "bucket"), "members")

    def pair(a: str, b: str, of: DataFrame) -> DataFrame:
        return of.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u != v").distinct()

    def settled(links: DataFrame) -> DataFrame:
        return components(links).select("node", F.col("root").alias("part"))

    def apart(part: DataFrame) -> DataFrame:
        """The members of buckets with several parts."""
        named = members.join(part, "node", "left").withColumn("part", F.coalesce("part", "node"))
        mixed = named.groupBy("bucket").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p != q").select("bucket")
        return named.join(mixed, "bucket")

    star = scratch.stored(_overlaps(pair("node", "low", members), sets), "star")
    links = star.where(_similar(similarity)).select("u", "v")
    part = scratch.stored(settled(links), "parts")
    rest = apart(part)
    top = part.select(F.col("node").alias("high"), F.col("part").alias("high_part"))
    again = rest.join(top, "high", "left").where(F.col("part") != F.coalesce("high_part", "high"))
    links = scratch.stored(links.unionByName(_linked(pair("node", "high", again), sets, similarity)), "links")
    part = scratch.stored(settled(links), "parts")
    left = apart(part).where("node != low").select("bucket", "node", "part", "size", "own", "low", F.least("node", "low").alias("u"), F.greatest("node", "low").alias("v"))
    able = F.col("own") <= F.col("size") * (1 - similarity) + 1e-9
    lacks = F.when(F.col("u") == F.col("low"), F.col("a")).otherwise(F.col("b")) - F.col("shared")
    rest = scratch.stored(left.where(able).join(star, ["u", "v"]).select("bucket", "node", "part", "size", "own", lacks.alias("lacks"), (F.col("size") - F.col("shared")).alias("extra")), "rest")
    left, right = _blocks(rest, block)
    common = F.least(F.col("extra") - F.col("own"), F.col("other_extra") - F.col("other_own"))
    differ = F.col("extra") + F.col("other_extra") - common * 2 + F.abs(F.col("lacks") - F.col("other_lacks"))
    near_enough = differ <= (F.col("size") + F.col("other_size")) * ((1 - similarity) / (1 + similarity)) + 1e-9
    once = (F.col("low") != F.col("high")) | (F.col("node") < F.col("other_node"))
    cross = left.join(right, ["bucket", "low", "high"]).where(once & (F.col("part") != F.col("other_part")) & near_enough)
    links = links.unionByName(_linked(pair("node", "other_node", cross), sets, similarity))
    part = settled(links)

    named = nodes.select("node", "least").join(part, "node", "left").withColumn("part", F.coalesce("part", "node"))
    named = scratch.stored(named, "named")
    scratch.release("bands", "named")
    return rows_of.select("id", "node"), named


def near_duplicate_classes(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """(``key``, class_id) of every row; options: similarity, bands, rows, block."""
    rows, named = _classes(docs, text, key, **options)
    classes = named.join(named.groupBy("part").agg(F.min("least").alias("class_id")), "part").select("node", "class_id")
    return rows.select(F.col("id").alias(key), "node").join(classes, "node").select(key, "class_id")


def first_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """``docs`` with one row of each class: that with the least id (of equal ids, the least text hash)."""
    _, named = _classes(docs, text, key, **options)
    stay = named.groupBy("part").agg(F.min(F.struct("least", "node")).alias("s")).select(F.col("s.least").alias("_least"), F.col("s.node").alias("_node"))
    keyed = boxed(docs, _least=F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))), own=_node(whole_text(text)))
    found = keyed.join(stay, "_least").where(F.col("_node") == F.col("own"))
    return found.dropDuplicates(["_least", "_node"]).select("rest.*")
