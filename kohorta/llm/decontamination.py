"""Benchmark decontamination: test items found inside documents by size-partitioned MinHash containment.

An item is contained if at least ``containment`` of its distinct five-word shingles occur in the document; an
item of fewer words is one shingle, which occurs where its words follow one another.  A shingle's hash is also
its MinHash value.  Items are partitioned by their number of shingles, in powers of two; a partition fixes how
deep its items' sketches are: the sketch of an item is its k shingles with the least hashes (its k-minimum
values), where k is the most shingles that any item of the partition may miss, plus one.  A document that contains
an item thus shares a sketch value with it, however long the document is, so the search misses nothing.  A table
of bits, made from all partitions' sketch values (64 bits a value, up to ``MOST_BITS``), is looked up for every shingle of
a document before anything is exploded: what it lets pass is the document's sketch, all values that any item's
sketch has and one in 64 of the others for up to 16,384 sketch values (beyond that, more of them).  Those
are looked up in the sketches themselves.  A document with fewer places than the item needs is out
before the search.  Candidates are then verified with all the item's shingles.  Only built-in functions are used.

Defined results: null and empty texts, and items without words, match nothing; words are compared in lower
case; every row is compared by itself, also if ids repeat or are null (rows that are equal in id and text are
judged once, for all of them); ``contained_items`` gives one row for each (document id, item id), with the best
containment of their rows; ``clean_documents`` drops only rows that contain an item themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import boxed, let, shared_dir, shingle_hashes, stored, whole_text, words_of, SHINGLE_WORDS

CONTAINMENT = 0.8
#: Rows of a table of shingles or of row keys up to which it is broadcast (16 bytes each, or 8).
BROADCAST_ROWS, BROADCAST_KEYS = 200_000, 1_000_000


#: Bits of the table of sketch values: the most, and the least.
MOST_BITS, LEAST_BITS = 1 << 20, 1 << 12


def _words(text: Column) -> Column:
    return words_of(F.lower(text))


def _shingles(text: Column, sizes: list[int]) -> Column:
    """Hashes of the text's shingles of each of the ``sizes``."""
    return let(_words(text), lambda w: F.concat(*[shingle_hashes(w, k) for k in sizes]))


def _row(text: str, key: str) -> Column:
    """What tells rows apart: a hash of id and text."""
    return F.xxhash64(F.col(key), whole_text(text))


def _enough(n_item: Column, containment: float) -> Column:
    return F.ceil(n_item * containment - 1e-9).cast("long")


def item_shingles(items: DataFrame, text: str = "text", key: str = "item_id") -> DataFrame:
    """(item_row, item, size, shingle, n_item) with the distinct shingles, of ``size`` words, of every item row."""
    made = items.select(_row(text, key).alias("item_row"), F.col(key).alias("item"), whole_text(text).alias("text")).dropDuplicates(["item_row"])
    sized = made.withColumn("size", F.least(F.size(_words(F.col("text"))), F.lit(SHINGLE_WORDS)))
    shingles = F.lit(None).cast("array<bigint>")
    for k in range(1, SHINGLE_WORDS + 1):
        shingles = F.when(F.col("size") == k, _shingles(F.col("text"), [k])).otherwise(shingles)
    each = sized.select("item_row", "item", "size", F.array_distinct(shingles).alias("s"))
    return each.select("item_row", "item", "size", F.explode("s").alias("shingle"), F.size("s").cast("long").alias("n_item"))


def sketches(shingles: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """(shingle, item_row, need): the values of each item's sketch, and how many shingles it must share."""
    upper = F.pow(F.lit(2), F.ceil(F.log2("n_item"))).cast("long")  # of the item's partition
    depth = F.least(F.col("n_item"), upper - _enough(upper, containment) + 1)
    order = Window.partitionBy("item_row").orderBy("shingle")
    placed = shingles.withColumn("place", F.row_number().over(order)).where(F.col("place") <= depth)
    return placed.select("shingle", "item_row", _enough(F.col("n_item"), containment).alias("need"))


def bit_table(sketch: DataFrame, n: int) -> list[int]:
    """64-bit words, a power of two of them, in which the bit of each of the ``n`` sketch values is set."""
    bits = LEAST_BITS
    while bits < MOST_BITS and bits < 64 * n:
        bits *= 2
    at = F.pmod("shingle", F.lit(bits))
    words = sketch.select(F.shiftright(at, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int")).alias("bit"))
    found = {r["word"]: r["set"] for r in words.groupBy("word").agg(F.bit_or("bit").alias("set")).collect()}  # ``MOST_BITS`` / 64 rows at most
    return [found.get(i, 0) for i in range(bits // 64)]


def passing(shingles: Column, table: list[int]) -> Column:
    """Of an array of shingles those whose bit is set."""
    words = F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")  # folded into one constant
    at = lambda x: F.pmod(x, F.lit(64 * len(table)))
    return F.filter(shingles, lambda x: F.getbit(F.get(words, F.shiftright(at(x), 6).cast("int")), (at(x) % 64).cast("int")) == 1)


def _joined(left: DataFrame, right: DataFrame, on: list[str], rows: int, most: int = BROADCAST_ROWS, how: str = "inner") -> DataFrame:
    """The join, by broadcast if the right side has no more than ``most`` rows."""
    return left.join(F.broadcast(right) if rows <= most else right, on, how)


def _contained(docs: DataFrame, items: DataFrame, text: str, key: str, item_text: str = "text", item_key: str = "item_id", containment: float = CONTAINMENT) -> DataFrame:
    """(row, doc, item, n_shared, n_item) of every document row and item row that it contains."""
    shared_dir(docs.sparkSession)
    whole = stored(item_shingles(items, item_text, item_key), "items")
    sketch = stored(sketches(whole, containment), "sketches")
    n_whole, n_sketch = whole.count(), sketch.count()
    sizes = sorted(r["size"] for r in whole.select("size").distinct().collect()) or [SHINGLE_WORDS]  # five numbers at most
    table = bit_table(sketch, n_sketch)

    made = docs.select(_row(text, key).alias("row"), F.col(key).alias("doc"), whole_text(text).alias("text"))
    found = made.select("row", _shingles(F.col("text"), sizes).alias("s"))
    sketched = found.select("row", F.size("s").alias("places"), F.explode(passing(F.col("s"), table)).alias("shingle"))
    pairs = _joined(sketched, sketch, ["shingle"], n_sketch).where("places >= need").select("row", "item_row").distinct()
    pairs = stored(pairs, "candidates")

    again = _joined(made, pairs.select("row").distinct(), ["row"], pairs.count(), BROADCAST_KEYS, "left_semi").select("row", "doc", F.explode(F.array_distinct(_shingles(F.col("text"), sizes))).alias("shingle"))
    hits = _joined(again, whole.select("shingle", "item_row", "item", "n_item"), ["shingle"], n_whole).join(pairs, ["row", "item_row"])
    counted = hits.groupBy("row", "doc", "item_row", "item").agg(F.countDistinct("shingle").alias("n_shared"), F.max("n_item").alias("n_item"))
    return counted.where(F.col("n_shared") >= _enough(F.col("n_item"), containment)).select("row", "doc", "item", "n_shared", "n_item")


def contained_items(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """(doc, item, n_shared, n_item) of every document id and item that it contains; options: item_text, item_key, containment."""
    found = _contained(docs, items, text, key, **options)
    best = F.max(F.struct((F.col("n_shared") / F.col("n_item")).alias("share"), "n_shared", "n_item")).alias("best")
    return found.groupBy("doc", "item").agg(best).select("doc", "item", "best.n_shared", "best.n_item")


def clean_documents(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """``docs`` without those that contain an item."""
    bad = stored(_contained(docs, items, text, key, **options).select("row").distinct(), "bad")
    return _joined(boxed(docs, row=_row(text, key)), bad, ["row"], bad.count(), BROADCAST_KEYS, "left_anti").select("rest.*")
