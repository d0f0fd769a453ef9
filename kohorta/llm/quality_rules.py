"""Quality rules: a learned decision list over text statistics, applied as Spark expressions.

``statistics`` gives every row's counts with built-in functions only.  ``learn`` grows an ordered list of
rules (conjunctions of thresholds) by sequential covering on labelled rows: each rule is grown on two
thirds of the rows that are not covered yet by the condition with the best information gain, then pruned
on the other third.  ``verdict`` turns the list into one ordered conditional expression.

Defined results: a null or empty text has no words and fails the base rules; a label that is null is left
out; a document with several labels counts as bad if one of them is; of rows that share a labelled id one is learned from; ids may be of any type; without labels of both classes the
list is empty and the base rules alone decide; other columns pass through, and columns that would clash
with the names made here are kept (the made ones are in one struct column whose name is a parameter).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, boxed, let, whole_text, words_of

#: Labelled rows that the list is learned from, at most: those with the least hashes of their ids.
MAX_LABELLED = 20_000
MAX_RULES, MAX_CONDITIONS, CUTS = 12, 4, 48
MIN_COVERED, MIN_PRECISION = 5, 0.9
SYMBOLS = r"[^#*$%&|<>]+"
#: Words beyond which a window's hash and place have a long each.
LONG_TEXT = 1 << 14


def _repeated_words(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more.

    A window is a long: its hash above, its place in the low bits that the text's size asks for.  Sorted,
    equal windows are neighbours.  (Two different windows of 16,384 pass for equal with a chance of 2e-7.)
    Longer texts' windows are pairs of the whole hash and the place (3e-8 for a million words).
    """

    def hashed(w: Column, i: Column) -> Column:
        return F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))

    def packed(w: Column, bits: Column) -> Column:
        one = lambda i: F.call_function("shiftleft", hashed(w, i), bits).bitwiseOR(i.cast("long"))
        return F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), one))

    def paired(w: Column) -> Column:
        one = lambda i: F.struct(hashed(w, i).alias("window"), i.alias("place"))
        return F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), one))

    def packed_places(s: Column, bits: Column) -> Column:
        window = lambda i: F.call_function("shiftright", F.get(s, i), bits)
        return places(s, window, lambda i: (F.get(s, i) - F.call_function("shiftleft", window(i), bits)).cast("int"))

    def paired_places(s: Column) -> Column:
        return places(s, lambda i: F.get(s, i)["window"], lambda i: F.get(s, i)["place"])

    def places(s: Column, window: Callable[[Column], Column], place: Callable[[Column], Column]) -> Column:
        later = F.filter(F.sequence(F.lit(1), F.size(s) - 1), lambda i: window(i) == window(i - 1))
        return let(later, lambda x: F.sort_array(F.array_union(F.transform(x, place), F.transform(x, lambda i: place(i - 1)))))

    def covered(p: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(-9).alias("last"))
        return F.aggregate(p, start, lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"), x.alias("last")))["n"]

    bits = F.ceil(F.log2(F.size(words))).cast("int")
    short = let(bits, lambda b: let(packed(words, b), lambda s: let(packed_places(s, b), covered)))
    long = let(paired(words), lambda s: let(paired_places(s), covered))
    return F.when(F.size(words) > LONG_TEXT, long).when(F.size(words) >= 4, short).otherwise(F.lit(0)).cast("long")


def _lines(lines: Column) -> Column:
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def statistics(docs: DataFrame, text: str = "text", into: str = "_statistics") -> DataFrame:
    """``docs`` and a struct of long counts named ``into``."""
    t = whole_text(text)
    bare = F.regexp_replace(t, WHITE, "")
    without = lambda pattern: F.length(F.regexp_replace(bare, pattern, ""))
    counts = let(
        words_of(t),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeated_words(w).alias("n_repeat_words")),
    )
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    long = lambda c, name: c.cast("long").alias(name)
    return docs.withColumn("_counts", counts).withColumn(
        into,
        F.struct(
            F.col("_counts.n_words").alias("n_words"),
            long(F.length(bare), "word_chars"),
            long(without(SYMBOLS), "n_symbols"),
            long(_lines(lines), "n_dup_lines"),
            F.col("_counts.n_repeat_words").alias("n_repeat_words"),
            long(without(r"[^\p{Lu}]+"), "n_upper"),
            long(without(r"[^!?]+"), "n_marks"),
        ),
    ).drop("_counts")


#: Ratios that rules may test, in thousandths: (name, numerator, denominator).
RATIOS = (
    ("word_length", "word_chars", "n_words"),
    ("symbols", "n_symbols", "n_words"),
    ("dup_lines", "n_dup_lines", "n_words"),
    ("repeat_words", "n_repeat_words", "n_words"),
    ("upper", "n_upper", "word_chars"),
    ("marks", "n_marks", "n_words"),
)
COUNTS = ("n_words", "n_dup_lines")


def features(statistics: str = "_statistics") -> dict[str, Column]:
    at = lambda name: F.col(f"{statistics}.{name}")
    made = {name: F.floor(at(a) * 1000 / F.greatest(at(b), F.lit(1))).cast("long") for name, a, b in RATIOS}
    return made | {name: at(name) for name in COUNTS}


def base_failed(statistics: str = "_statistics") -> Column:
    n, repeated = F.col(f"{statistics}.n_words"), F.col(f"{statistics}.n_repeat_words")
    return (n < 50) | (repeated * 100 > n * 50)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: int

    def column(self, values: dict[str, Column]) -> Column:
        return values[self.feature] > self.cut if self.above else values[self.feature] <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    covered: int
    bad: int

    def column(self, values: dict[str, Column]) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column(values)
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions)) + f" -> reject ({self.bad} of {self.covered})"


def learn_rows(rows: list[tuple[dict[str, int], bool]]) -> list[Rule]:
    """The decision list for (features, is bad) rows, which the caller has bounded.

    Sets of rows are bit masks in Python's integers, so that a condition's coverage is one AND and a count.
    """
    if not rows:
        return []
    bad = sum(1 << i for i, (_, b) in enumerate(rows) if b)
    everything = (1 << len(rows)) - 1
    if not bad or bad == everything:
        return []
    masks: dict[Condition, int] = {}
    for name in rows[0][0]:
        values = sorted({f[name] for f, _ in rows})
        steps = sorted({i * (len(values) - 1) // CUTS for i in range(CUTS)}) if len(values) > 1 else []
        for cut in sorted({(values[i] + values[i + 1]) // 2 for i in steps}):
            above = sum(1 << i for i, (f, _) in enumerate(rows) if f[name] > cut)
            masks[Condition(name, True, cut)] = above
            masks[Condition(name, False, cut)] = everything & ~above
    prune_set = sum(1 << i for i in range(2, len(rows), 3))
    left, rules = everything, []
    while len(rules) < MAX_RULES and (left & bad).bit_count() >= MIN_COVERED:
        chosen = _prune(_grow(masks, left & ~prune_set, bad), masks, left & prune_set, bad)
        covered = _covered(chosen, masks, left)
        n, hit = covered.bit_count(), (covered & bad).bit_count()
        if not chosen or hit < MIN_COVERED or hit < MIN_PRECISION * n:
            break
        rules.append(Rule(tuple(chosen), n, hit))
        left &= ~covered
    return rules


def _covered(conditions: list[Condition], masks: dict[Condition, int], among: int) -> int:
    for c in conditions:
        among &= masks[c]
    return among


def _grow(masks: dict[Condition, int], among: int, bad: int) -> list[Condition]:
    chosen: list[Condition] = []
    while len(chosen) < MAX_CONDITIONS:
        n, hit = among.bit_count(), (among & bad).bit_count()
        if not hit or hit == n:
            break
        best, gain = None, 1e-9
        for c, mask in masks.items():
            m = (among & mask).bit_count()
            h = (among & mask & bad).bit_count()
            if h and (g := h * (log2(h / m) - log2(hit / n))) > gain:
                best, gain = c, g
        if best is None:
            break
        chosen.append(best)
        among &= masks[best]
    return chosen


def _prune(chosen: list[Condition], masks: dict[Condition, int], among: int, bad: int) -> list[Condition]:
    """The prefix with the best (hits - misses) / covered; the shortest of equals."""
    best, worth = chosen, -2.0
    for k in range(1, len(chosen) + 1):
        covered = _covered(chosen[:k], masks, among)
        if n := covered.bit_count():
            value = (2 * (covered & bad).bit_count() - n) / n
            if value > worth:
                best, worth = chosen[:k], value
    return best


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", quality: str = "quality", max_labelled: int = MAX_LABELLED) -> list[Rule]:
    """The list learned from at most ``max_labelled`` labelled documents that do not fail the base rules.

    Only the sample's texts are counted: whether they fail the base rules is asked after the join, as a filter
    would be pushed below it and count every text.
    """
    sample = (
        labels.where(F.col(key).isNotNull() & F.col(quality).isNotNull())
        .groupBy(F.col(key).alias("_key"))
        .agg((F.min(quality) == 0).alias("_bad"))
        .orderBy(F.xxhash64("_key"), "_key")
        .limit(max_labelled)
    )
    # the sample's size is bounded by max_labelled
    some = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(sample), "_key")
    names = list(features())
    counted = statistics(some, "_text").select("_key", "_bad", base_failed().alias("_failed"), *[c.alias(n) for n, c in features().items()])
    row = F.min(F.struct("_failed", "_bad", *names)).alias("row")  # of rows with one id, one counts
    found = counted.groupBy(F.xxhash64("_key").alias("_order"), "_key").agg(row).collect()
    rows = sorted((r["_order"], r["row"]) for r in found)
    return learn_rows([({n: r[n] for n in names}, r["_bad"]) for _, r in rows if not r["_failed"]])


def verdict(rules: list[Rule], statistics: str = "_statistics") -> Column:
    """True to keep: the first rule that fits rejects."""
    if not rules:
        return F.lit(True)
    values = features(statistics)
    out = F.when(F.coalesce(rules[0].column(values), F.lit(False)), F.lit(False))
    for r in rules[1:]:
        out = out.when(F.coalesce(r.column(values), F.lit(False)), F.lit(False))
    return out.otherwise(F.lit(True))


def kept_documents(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """The rows that stay, with their own columns."""
    return judge(boxed(docs, text=F.col(text)), rules).where("_kept").select("rest.*")


def judge(docs: DataFrame, rules: list[Rule], text: str = "text", into: str = "_statistics", kept: str = "_kept") -> DataFrame:
    """``docs`` with its statistics and the final verdict: kept unless the base rules or the list reject."""
    return statistics(docs, text, into).withColumn(kept, ~base_failed(into) & verdict(rules, into))
