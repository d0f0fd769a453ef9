"""URL filters: host and path rules, then a weighted vocabulary searched with an Aho-Corasick automaton.

A rule (host, path) fits its host and all subdomains if the URL's path starts with the rule's; the longest
fitting rule decides.  Where none fits, the vocabulary does: each term has points and counts only where neither
neighbour is a letter or digit; ``limit`` points block the URL.  A strict term has as many by itself; soft terms
have fewer, so that several distinct ones are needed, each counted once.

Defined results: null, or a URL without ``://``, has an empty host and path, so no rule fits it; the
vocabulary still judges what there is.  Repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import frugal, small_batches

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERMS = Path(__file__).with_name("url_terms.txt")
LIMIT = 4


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    UrlRule("allow", "com", "/"),
    UrlRule("block", "example.com", "/en/"),
    UrlRule("allow", "www.example.com", "/en/"),
    UrlRule("block", "net", "/es/"),
    UrlRule("block", "net", "/fr/"),
)


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[UrlRule, ...] = RULES) -> Column:
    """The longest fitting rule as a struct (rule, verdict), or null."""
    out = None
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        made = F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits, made) if out is None else out.when(fits, made)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if out is None else out


def read_terms(path: str | Path = TERMS) -> dict[str, int]:
    """A vocabulary file: a term and its points in each line; # begins a comment."""
    out = {}
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        if fields := line.partition("#")[0].split():
            term, points = fields
            if int(points) < 1:
                raise ValueError(f"{path}: {term!r} has no points")
            out[term.lower()] = int(points)
    return out


def automaton(terms: dict[str, int]):
    import ahocorasick

    made = ahocorasick.Automaton()
    for term, points in terms.items():
        made.add_word(term, (term, points))
    made.make_automaton()
    return made


def hits(made, url: str, limit: int = LIMIT) -> tuple[int, int, int]:
    """(strict hits, distinct soft terms, their points) of a lower-case URL."""
    strict, soft = 0, {}
    for end, (term, points) in made.iter(url) if len(made) else ():
        before, after = url[end - len(term) : end - len(term) + 1] if end >= len(term) else "", url[end + 1 : end + 2]
        if (before and _inside(before)) or (after and _inside(after)):
            continue
        if points >= limit:
            strict += 1
        else:
            soft[term] = points
    return strict, len(soft), sum(soft.values())


def _inside(c: str) -> bool:
    return c.isascii() and c.isalnum()


@frugal
def _judge(batches: Iterator[pa.RecordBatch], terms: dict[str, int], limit: int) -> Iterator[pa.RecordBatch]:
    made = automaton(terms)
    lower = str.maketrans(UPPER, LOWER)
    for batch in batches:
        at = batch.schema.get_field_index("_url")
        found = [hits(made, (u or "").translate(lower), limit) for u in batch.column(at).to_pylist()]
        rest = [c for i, c in enumerate(batch.columns) if i != at]
        names = [n for i, n in enumerate(batch.schema.names) if i != at]
        counts = [pa.array([x[i] for x in found], pa.int32()) for i in range(3)]
        yield pa.RecordBatch.from_arrays([*rest, *counts], [*names, "strict_hits", "soft_hits", "soft_points"])


def judge_urls(pages: DataFrame, url: str = "url", key: str = "page_id", rules: tuple[UrlRule, ...] = RULES, terms: dict[str, int] | None = None, limit: int = LIMIT) -> DataFrame:
    """(``key``, host, path, rule, verdict, strict_hits, soft_hits, soft_points) of every row; ``terms``: points of each term."""
    terms = read_terms() if terms is None else terms
    small_batches(pages.sparkSession)
    made = pages.select(F.col(key).alias("id"), F.col(url).alias("_url"))
    kind = made.schema["id"].dataType.simpleString()
    counted = made.withColumn("url", F.col("_url")).mapInArrow(lambda it: _judge(it, terms, limit), f"id {kind}, url string, strict_hits int, soft_hits int, soft_points int")
    counts = ("strict_hits", "soft_hits", "soft_points")
    split = counted.select("id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), *counts)
    own = F.when((F.col("strict_hits") > 0) | (F.col("soft_points") >= limit), "block").otherwise("allow")
    ruled = split.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    return ruled.select(F.col("id").alias(key), "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", own).alias("verdict"), *counts)
