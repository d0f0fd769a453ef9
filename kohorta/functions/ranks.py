"""Salted ranks, uniform scores and draws from SHA-256."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the rank format.
SEPARATOR, SCORE_BITS, LIMIT = "\x1f", 53, 2**64


def rank_digest(subject: Column, salt: str | Column) -> Column:
    start = F.lit(salt + SEPARATOR) if isinstance(salt, str) else F.concat(salt, F.lit(SEPARATOR))
    return F.sha2(F.concat(start, subject.cast("string")), 256)


def uniform_score(subject: Column, salt: str) -> Column:
    """A score in [0, 1) with 53 random bits."""
    first = F.conv(F.substring(rank_digest(subject, salt), 1, 16), 16, -10).cast("long")
    return F.call_function("shiftrightunsigned", first, F.lit(64 - SCORE_BITS)) / F.lit(float(2**SCORE_BITS))


def replicate_salt(salt: str, replicate: Column) -> Column:
    return F.concat(F.lit(f"{salt}|resample|"), replicate.cast("string"))


def draw_value(counter: Column, salt: str, replicate: Column) -> Column:
    """The counter's unsigned 64-bit draw."""
    text = rank_digest(counter, replicate_salt(salt, replicate))
    return F.conv(F.substring(text, 1, 16), 16, 10).cast("decimal(20,0)")


def cutoff(n: int) -> int:
    """Draws from here on would favour small remainders of ``n``."""
    return LIMIT - LIMIT % n


def shard_key(rank: Column, size: Column | int, total: Column) -> Column:
    """The rank bucket's name, ``r<first>-<end>`` with ten digits each."""
    size = F.lit(size) if isinstance(size, int) else size
    first = F.floor(rank / size) * size
    return F.format_string("r%010d-%010d", first.cast("long"), F.least(first + size, total).cast("long"))
