"""How many tokens a training epoch sees: integer arithmetic on per-subject counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BATCH_MODES, STATIC_MODES = ("SM", "SEM"), ("OMIT", "INCLUDE", "PREPEND")


def n_windows(length: Column, width: int, stride: int | None) -> Column:
    """One where nothing steps or all fits, else windows until one ends at the sequence's end."""
    if stride is None:
        return F.lit(1).cast("long")
    steps = length - width + (stride - 1)
    return F.when(length <= width, F.lit(1)).otherwise(F.lit(1) + F.call_function("div", steps, F.lit(stride))).cast("long")


def projected(events: Column, measurements: Column, statics: Column, width: int, batch_mode: str = "SM", static_mode: str = "INCLUDE", stride: int | None = None) -> dict[str, Column]:
    """A subject's windows, corpus, trained, static, dropped and repeated tokens."""
    if batch_mode not in BATCH_MODES or static_mode not in STATIC_MODES:
        raise ValueError(f"unknown mode {batch_mode!r} or {static_mode!r}")
    if width < 1 or (stride is not None and stride < 1):
        raise ValueError("the window and its stride must be positive")
    zero = F.lit(0).cast("long")
    corpus = measurements + (zero if static_mode == "OMIT" else statics)
    prepended = static_mode == "PREPEND"
    base = measurements if batch_mode == "SM" else events
    head = (statics if batch_mode == "SM" else F.lit(1)) if prepended else zero
    length = base + head
    used = F.least(length, F.lit(width))
    n = n_windows(length, width, stride)
    if batch_mode == "SM":
        static = n * statics if static_mode == "INCLUDE" else F.least(statics, used) if prepended else zero
        trained = n * used + (static if static_mode == "INCLUDE" else zero)
    else:
        units = n * used - (1 if prepended else 0)
        half = F.call_function("div", events, F.lit(2))
        dynamic = F.when(events > 0, F.call_function("div", units * measurements + half, F.when(events > 0, events))).otherwise(zero)
        static = n * statics if static_mode == "INCLUDE" else statics if prepended else zero
        trained = dynamic + static
    made = {
        "n_windows": n, "n_corpus_tokens": corpus, "n_trained_tokens": trained, "n_static_tokens": static,
        "n_dropped_tokens": F.greatest(corpus - trained, zero), "n_repeated_tokens": F.greatest(trained - corpus, zero),
    }
    return {k: v.cast("long") for k, v in made.items()}
