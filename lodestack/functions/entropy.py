"""Shannon entropy of byte windows and the runs of like windows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class EntropyConfig:
    """Bytes of a window, and the bounds (both inclusive) of low and high entropy."""

    window_size: int = 16 << 10
    low: float = 4.9
    high: float = 7.2


def shannon(data: bytes | np.ndarray) -> float:
    """Bits per byte; 0 for no bytes."""
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    p = counts[counts > 0] / max(1, len(data))
    return float(-(p * np.log2(p)).sum()) if len(p) else 0.0


def window_entropies(body: Column | str, window_size: int) -> Column:
    """Entropy of each window of a binary column, in order; the last may be short."""

    @F.pandas_udf("array<double>")
    def run(data: pd.Series) -> pd.Series:
        return pd.Series([None if d is None else [shannon(d[i : i + window_size]) for i in range(0, len(d), window_size)] for d in data], dtype=object)

    return run(body)


def mode(value: Column, config: EntropyConfig) -> Column:
    """low, mid or high; the low bound is looked at first."""
    return F.when(value <= config.low, "low").when(value >= config.high, "high").otherwise("mid")


def segments(body: Column | str, config: EntropyConfig) -> Column:
    """Runs of windows of one mode: array of (start, end, mode, entropy).

    The entropy of a run folds from the left: each further window halves what
    stood before and adds half of its own, so it is not a mean.
    """
    body = F.col(body) if isinstance(body, str) else body
    size = F.octet_length(body).cast("long")
    windows = F.transform(
        window_entropies(body, config.window_size),
        lambda e, i: F.struct((i.cast("long") * config.window_size).alias("start"), F.least((i.cast("long") + 1) * config.window_size, size).alias("end"), mode(e, config).alias("mode"), e.alias("entropy")),
    )
    kind = "array<struct<start:bigint,end:bigint,mode:string,entropy:double>>"

    def fold(runs, w):
        last = F.try_element_at(runs, F.lit(-1))
        grown = F.struct(last["start"].alias("start"), w["end"].alias("end"), w["mode"].alias("mode"), ((last["entropy"] + w["entropy"]) / 2).alias("entropy"))
        return F.when((F.size(runs) > 0) & (F.try_element_at(runs, F.lit(-1))["mode"] == w["mode"]), F.concat(F.slice(runs, 1, F.greatest(F.size(runs) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(runs, F.array(w)))

    return F.aggregate(windows, F.array().cast(kind), fold)
