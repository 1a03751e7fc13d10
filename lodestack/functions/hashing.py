"""Content addresses: SHA-256 in the JVM by default, BLAKE3 in Arrow batches on request."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestack.functions import blake3

ALGORITHMS = ("sha2", "blake3")


def _blake3_hex(body: Column | str) -> Column:
    @F.pandas_udf("string")
    def run(data: pd.Series) -> pd.Series:
        out = pd.Series(None, index=data.index, dtype=object)
        out[data.notna()] = [d.hex() for d in blake3.digests(data.dropna())]
        return out

    return run(body)


def content_id(body: Column | str, algo: str = "sha2") -> Column:
    """Lower-case hex digest of a binary column; null for null."""
    if algo not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {algo}")
    return F.sha2(body, 256) if algo == "sha2" else _blake3_hex(body)


def normalized_id(key: Column | str) -> Column:
    """Content ids are compared without outer blanks and in lower case."""
    return F.lower(F.trim(key))


def shard_path(key: Column | str, root: str = "chunks") -> Column:
    """Two-level folder of a content id: root/ab/cd/abcd..."""
    k = F.col(key) if isinstance(key, str) else key
    return F.concat_ws("/", F.lit(root), F.substring(k, 1, 2), F.substring(k, 3, 2), k)
