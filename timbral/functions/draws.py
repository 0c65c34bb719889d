"""Random choices as pure functions of keys, so that no result depends on partitioning or retries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = 42


def draw(purpose: str, *keys: str | Column, seed: int = SEED) -> Column:
    """A number in [0, 1) from the first 32 bits of the MD5 of seed, keys and purpose."""
    key = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys], F.lit(purpose))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def shuffle_key(*keys: str | Column, seed: int = SEED) -> Column:
    """What a keyed shuffle orders by."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys]).cast("binary"))
