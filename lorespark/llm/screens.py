"""A filter over a bounded set of 64-bit keys, sent to every task to spare rows that match none a shuffle.

Rows: null keys are not allowed; repeated keys count once; an empty table gives a filter that holds for none. Above
SENT_BYTES there is no filter, and callers join everything: the result is the same, only more of it moves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare
from .fuse import FuseFilter

#: Keys in one filter.
SHARD_KEYS = 200_000
#: Filter bytes that may be sent to every task; a key takes under two.
SENT_BYTES = 32 << 20


def _build(group: pd.DataFrame) -> pd.DataFrame:
    f = FuseFilter.build(group["k"].to_numpy().astype(np.uint64))
    return pd.DataFrame({"shard": group["shard"].iloc[:1], "seed": f.seed, "segment": f.segment, "starts": f.starts, "payload": [f.table]})


def sent_filter(keys: DataFrame, limit: int = SENT_BYTES) -> Callable[[Column], Column] | None:
    """keys: one long column k. A Column function that holds for all of them and few others; None if too large to send.

    It only spares work: what it lets pass is joined exactly afterwards, and so is everything where it is None.
    """
    prepare(keys.sparkSession)
    n = keys.count()
    if n * 2 > limit:
        return None
    shards = 1 + n // SHARD_KEYS
    rows = keys.select("k", F.pmod("k", F.lit(shards)).cast("int").alias("shard")).groupBy("shard").applyInPandas(_build, "shard int, seed long, segment long, starts long, payload binary").collect()
    table = {r.shard: FuseFilter(r.seed, r.segment, r.starts, bytes(r.payload)) for r in rows}

    @F.pandas_udf("boolean")
    def may_hold(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            k, out = part.to_numpy().astype(np.int64), np.zeros(len(part), bool)
            of = k % shards
            for shard, f in table.items():
                at = of == shard
                out[at] = f.contains(k[at].astype(np.uint64))
            yield pd.Series(out)

    return may_hold
