"""Encoders of texts as a plug-in: whatever turns a list of texts into vectors, run in Arrow batches on executors.

No weights come with the package; `retrieval.hashed_vectors` needs none and is the built-in choice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import prepare

#: Texts that an encoder gets at once.
BATCH = 256


class Encoder(Protocol):
    """What a model must offer; load() runs once in a worker's task, so that weights are never in the plan."""

    dimension: int
    query_prefix: str

    def load(self) -> Callable[[list[str]], np.ndarray]: ...


@dataclass(frozen=True)
class FunctionEncoder:
    """An encoder made of a function that returns the encoding function."""

    dimension: int
    loader: Callable[[], Callable[[list[str]], np.ndarray]]
    query_prefix: str = ""

    def load(self) -> Callable[[list[str]], np.ndarray]:
        return self.loader()


def encoded(rows: DataFrame, id_: str, text: str, encoder: Encoder, queries: bool = False) -> DataFrame:
    """id, vector of every row, at unit length; a null text is encoded as an empty one, questions after their prefix.

    A vector without length stays zero; one of another dimension or not finite fails.
    """
    prepare(rows.sparkSession)
    prefix = encoder.query_prefix if queries else ""
    kind = rows.schema[id_].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder.load()
        for part in parts:
            for at in range(0, len(part), BATCH):
                some = part.iloc[at : at + BATCH]
                found = np.asarray(encode([prefix + t for t in some["text"]]), dtype=np.float64)
                if found.shape != (len(some), encoder.dimension) or not np.isfinite(found).all():
                    raise ValueError(f"encoder gave {found.shape}, not finite ({len(some)}, {encoder.dimension})")
                length = np.linalg.norm(found, axis=1, keepdims=True)
                yield pd.DataFrame({"id": some["id"], "vector": list(found / np.where(length > 0, length, 1))})

    asked = rows.select(F.col(id_).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return asked.mapInPandas(run, f"id {kind}, vector array<double>")
