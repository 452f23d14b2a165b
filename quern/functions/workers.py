"""Things that a Python worker makes once: models, tokenizers."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import pyspark.sql.types as T
from pyspark.sql import DataFrame

_MADE: dict[str, Any] = {}
_LOCK = threading.Lock()


def once(name: str, make: Callable[[], Any]) -> Any:
    """What ``make`` gave at the first call under this name in this process."""
    with _LOCK:
        if name not in _MADE:
            _MADE[name] = make()
        return _MADE[name]


def embed(texts: DataFrame, make: Callable[[], Callable[[list[str]], list[list[float]]]], name: str = "embedder", id_col: str = "query_id", batch: int = 64) -> DataFrame:
    """(id, vector) by a model that each worker makes once; it gets lists of at most ``batch`` texts (null: empty)."""
    schema = T.StructType([texts.schema[id_col], T.StructField("vector", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = once(name, make)
        for b in batches:
            for lo in range(0, b.num_rows, batch):
                part = b.slice(lo, batch)
                vectors = model([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(vectors, pa.list_(pa.float32()))], [id_col, "vector"])

    return texts.select(id_col, "text").mapInArrow(run, schema)
