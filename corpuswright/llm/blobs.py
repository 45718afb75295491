"""Shuffles of numpy arrays: a row holds the arrays of one bucket from one flush of a task."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import words


def partitions(df: DataFrame) -> int:
    """Buckets of a shuffle, one task each: twice the cluster's own setting, which grows with its inputs."""
    return 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def schema(n: int) -> str:
    return "bucket int, kind int, " + ", ".join(f"a{i} binary" for i in range(n))


def _planes(a: np.ndarray) -> bytes:
    """Differences of 64-bit integers, first bytes first: sorted ids then compress to about a byte each."""
    if a.dtype == np.int64:
        a = np.diff(a, prepend=np.int64(0))
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes()


def _values(raw: pa.Buffer, dtype) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    a = np.ascontiguousarray(planes.T).view(dtype).reshape(-1)
    return np.cumsum(a) if a.dtype == np.int64 else a


def pack(kind: int, bucket: np.ndarray, arrays: Sequence[np.ndarray], width: int) -> Iterator[pa.RecordBatch]:
    """Rows of one flush, one per bucket in use; ``arrays`` run parallel to ``bucket``."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    starts = np.flatnonzero(words.firsts(bucket))
    ends = np.r_[starts[1:], len(bucket)]
    columns = []
    for a in arrays:
        a = np.ascontiguousarray(a[order])
        columns.append(pa.array([_planes(a[s:e]) for s, e in zip(starts, ends, strict=True)], pa.binary()))
    columns += [pa.nulls(len(starts), pa.binary())] * (width - len(columns))
    yield pa.RecordBatch.from_arrays(
        [pa.array(bucket[starts].astype(np.int32)), pa.array(np.full(len(starts), kind, np.int32)), *columns],
        ["bucket", "kind", *[f"a{i}" for i in range(width)]],
    )


def gather(batches, dtypes: dict[int, Sequence[np.dtype]]) -> dict[int, list[np.ndarray]]:
    """All rows of a task as whole arrays by kind; ``bucket`` repeated per element comes first."""
    found: dict[int, list[list[np.ndarray]]] = {k: [[] for _ in range(len(d) + 1)] for k, d in dtypes.items()}
    for batch in batches:
        kinds, buckets = batch.column(1).to_pylist(), batch.column(0).to_pylist()
        for i, kind in enumerate(kinds):
            parts = [_values(batch.column(j + 2)[i].as_buffer(), t) for j, t in enumerate(dtypes[kind])]
            found[kind][0].append(np.full(len(parts[0]), buckets[i], np.int64))
            for j, p in enumerate(parts):
                found[kind][j + 1].append(p)
    types = {k: [np.int64, *d] for k, d in dtypes.items()}
    return {
        k: [np.concatenate(p) if p else np.zeros(0, t) for p, t in zip(parts, types[k], strict=True)]
        for k, parts in found.items()
    }
