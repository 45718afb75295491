"""Exact and approximate vector search as block joins of queries and inverted lists.

Base vectors are put into lists by their nearest centroid, queries into the lists
they have to look at. A list is cut into pieces and its queries into packs of
bounded size; every (list, piece, pack) is a cell, and cells are the groups of one
co-grouped job: a matrix product per cell, ``k`` rows per query and cell out of it.
So neither side passes through the driver, plans do not depend on the number of
queries, and a hot list or a vector that very many rows share is many cells.

* Exact: a query skips a list when even the nearest vector its radius allows is
  farther than the k-th best vector of the sample.
* Approximate: a query looks at as many lists as the sample's neighbours need, scans
  4-bit codes of the vectors, and only the best few are scored exactly.

Centroids and code levels are fitted on a bounded sample (``SAMPLE`` rows by hash of
the id); every vector is indexed. Ids are unique on both sides; rows without a
vector are left out, zero vectors score 0 with everything.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .ordering import top_per_key

#: Rows that fit the quantiser, and the most lists they can train.
SAMPLE = 4_096
MAX_LISTS = 256
#: Rounds of the centroid fit; sample queries that choose the number of lists to look at.
ROUNDS = 3
TRIALS = 200
#: Share of the sample's neighbours that the lists looked at must hold.
COVERED = 0.98
#: Levels of a code, two codes to a byte.
LEVELS = 16
#: Numbers of a cell's base vectors, queries of a cell, and queries scored at a time.
CELL_VALUES = 1 << 21
CELL_QUERIES = 1_024
SLICE = 64
#: Candidates of the approximate search per row asked for.
CANDIDATES = 5

_PAIRS = "qid long, id long, score double"


class Quantiser(NamedTuple):
    """Centroids of the lists, per dimension the level edges and values, and the lists a query looks at."""

    centroids: np.ndarray
    edges: np.ndarray
    levels: np.ndarray
    probes: int
    sample: np.ndarray

    def nearness(self, unit: np.ndarray) -> np.ndarray:
        """Largest for the nearest centroid; rounded, so that equal distances are ties."""
        return np.round(unit @ self.centroids.T - (self.centroids**2).sum(axis=1) / 2, 9)

    def list_of(self, unit: np.ndarray) -> np.ndarray:
        return self.nearness(unit).argmax(axis=1)

    def lists_by_nearness(self, unit: np.ndarray) -> np.ndarray:
        return np.argsort(-self.nearness(unit), axis=1, kind="stable")

    def encode(self, unit: np.ndarray) -> np.ndarray:
        code = np.zeros(unit.shape, np.uint8)
        for j in range(self.edges.shape[1]):
            code += unit >= self.edges[:, j]
        if code.shape[1] % 2:
            code = np.hstack([code, np.zeros((len(code), 1), np.uint8)])
        return code[:, ::2] << 4 | code[:, 1::2]

    def decode(self, packed: np.ndarray) -> np.ndarray:
        dim = len(self.levels)
        code = np.stack([packed >> 4, packed & 15], axis=2).reshape(len(packed), -1)[:, :dim]
        return self.levels[np.arange(dim), code]


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _coarse(m: np.ndarray) -> np.ndarray:
    """Unit vectors to 7 digits: lists and codes do not hang on the last bit."""
    return np.round(_unit(m), 7)


def _hash(key: str) -> Column:
    """Multiplicative 32-bit hash of an id."""
    return F.pmod(F.pmod(F.col(key), F.lit(1 << 31)) * 2654435761, F.lit(1 << 32))


def _sample(base: DataFrame, n: int, size: int) -> np.ndarray:
    """Unit vectors of about ``size`` rows, those of smallest hash."""
    taken = base.withColumn("_h", _hash("id")).where(F.col("_h") < float(size << 32) / max(n, 1))
    return _coarse(_matrix(taken.orderBy("_h", "id").limit(2 * size).select("embedding").toArrow().column(0)))


def fit(base: DataFrame, n: int, lists: int, k: int = 10, sample: int = SAMPLE) -> Quantiser:
    """Quantiser of ``base(id, embedding)`` with ``n`` rows, from its sample."""
    u = _sample(base, n, sample)
    c = u[:lists].copy()
    for _ in range(ROUNDS):
        near = np.round(u @ c.T - (c**2).sum(axis=1) / 2, 9).argmax(axis=1)
        for j in range(len(c)):
            mine = u[near == j]
            if len(mine):
                c[j] = np.round(mine.mean(axis=0), 6)
    ordered, m = np.sort(u, axis=0), len(u)
    edges = ordered[[j * m // LEVELS for j in range(1, LEVELS)]].T
    levels = ordered[[(2 * j + 1) * m // (2 * LEVELS) for j in range(LEVELS)]].T
    known = Quantiser(c, edges, levels, 1, u)
    return known._replace(probes=_probes(known, k))


def _probes(q: Quantiser, k: int) -> int:
    """Lists that hold ``COVERED`` of the neighbours of the sample's first rows."""
    u, home = q.sample, q.list_of(q.sample)
    asked = u[:TRIALS]
    score = np.round(asked @ u.T, 6)
    score[np.arange(len(asked)), np.arange(len(asked))] = -2
    best = np.argsort(-score, axis=1, kind="stable")[:, : min(k, len(u) - 1)]
    place = np.argsort(q.lists_by_nearness(asked), axis=1, kind="stable")
    ranks = np.sort(np.take_along_axis(place, home[best], axis=1).reshape(-1))
    return int(ranks[int(np.ceil(COVERED * len(ranks))) - 1]) + 1 if len(ranks) else 1


def _best(qids: np.ndarray, q: np.ndarray, ids: np.ndarray, b: np.ndarray, k: int) -> pa.Table:
    """Best ``k`` rows of a cell per query by rounded score, ties by id.

    Score and place by id make one whole number, so a partial sort has no ties.
    """
    order = np.argsort(ids, kind="stable")
    ids, b = ids[order], b[order]
    n, k = len(ids), min(k, len(ids))
    found: list[list[np.ndarray]] = [[], [], []]
    for at in range(0, len(qids), SLICE):
        scores = np.rint((q[at : at + SLICE] @ b.T) * 1e6).astype(np.int64)
        keys = (2_000_000 - scores) * n + np.arange(n)
        top = np.sort(np.partition(keys, k - 1, axis=1)[:, :k], axis=1)
        found[0].append(np.repeat(qids[at : at + SLICE], k))
        found[1].append(ids[top % n].reshape(-1))
        found[2].append(((2_000_000 - top // n) / 1e6).reshape(-1))
    return pa.table({name: np.concatenate(part) for name, part in zip(("qid", "id", "score"), found, strict=True)})


def _number(values: dict[int, int], lists: int) -> Column:
    """Per-list whole number, 1 where a list has none."""
    return F.get(F.array(*[F.lit(values.get(j, 1)) for j in range(lists)]), F.col("list"))


def _cells(base: DataFrame, asked: DataFrame, held: dict[int, int], lists: int, rows: int, score) -> DataFrame:
    """Scores of every cell. ``base(list, id, ...)``, ``asked(list, qid, vector)``; ``held``: rows of each list."""
    asking = {r["list"]: r["n"] for r in asked.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
    pieces = _number({j: -(-n // rows) for j, n in held.items()}, lists)
    packs = _number({j: -(-n // CELL_QUERIES) for j, n in asking.items()}, lists)
    # rows that repeat an id are dealt out too
    piece = F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), pieces).cast("int")
    pack = F.pmod(F.xxhash64("qid"), packs).cast("int")
    # a list that nobody asks for is not read any further
    known = F.array(*[F.lit(j in asking) for j in range(lists)])
    left = base.where(F.get(known, F.col("list"))).withColumn("piece", piece).withColumn("pack", F.explode(F.sequence(F.lit(0), packs - 1)))
    right = asked.withColumn("pack", pack).withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
    keys = ["list", "piece", "pack"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, _PAIRS)


def _empty(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], _PAIRS + ", rank long")


def _exact_cell(k: int):
    def score(base: pa.Table, asked: pa.Table) -> pa.Table:
        if not base.num_rows or not asked.num_rows:
            return pa.table({"qid": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        q, b = _unit(_matrix(asked.column("vector"))), _unit(_matrix(base.column("embedding")))
        return _best(asked.column("qid").to_numpy(), q, base.column("id").to_numpy(), b, k)

    return score


def _angles(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def _place_exact(q: Quantiser):
    """Rows with their list and their angle to its centroid; zero vectors may be anywhere."""
    toward = _unit(q.centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                u = _unit(_matrix(b.column("embedding")))
                home = q.list_of(np.round(u, 7))
                angle = np.where(np.abs(u).sum(axis=1) > 0, _angles((u * toward[home]).sum(axis=1)), np.pi)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(home.astype(np.int32)), pa.array(angle)], [*b.schema.names, "list", "angle"])

    return run


def _lists_in_reach(q: Quantiser, radius: np.ndarray, k: int):
    """Lists that may hold one of the query's best ``k``; the sample's k-th best is a bound from below."""
    toward = _unit(q.centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                u = _unit(_matrix(b.column("vector")))
                seen = u @ q.sample.T
                bound = np.partition(seen, -k, axis=1)[:, -k] - 1e-5 if len(q.sample) >= k else np.full(len(u), -2.0)
                reach = np.cos(np.maximum(_angles(u @ toward.T) - radius, 0.0))
                lists = [np.flatnonzero(x).astype(np.int32) for x in reach >= bound[:, None]]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lists, pa.list_(pa.int32()))], [*b.schema.names, "lists"])

    return run


def _sides(queries: DataFrame, base: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (
        queries.select(F.col("qid").cast("long").alias("qid"), F.col("embedding").alias("vector")).where("vector IS NOT NULL"),
        base.select(F.col("id").cast("long").alias("id"), "embedding").where("embedding IS NOT NULL"),
    )


def _cast_like(df: DataFrame, more: str) -> str:
    return ", ".join(f"{n} {t}" for n, t in df.dtypes) + ", " + more


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    top = top_per_key(scored, ["qid"], [F.col("score").desc(), F.col("id")], k)
    return top.select("qid", "id", "score", "rank")


def vector_topk(queries: DataFrame, base: DataFrame, k: int = 10, cell_rows: int | None = None) -> DataFrame:
    """Nearest vectors by cosine, exact: ``qid, id, score, rank``. ``queries(qid, embedding)``, ``base(id, embedding)``.

    Scores are rounded to 6 digits, ties go to the smaller id. Up to ``cell_rows``
    vectors are one list; more are put into lists with a radius.
    """
    queries, base = _sides(queries, base)
    n, dim = base.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    if not n:
        return _empty(base)
    rows = cell_rows or max(CELL_VALUES // max(dim, 1), 1)
    lists = min(MAX_LISTS, -(-n // rows))
    if lists == 1:
        placed, held = base.withColumn("list", F.lit(0)), {0: n}
        asked = queries.withColumn("list", F.lit(0))
    else:
        known = fit(base, n, lists, k)
        lists = len(known.centroids)
        placed = materialize(base.mapInArrow(_place_exact(known), _cast_like(base, "list int, angle double")), "listed")
        sizes = placed.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius")).collect()
        held = {r["list"]: r["n"] for r in sizes}
        radius = np.full(lists, -np.pi)
        radius[list(held)] = [r["radius"] + 1e-6 for r in sizes]
        near = queries.mapInArrow(_lists_in_reach(known, radius, k), _cast_like(queries, "lists array<int>"))
        asked = near.select("qid", "vector", F.explode("lists").alias("list"))
        asked = asked.where(F.get(F.array(*[F.lit(j in held) for j in range(lists)]), F.col("list")))
    return _ranked(_cells(placed.drop("angle"), asked, held, lists, rows, _exact_cell(k)), k)


def lists_for(n: int) -> int:
    """Lists of the approximate search: half the square root of the rows, as far as the sample can train them."""
    return max(1, min(MAX_LISTS, round(n**0.5 / 2)))


def _encode(q: Quantiser):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                u = _coarse(_matrix(b.column("embedding")))
                packed = q.encode(u)
                codes = pa.FixedSizeBinaryArray.from_buffers(pa.binary(packed.shape[1]), len(packed), [None, pa.py_buffer(packed.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), pa.array(q.list_of(u).astype(np.int32)), codes.cast(pa.binary())], ["id", "list", "code"]
                )

    return run


def _probe(q: Quantiser):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                lists = q.lists_by_nearness(_coarse(_matrix(b.column("vector"))))[:, : q.probes]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(lists.astype(np.int32)), pa.list_(pa.int32()))], [*b.schema.names, "lists"])

    return run


def _code_cell(q: Quantiser, k: int):
    def score(base: pa.Table, asked: pa.Table) -> pa.Table:
        if not base.num_rows or not asked.num_rows:
            return pa.table({"qid": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        codes = base.column("code").combine_chunks()
        packed = np.frombuffer(b"".join(codes.to_pylist()), np.uint8).reshape(len(codes), -1)
        return _best(asked.column("qid").to_numpy(), _coarse(_matrix(asked.column("vector"))), base.column("id").to_numpy(), q.decode(packed), k)

    return score


def candidates(queries: DataFrame, base: DataFrame, k: int = 10, lists: int | None = None) -> DataFrame:
    """``qid, id``: the ``CANDIDATES * k`` rows per query whose codes score best in the lists looked at."""
    queries, base = _sides(queries, base)
    n, dim = base.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    if not n:
        return _empty(base).select("qid", "id")
    known = fit(base, n, lists or lists_for(n), k)
    coded = materialize(base.mapInArrow(_encode(known), "id long, list int, code binary"), "coded")
    held = {r["list"]: r["n"] for r in coded.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
    near = queries.mapInArrow(_probe(known), _cast_like(queries, "lists array<int>"))
    asked = near.select("qid", "vector", F.explode("lists").alias("list"))
    rows = max(CELL_VALUES // max(dim, 1), 1)
    scored = _cells(coded, asked, held, len(known.centroids), rows, _code_cell(known, CANDIDATES * k))
    return _ranked(scored, CANDIDATES * k).select("qid", "id")


def approx_vector_topk(queries: DataFrame, base: DataFrame, k: int = 10, lists: int | None = None) -> DataFrame:
    """Nearest vectors by cosine among the candidates that inverted lists and codes give; their scores are exact."""
    pairs = candidates(queries, base, k, lists)

    def doubles(df: DataFrame, name: str, out: str) -> DataFrame:
        return df.where("embedding IS NOT NULL").select(F.col(name).cast("long").alias(name), F.transform("embedding", lambda x: x.cast("double")).alias(out))

    def dot(x: str, y: str) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v)

    norm = F.sqrt(dot("_q", "_q")) * F.sqrt(dot("_b", "_b"))
    score = F.when(norm > 0, F.round(dot("_q", "_b") / norm, 6)).otherwise(0.0)
    rescored = pairs.join(doubles(base, "id", "_b"), "id").join(doubles(queries, "qid", "_q"), "qid")
    return _ranked(rescored.select("qid", "id", score.alias("score")), k)
