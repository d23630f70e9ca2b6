"""Exact top-k search by inner product with a three-phase uniform threshold.

Vectors become integers floor(1024 * x) and are cut into slices of their dimensions;
a vector's score is the sum of its slices' partial scores.

1. Every block of vectors lists, for each query and slice, its k highest partial
   scores; those vectors' whole scores are gathered and the k-th best is the query's
   safe cutoff (a k-th best over some vectors is no higher than over all).
2. The cutoffs go out with the queries. A vector below cutoff / slices in every slice
   can't reach the cutoff; the others are collected.
3. Their whole scores are computed exactly, and each block hands on the k best.

Vectors are packed into blocks of at most ``ROW_BLOCK`` rows where they are read, queries
into blocks of at most ``QUERY_BLOCK`` rows, and both are written. In each phase a vector
block moves once, to its lane, and a task pairs its lane's blocks with the query blocks that
it reads, about ``QUERY_BYTES`` of them: with more, other tasks read the lane again, one for
each further part. No side is broadcast or copied on the way, so none passes through the
driver.

Defined cases: vectors that are null, or hold null or non-finite components, take no
part, as query or as candidate; missing components of a shorter vector count as zero;
ties go to the smaller id; repeated ids are searched row by row, each row of a query's id
with k ranks of its own (a query's own id is never its candidate); with fewer than k
candidates all are returned; an empty table gives an empty result. Scores are exact:
products that could leave 53 bits are summed as Python integers, and a score beyond 64 bits
counts as the greatest or least 64-bit number.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assay.llm.batches import shuffle_width, written
from assay.session import ship_package

SCALE = 1024
QUERY_BLOCK = 256
ROW_BLOCK = 2048
#: Components of queries that a task pairs with its vectors.
QUERY_BYTES = 32 << 20
SLICES = 4


LEAST, GREATEST = -2 ** 63, 2 ** 63 - 1


def to_integer(x: float) -> int:
    """floor(1024 * x), also where the product is beyond a double."""
    return math.floor(x * SCALE) if abs(x) < 2.0 ** 1000 else int(x) * SCALE


def _pack(ids: list, rows: list[np.ndarray]) -> dict:
    width = max((len(r) for r in rows), default=0)
    mat = np.zeros((len(rows), width), rows[0].dtype if rows else np.float64)
    for i, r in enumerate(rows):
        mat[i, :len(r)] = r
    return {"ids": np.array(ids, np.int64).tobytes(), "mat": mat.tobytes(), "width": width}


def _usable(ids, vectors) -> tuple[list, list[np.ndarray]]:
    """Ids and components of the rows that take part."""
    got, rows = [], []
    for i, v in zip(ids.to_pylist(), vectors, strict=True):
        if i is None or not v.is_valid or v.values.null_count:
            continue
        x = v.values.to_numpy(zero_copy_only=False)
        x = x.astype(np.float32 if x.dtype == np.float32 else np.float64, copy=False)
        if np.isfinite(x).all():
            got.append(i)
            rows.append(x)
    return got, rows


BLOCK_SCHEMA = "ids binary, mat binary, width int"


def _packed(df: DataFrame, id_col: str, vec_col: str, size: int) -> DataFrame:
    """Blocks of at most ``size`` vectors: ids, components, width."""
    def run(it):
        for batch in it:
            for a in range(0, batch.num_rows, size):
                part = batch.slice(a, size)
                ids, rows = _usable(part.column(0), part.column(1))
                if ids:
                    yield pa.RecordBatch.from_pylist([_pack(ids, rows)], pa.schema(
                        [("ids", pa.binary()), ("mat", pa.binary()), ("width", pa.int32())]))

    return df.select(id_col, vec_col).mapInArrow(run, BLOCK_SCHEMA)


def _matrix(mat: bytes, n: int, width: int, wide: int) -> np.ndarray:
    """The ``n`` rows of a block in doubles, ``wide`` components each."""
    m = np.frombuffer(mat, np.float32 if len(mat) == 4 * n * width else np.float64).reshape(n, width).astype(np.float64, copy=False)
    return m if width == wide else np.pad(m, ((0, 0), (0, wide - width)))


def _partials(q: np.ndarray, d: np.ndarray, slices: int) -> list[np.ndarray]:
    """Exact partial scores by slice (float64 where they fit 53 bits, else Python integers)."""
    big = max((float(np.abs(x).max()) if x.size else 0.0) for x in (q, d))
    if big < 2.0 ** 53 and (SCALE * big + 1) ** 2 * max(1, q.shape[1]) < 2.0 ** 53:
        q, d = np.floor(q * SCALE), np.floor(d * SCALE)  # exact: a power of two only moves the exponent
    else:
        q, d = (np.array([[to_integer(v) for v in row] for row in x.tolist()], dtype=object).reshape(x.shape) for x in (q, d))
    cuts = np.linspace(0, q.shape[1], slices + 1).astype(int)
    return [q[:, a:b] @ d[:, a:b].T for a, b in zip(cuts, cuts[1:])]


def _whole(parts: list[np.ndarray]) -> np.ndarray:
    """Sums of the partial scores, held to 64 bits."""
    whole = sum(parts[1:], start=parts[0])
    return np.minimum(np.maximum(whole, LEAST), GREATEST) if whole.dtype == object else whole


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest, ties to the smaller id."""
    if len(score) > k and score.dtype != object:
        floor = np.partition(score, len(score) - k)[len(score) - k]
        keep = np.flatnonzero(score >= floor)
    else:
        keep = np.arange(len(score))
    if score.dtype == object:
        return np.array(sorted(keep.tolist(), key=lambda j: (-score[j], ids[j]))[:k], np.int64)
    return keep[np.lexsort((ids[keep], -score[keep]))[:k]]


def _listed(q, qids, _, d, ids, k, slices):
    """Phase 1: whole scores of the vectors on a slice's list, the k best of them."""
    parts = _partials(q, d, slices)
    whole = _whole(parts)
    for i, own in enumerate(qids.tolist()):
        ok = np.flatnonzero(ids != own)
        listed = set()
        for p in parts:
            listed.update(ok[_best(p[i, ok], ids[ok], k)].tolist())
        at = np.array(sorted(listed), np.int64)
        for j in at[_best(whole[i, at], ids[at], k)].tolist():
            yield i, own, int(ids[j]), int(whole[i, j])


def _resolved(q, qids, cutoffs, d, ids, k, slices):
    """Phases 2 and 3: collect by the uniform threshold, then whole scores of those."""
    parts = _partials(q, d, slices)
    for i, own in enumerate(qids.tolist()):
        cut = cutoffs.get(i, LEAST)
        reach = np.full(len(ids), cut == LEAST)
        if cut != LEAST:
            for p in parts:
                reach |= np.array(p[i] * slices >= cut, bool)
        at = np.flatnonzero(reach & (ids != own))
        whole = _whole([p[i, at] for p in parts])
        if cut != LEAST:
            keep = np.array(whole >= cut, bool)
            at, whole = at[keep], whole[keep]
        for j in _best(whole, ids[at], k).tolist():
            yield i, own, int(ids[at[j]]), int(whole[j])


FOUND = pa.schema([("qb", pa.int64()), ("place", pa.int32()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _search(pairs: DataFrame, fn, k: int, slices: int) -> DataFrame:
    """Of each pair of blocks the entries that ``fn`` finds; ``place`` is the query's in its block."""
    def run(it):
        for batch in it:
            for n in range(batch.num_rows):
                r = batch.slice(n, 1).to_pylist()[0]
                wide = max(r["width"], r["q_width"])
                ids, qids = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["q_ids"], np.int64)
                d, q = _matrix(r["mat"], len(ids), r["width"], wide), _matrix(r["q_mat"], len(qids), r["q_width"], wide)
                cutoffs = {c["place"]: c["cutoff"] for c in r.get("cutoffs") or ()}
                out = [(r["qb"], *x) for x in fn(q, qids, cutoffs, d, ids, k, slices)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), FOUND, strict=True)], schema=FOUND)

    return pairs.mapInArrow(run, "qb bigint, place int, query_id bigint, vec_id bigint, score bigint")


def top_k(df: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 100,
          k: int = 10, slices: int = SLICES) -> DataFrame:
    """The k highest integer inner products of each query (rows whose id is divisible by
    ``every``) against all other rows: query_id, rank, vec_id, score."""
    spark = df.sparkSession
    ship_package(spark)
    lanes = max(8, shuffle_width(spark))
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vec_col}`").alias("vec")).filter("id is not null and vec is not null")
    asked = rows.filter(F.col("id") % every == 0)
    queries = written(_packed(asked.hint("rebalance"), "id", "vec", QUERY_BLOCK).select(
        F.monotonically_increasing_id().alias("qb"), *[F.col(c).alias(f"q_{c}") for c in ("ids", "mat", "width")]), "queries")
    blocks = written(_packed(rows, "id", "vec", ROW_BLOCK), "vectors")
    # lanes spread the blocks over tasks, evenly
    spread = blocks.repartition(max(1, min(lanes, blocks.count())))
    size = queries.agg(F.sum(F.octet_length("q_ids") * F.col("q_width").cast("long"))).first()[0] or 0
    parts = max(1, -(-size // QUERY_BYTES))

    def paired(asked_by: DataFrame) -> DataFrame:
        """Each vector block with each query block. Without the hint Spark would send the
        queries through the driver, by an estimate that knows the files' size alone."""
        return spread.crossJoin(asked_by.coalesce(parts).hint("shuffle_replicate_nl"))

    listed = _search(paired(queries), _listed, k, slices)
    by_score = Window.partitionBy("qb", "place").orderBy(F.desc("score"), "vec_id")
    cutoffs = written(listed.withColumn("r", F.row_number().over(by_score)).filter(f"r = {k}")
                      .select("qb", "place", F.col("score").alias("cutoff")), "cutoffs")

    held = cutoffs.groupBy("qb").agg(F.collect_list(F.struct("place", "cutoff")).alias("cutoffs"))  # of a block's queries
    cut = written(queries.join(held.hint("merge"), "qb", "left"), "cut-queries")
    found = _search(paired(cut), _resolved, k, slices)
    return (found.withColumn("rank", F.row_number().over(by_score)).filter(f"rank <= {k}")
            .select("query_id", F.col("rank").cast("int"), "vec_id", "score"))
