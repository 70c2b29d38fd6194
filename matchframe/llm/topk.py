"""Exact top-k inner products by the three-phase uniform threshold.

A score is the sum of the partial scores of m slices of the dimensions, each of which gives every block of vectors a
local score list. (1) Each block sends, per query, the exact scores of the heads of its local lists; the k-th best of
all of them is a score that k vectors reach, so a safe cutoff. (2) With the cutoff t, a vector that reaches t has a
partial score of t/m or more in some slice, since m smaller ones sum to less; each block collects the entries of its
lists from t/m on. (3) Their remaining partial scores are resolved exactly, and those that reach t are ranked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchframe.llm.store import stored

SCALE = 1024
#: Vectors and queries of a block, slices of the dimensions, and copies of the query blocks that vector blocks meet.
BLOCK, QUERIES, SLICES, COPIES = 4096, 512, 2, 64


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of vectors of equal length: (dim, ids, mat) with 64-bit numbers as bytes."""
    schema = "dim int, ids binary, mat binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            vec = b.column(1)
            sizes = np.diff(vec.offsets.to_numpy())
            flat = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            at = np.concatenate([[0], np.cumsum(sizes)])
            out = []
            for dim in np.unique(sizes):
                own = np.flatnonzero(sizes == dim)
                for k in range(0, len(own), size):
                    part = own[k : k + size]
                    mat = np.floor(flat[at[part][:, None] + np.arange(dim)] * SCALE).astype(np.int64)
                    out.append((int(dim), ids[part].astype(np.int64).tobytes(), mat.tobytes()))
            cols = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["dim", "ids", "mat"])

    return rows.mapInArrow(run, schema)


def _product(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer products; in floating point only where all sums stay below 2^53."""
    if not q.size or not x.size:
        return np.zeros((len(q), len(x)), np.int64)
    if float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] < 2**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q @ x.T


def _open(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[slice]]:
    dim = row["dim"]
    ids, qids = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["qids"], np.int64)
    x, q = np.frombuffer(row["mat"], np.int64).reshape(-1, dim), np.frombuffer(row["qmat"], np.int64).reshape(-1, dim)
    cuts = np.linspace(0, dim, min(SLICES, max(1, dim)) + 1).astype(int)
    return ids, x, qids, q, [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _rows(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    cols = [np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3)]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])


def _heads(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                ids, x, qids, q, slices = _open(row)
                total, own = np.zeros((len(q), len(x)), np.int64), qids[:, None] == ids[None, :]
                picked = np.zeros(total.shape, bool)
                for s in slices:
                    part = _product(q[:, s], x[:, s])
                    total += part
                    part[own] = np.iinfo(np.int64).min
                    head = np.argpartition(-part, min(k, part.shape[1] - 1), axis=1)[:, :k]
                    np.put_along_axis(picked, head, True, axis=1)
                picked &= ~own
                i, j = np.nonzero(picked)
                # only a block's k best can matter for the cutoff
                order = np.lexsort((ids[j], -total[i, j], i))
                i, j = i[order], j[order]
                place = np.arange(len(i)) - np.searchsorted(i, i, side="left")
                i, j = i[place < k], j[place < k]
                yield _rows([(qids[i], ids[j], total[i, j])])

    return run


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row in b.to_pylist():
            ids, x, qids, q, slices = _open(row)
            cutoff = np.frombuffer(row["cutoffs"], np.int64)
            entry = np.zeros((len(q), len(x)), bool)
            for s in slices:
                entry |= _product(q[:, s], x[:, s]) * len(slices) >= cutoff[:, None]
            entry &= qids[:, None] != ids[None, :]
            i, j = np.nonzero(entry)
            found = []
            for k in range(0, len(i), 1 << 16):
                a, c = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                score = np.einsum("nd,nd->n", q[a], x[c])
                good = score >= cutoff[a]
                found.append((qids[a[good]], ids[c[good]], score[good]))
            yield _rows(found)


def usable(vector: Column) -> Column:
    """Vectors that take part: not null, and no component null or not finite."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of every query, ties to the smaller vec_id.

    Vectors with a null id, null vectors and those with a null or non-finite component take no part. Rows with the query's
    id are its own and no candidates; a repeated query row is one query, a repeated candidate row stays repeated.
    Vectors of different lengths are not compared. Fewer than k candidates are all returned.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("is_query"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("v")))
    salt = F.pmod(F.xxhash64("ids"), F.lit(COPIES)).cast("int")
    blocks = stored(_packed(rows.select("id", "v"), BLOCK).withColumn("salt", salt))
    asked = rows.where("is_query").select("id", "v").dropDuplicates(["id"])
    asked = _packed(asked, QUERIES).select(F.col("dim").alias("dim"), F.col("ids").alias("qids"), F.col("mat").alias("qmat"))
    asked = stored(asked.withColumn("block", F.xxhash64("qids")))
    spread = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    types = "query_id long, vec_id long, score long"
    heads = blocks.join(spread, ["salt", "dim"]).select("dim", "ids", "mat", "qids", "qmat").mapInArrow(_heads(k), types)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    cutoff = heads.withColumn("place", F.row_number().over(best)).where(F.col("place") == k).select("query_id", F.col("score").alias("cutoff"))
    cutoff = stored(cutoff)
    # the cutoffs of a query block, in its order; with fewer than k heads every score is above
    each = asked.mapInArrow(_query_ids, "block long, at int, query_id long").join(cutoff, "query_id", "left")
    each = each.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("cutoff", F.lit(-(2**62))).alias("cutoff")))).alias("cutoffs"))
    told = asked.join(each, "block").mapInArrow(_tell, "dim int, qids binary, qmat binary, cutoffs binary")
    told = told.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    found = blocks.join(told, ["salt", "dim"]).select("dim", "ids", "mat", "qids", "qmat", "cutoffs").mapInArrow(_resolve, types)
    out = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _query_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row in b.to_pylist():
            ids = np.frombuffer(row["qids"], np.int64)
            cols = [pa.array([row["block"]] * len(ids), pa.int64()), pa.array(range(len(ids)), pa.int32()), pa.array(ids, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["block", "at", "query_id"])


def _tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row in b.to_pylist():
            cut = np.array([c["cutoff"] for c in row["cutoffs"]], np.int64).tobytes()
            cols = [pa.array([row["dim"]], pa.int32()), *(pa.array([x], pa.binary()) for x in (row["qids"], row["qmat"], cut))]
            yield pa.RecordBatch.from_arrays(cols, names=["dim", "qids", "qmat", "cutoffs"])


#: DuckDB twin of the contract's query over ``embeddings``.
ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
