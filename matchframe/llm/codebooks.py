"""Vector code compression: product codes whose nearest entries come from equal-average search.

A vector of integers is cut into parts; each part is replaced by the index of the nearest entry of that part's codebook.
For a part x of d components and an entry y, the gap between their component sums bounds the distance from below:
``(sum x - sum y)^2 <= d * |x - y|^2``. So entries are sorted by their sum, the search starts at the part's own sum and
goes outward on both sides, and ends on a side once the squared gap over d strictly exceeds the best distance found
(an entry at the same distance may still have the lower index). Everything is in 64-bit integers, so the result is exact.

Codebooks are fitted by rounds of assignment and mean. Workers send one count and one sum of components for each entry
they used; the driver holds the codebooks only (entries times components numbers for each length of vectors).

Rows whose vector is null or holds null or non-finite components are dropped. Components beyond a limit at which squared
distances would leave 64 bits (for 64 components +-2^27, so x beyond 500,000) are held at that limit. Vectors of another
length have codebooks of their own, from their own smallest ids; a length that the parts do not divide is cut as evenly as
it goes. An id counts once as a seed (its least vector); rows with a null id are coded but are no seeds, and where a
length has such rows only, its codebooks are empty and code and error are null. Repeated rows stay repeated. With fewer
ids than entries the codebooks have fewer entries; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchframe.llm.store import stored

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2

#: A codebook per part: integers of shape (entries, components).
Codebooks = list[np.ndarray]


def usable(vector: Column) -> Column:
    """Not null, and no component null or not finite."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def limit_of(dim: int) -> int:
    """The largest component for which all squared distances of whole vectors fit 64 bits."""
    return isqrt((1 << 62) // max(1, dim)) // 2


def cuts_of(dim: int, parts: int) -> list[tuple[int, int]]:
    return [(dim * p // parts, dim * (p + 1) // parts) for p in range(parts)]


def integers(flat: np.ndarray, dim: int, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) as 64-bit integers, held at the limit of this length."""
    most = float(limit_of(dim))
    with np.errstate(over="ignore"):
        return np.clip(np.floor(flat * float(scale)), -most, most).astype(np.int64)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(index, squared distance) of the nearest entry of every row, ties to the lower index, and how many distances it took."""
    n, d = x.shape
    k = len(book)
    sums = book.sum(axis=1)
    order = np.lexsort((np.arange(k), sums))
    ranked, ranked_sums = book[order], sums[order]
    own = x.sum(axis=1)
    best = np.full(n, np.iinfo(np.int64).max, np.int64)
    index = np.full(n, k, np.int64)
    middle = np.searchsorted(ranked_sums, own)
    taken = 0
    # rows still searching on a side, and the sorted place they look at next
    sides = [(np.arange(n), middle.copy(), 1), (np.arange(n), middle - 1, -1)]
    while any(len(rows) for rows, _, _ in sides):
        for s, (rows, at, step) in enumerate(sides):
            inside = (at >= 0) & (at < k)
            rows, at = rows[inside], at[inside]
            gap = own[rows] - ranked_sums[at]
            near = gap * gap <= _times(best[rows], d)
            rows, at = rows[near], at[near]
            if len(rows):
                off = x[rows] - ranked[at]
                distance = np.einsum("nd,nd->n", off, off)
                taken += len(rows)
                better = (distance < best[rows]) | ((distance == best[rows]) & (order[at] < index[rows]))
                best[rows[better]], index[rows[better]] = distance[better], order[at[better]]
            sides[s] = (rows, at + step, step)
    return index, best, taken


def _times(a: np.ndarray, d: int) -> np.ndarray:
    """a * d, held at the largest 64-bit number."""
    top = np.iinfo(np.int64).max
    return np.where(a > top // max(1, d), top, a * max(1, d))


def encode(x: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """(indexes of shape (rows, parts), squared distance summed over parts)."""
    codes, error = np.zeros((len(x), len(books)), np.int64), np.zeros(len(x), np.int64)
    for p, (a, b) in enumerate(cuts_of(x.shape[1], len(books))):
        codes[:, p], distance, _ = nearest(x[:, a:b], books[p])
        error += distance
    return codes, error


def decode(codes: np.ndarray, books: Codebooks) -> np.ndarray:
    """The integer vectors that codes stand for."""
    return np.concatenate([books[p][codes[:, p]] for p in range(len(books))], axis=1)


def text_of(books: Codebooks) -> str:
    """All components in decimal by part, entry and position, joined by commas."""
    return ",".join(str(v) for book in books for v in book.ravel().tolist())


def _groups(b: pa.RecordBatch, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, integer matrix) of the rows of each length; the vector is the second column."""
    vec = b.column(1)
    sizes = np.diff(vec.offsets.to_numpy())
    flat = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    at = np.concatenate([[0], np.cumsum(sizes)])
    for dim in np.unique(sizes):
        own = np.flatnonzero(sizes == dim)
        yield own, integers(flat[at[own][:, None] + np.arange(dim)], int(dim), scale)


def _kept(vectors: DataFrame, id_col: str, vector: str, *more: Column) -> DataFrame:
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), *more)
    return rows.where(usable(F.col("v")))


def seeds(rows: DataFrame, parts: int, entries: int, scale: int) -> dict[int, Codebooks]:
    """For each length of vectors the parts of the smallest ids, ascending; at most ``entries`` vectors a length are gathered."""
    out: dict[int, Codebooks] = {}
    dims = [r[0] for r in rows.select(F.size("v").alias("dim")).distinct().collect()]
    for dim in sorted(dims):
        own = rows.where((F.size("v") == dim) & F.col("id").isNotNull())
        first = own.groupBy("id").agg(F.min("v").alias("v")).orderBy("id").limit(entries).collect()
        whole = integers(np.array([r["v"] for r in first], np.float64).reshape(len(first), dim), dim, scale)
        out[dim] = [whole[:, a:b].copy() for a, b in cuts_of(dim, parts)]
    return out


def _means(rows: DataFrame, books: dict[int, Codebooks], scale: int) -> dict[int, Codebooks]:
    """Codebooks after one round: each entry the floored mean of the parts assigned to it; unused entries stay."""
    sent = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for b in batches:
            for _, x in _groups(b, scale):
                dim = x.shape[1]
                own = sent.value[dim]
                if not len(own[0]):
                    continue
                codes, _ = encode(x, own)
                found = total.setdefault(dim, [(np.zeros(len(c), np.int64), np.zeros(c.shape, np.int64)) for c in own])
                for p, (lo, hi) in enumerate(cuts_of(dim, len(own))):
                    found[p][0][:] += np.bincount(codes[:, p], minlength=len(own[p]))
                    np.add.at(found[p][1], codes[:, p], x[:, lo:hi])
        # the count stands before the sums
        out = [(dim, p, int(e), [int(count[e]), *sums[e].tolist()]) for dim, found in total.items() for p, (count, sums) in enumerate(found) for e in np.flatnonzero(count)]
        cols = list(zip(*out, strict=True)) or [[]] * 4
        types = [pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["dim", "part", "entry", "sums"])

    used = rows.mapInArrow(run, "dim int, part int, entry int, sums array<long>")
    # decimals, as sums over very many rows may leave 64 bits
    total = used.select("dim", "part", "entry", F.posexplode("sums").alias("at", "s")).groupBy("dim", "part", "entry", "at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    sums = {(r["dim"], r["part"], r["entry"], r["at"]): int(r["s"]) for r in total.collect()}
    after = {dim: [b.copy() for b in own] for dim, own in books.items()}
    for (dim, p, e, at), s in sums.items():
        if at:
            after[dim][p][e, at - 1] = s // sums[dim, p, e, 0]
    return after


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> dict[int, Codebooks]:
    """Codebooks by length of vectors, from rows (id, v) of usable vectors; one pass over the rows a round."""
    books = seeds(rows, parts, entries, scale)
    for _ in range(rounds):
        books = _means(rows, books, scale)
    return books


def compress(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
    id_col: str = "vec_id", vector: str = "embedding", label: str = "label",
) -> DataFrame:
    """(vec_id, label, code, error, codebooks_sha256) of every usable vector; code has two hexadecimal digits a part."""
    if entries > 256:
        raise ValueError("a code digit pair holds 256 entries at most")
    kept = _kept(vectors, id_col, vector, F.col(label).alias("label"))
    books = fit(kept.select("id", "v"), parts, entries, rounds, scale)
    shas = {dim: hashlib.sha256(text_of(own).encode()).hexdigest() for dim, own in books.items()}
    sent = kept.sparkSession.sparkContext.broadcast((books, shas))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, error, sha = [None] * b.num_rows, [None] * b.num_rows, [""] * b.num_rows
            for rows, x in _groups(b, scale):
                own = sent.value[0][x.shape[1]]
                for r in rows:
                    sha[r] = sent.value[1][x.shape[1]]
                if len(own[0]):
                    codes, distance = encode(x, own)
                    for r, c, e in zip(rows.tolist(), codes.astype(np.uint8), distance.tolist(), strict=True):
                        code[r], error[r] = c.tobytes().hex(), e
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(code, pa.string()), pa.array(error, pa.int64()), pa.array(sha, pa.string()), b.column(2)], names=["vec_id", "code", "error", "codebooks_sha256", "label"])

    kind = dict(kept.dtypes)["label"]
    return kept.select("id", "v", "label").mapInArrow(run, f"vec_id long, code string, error long, codebooks_sha256 string, label {kind}")


def digest(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256): label_error sums error over equal labels, nulls together."""
    coded = stored(compress(vectors))
    # partial sums leave one row a label and task, so a hot label is no hot task; the join's skew is AQE's to split
    by_label = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"))
    by_label = by_label.withColumnRenamed("label", "own_label")
    joined = coded.join(by_label, F.col("label").eqNullSafe(F.col("own_label")))
    return joined.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _oracle() -> str:
    """DuckDB twin of the contract's query: one part per row, all entries tried, two rounds of means."""
    width = f"(len(q) // {PARTS})"
    steps = [
        f"""v AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS r,
         list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""",
        f"""parts AS MATERIALIZED (
  SELECT r, p, q[p * {width} + 1 : (p + 1) * {width}] AS x FROM v, (SELECT unnest(range({PARTS})) AS p)
)""",
        f"c0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS y FROM parts WHERE r <= {ENTRIES})",
    ]
    near = """(
  SELECT r, p, x, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
    SELECT r, parts.p AS p, x, e, CAST(list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
    FROM parts JOIN {book} USING (p)
  ) GROUP BY r, p, x
)"""
    for k in range(ROUNDS):
        steps += [
            f"a{k} AS MATERIALIZED {near.format(book=f'c{k}')}",
            f"""m{k} AS MATERIALIZED (
  SELECT p, e, list(m ORDER BY i) AS y FROM (
    SELECT p, e, i, CAST(floor(CAST(sum(v) AS DOUBLE) / count(*)) AS BIGINT) AS m
    FROM (SELECT p, e, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM a{k}) GROUP BY p, e, i
  ) GROUP BY p, e
)""",
            f"c{k + 1} AS MATERIALIZED (SELECT c{k}.p, c{k}.e, coalesce(m{k}.y, c{k}.y) AS y FROM c{k} LEFT JOIN m{k} ON c{k}.p = m{k}.p AND c{k}.e = m{k}.e)",
        ]
    steps += [
        f"done AS MATERIALIZED {near.format(book=f'c{ROUNDS}')}",
        "codes AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM done GROUP BY r)",
        f"books AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{ROUNDS})",
    ]
    return "WITH " + ",\n".join(steps) + """
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM v JOIN codes USING (r), books
"""


ORACLE = _oracle()
