"""Document fingerprints: sketches of a size in proportion to the text, for containment between very unequal documents.

A document's set is its distinct shingles of five words (with fewer words, the whole sequence as one). The fingerprint
retains every shingle hash below a fixed fraction, 1 / ``ONE_IN``, of the range of hashes. Whether a hash is retained
depends on the hash alone, so the fingerprint of a union is the union of fingerprints, and the share of one fingerprint
that stands in another estimates the share of one document that stands in the other, however unequal their sizes are.
A set none of whose hashes is below the fraction is known by its least hash, so that short texts can be told apart; that
is mergeable too. A document without words has the empty fingerprint.

Likeness is the greater of the two containments: common hashes over the size of the smaller fingerprint; 1 between two
empty fingerprints, 0 between an empty one and another.

For ``digest`` documents stand in descending order of doc_id (null last, equal ids by a hash of the text), and each needs
the one after it. Split points of the ids, from a bounded sample, cut the order into buckets of about ``BUCKET_BYTES`` of
text; the first document of a bucket is sent to the bucket before it as well. So one shuffle brings neighbours together,
and a task streams over its sorted bucket with one document in hand. The split points decide the work's division only,
not the result; rows that share one id share a bucket.

Null text is the empty text. Repeated rows stay repeated and follow each other; a single document is its own next one.
Columns other than doc_id and text are not used. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchframe.llm.text import pieces, release, shingles, words
from matchframe.session import small_table

#: Words of a shingle; of the hashes one in so many is retained.
WORDS, ONE_IN = 5, 8
_TOP = (1 << 64) // ONE_IN
#: Bytes of text of a bucket, rows (about) whose sizes tell where to split, and the most buckets (beyond them buckets grow).
BUCKET_BYTES, SAMPLE, MOST_BUCKETS = 32 << 20, 500_000, 50_000


def retained(column: pa.Array, size: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash) of the retained hashes of every text, sorted by both, and the number of shingles of every text."""
    n = len(column)
    row, hashes, _, _ = words(column)
    row, hashes = shingles(row, hashes, n, size)
    count = np.bincount(row, minlength=n)
    keep = hashes < np.uint64(_TOP)
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else row
    keep[first[np.bincount(row[keep], minlength=n)[row[first]] == 0]] = True
    return row[keep], hashes[keep], count


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """Common hashes over the smaller size, for the (row, hash) pairs of two lists of n fingerprints."""
    row, hashes = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    same = (row[1:] == row[:-1]) & (hashes[1:] == hashes[:-1])
    common = np.bincount(row[1:][same], minlength=n)
    sizes = np.bincount(a[0], minlength=n), np.bincount(b[0], minlength=n)
    least, most = np.minimum(*sizes), np.maximum(*sizes)
    return np.where(most == 0, 1.0, common / np.maximum(least, 1))


def hexes(row: np.ndarray, hashes: np.ndarray, n: int) -> list[str]:
    """The hashes of every row as 16 hexadecimal digits each, ascending."""
    edge = np.searchsorted(row, np.arange(n + 1))
    data = hashes.astype(">u8").tobytes().hex()
    return [data[16 * a : 16 * b] for a, b in pairwise(edge.tolist())]


def sketches(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, sketch) of every row; sketch is an array of hashes, as signed longs in unsigned order."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            row, hashes, count = retained(b.column(1))
            ends = np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count, pa.int64()), lists], names=["doc_id", "n_shingles", "sketch"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_shingles long, sketch array<long>")


def union_of(a: Column, b: Column) -> Column:
    """The sketch of the union of two sets."""
    both = F.array_union(a, b)
    low = F.filter(both, lambda h: (h >= 0) & (h < _TOP))
    sign = F.lit(-(1 << 63))
    least = F.array(F.array_min(F.transform(both, lambda h: h.bitwiseXOR(sign))).bitwiseXOR(sign))
    return F.when(F.size(low) > 0, F.array_sort(low)).when(F.size(both) > 0, least).otherwise(both)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the set of ``a`` that stands in the set of ``b``; 1 if ``a`` is empty."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def _in_order(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, text, tail) dealt to sorted buckets; a row with ``tail`` is only the next one of the bucket's last."""
    spark = rows.sparkSession
    # one row of so many, by its hash, tells how the text is spread over the ids
    every = max(1, rows.count() // SAMPLE)
    sampled = rows.where(F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64("doc_id", "text"), F.lit(every)) == 0))
    found = sampled.select("doc_id", F.octet_length("text").alias("n")).orderBy("doc_id").collect()
    ids, size = np.array([r[0] for r in found], np.float64), np.cumsum([r[1] + 1 for r in found])
    n = min(MOST_BUCKETS, max(1, int(size[-1] * every) // BUCKET_BYTES)) if len(size) else 1
    at = np.searchsorted(size, size[-1] * np.arange(1, n) / n) if len(size) else np.zeros(0, int)
    splits = [float("-inf"), *(sorted(set(ids[at].tolist())) or [0.0]), float("inf")]
    nulls = len(splits) - 1
    tie = F.xxhash64("text")
    bucketed = Bucketizer(splits=splits, inputCol="place", outputCol="bucket", handleInvalid="keep").transform(rows.withColumn("place", F.col("doc_id").cast("double")))
    bucketed = bucketed.withColumn("bucket", F.coalesce(F.col("bucket").cast("int"), F.lit(nulls))).withColumn("tie", tie).drop("place")
    # the first row of each bucket; ids of a bucket are all null or none is
    tops = bucketed.groupBy("bucket").agg(F.max(F.struct("doc_id", "tie")).alias("top")).collect()
    chain = sorted(tops, key=lambda r: (r["bucket"] == nulls, -r["bucket"]))
    heads = [(r["bucket"], r["top"]["doc_id"], r["top"]["tie"], chain[k - 1]["bucket"]) for k, r in enumerate(chain)]
    head = small_table(spark, heads, "own int, top_id long, top_tie long, before int")
    joined = bucketed.join(F.broadcast(head), (F.col("bucket") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("top_id")) & (F.col("tie") == F.col("top_tie")), "left")
    both = F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("tail")), F.struct(F.col("before").alias("b"), F.lit(1).alias("tail")))
    one = F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("tail")))
    dealt = joined.withColumn("to", F.explode(F.when(F.col("before").isNotNull(), both).otherwise(one)))
    dealt = dealt.select("doc_id", "text", F.col("to.b").alias("bucket"), F.col("to.tail").alias("tail"), "tie")
    dealt = dealt.repartitionById(nulls + 1, F.col("bucket"))
    return dealt.sortWithinPartitions("tail", F.desc_nulls_last("doc_id"), F.desc("tie")).select("doc_id", "text", "tail")


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_shingles) of every row.

    The edited text has its last third of code points replaced by as many (or all) of the next document's first ones;
    ``near_edited`` and ``near_next`` are the document's likeness to its edited text and to the next document.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for b in pieces(batches):
            if held is not None:
                b = pa.RecordBatch.from_arrays([pa.concat_arrays([x, y]) for x, y in zip(held.columns, b.columns, strict=True)], names=b.schema.names)
            held = b.slice(b.num_rows - 1)
            # every row but the last has its next one here
            out = int(np.argmax(tail)) if (tail := b.column(2).to_numpy()[:-1]).any() else b.num_rows - 1
            if not out:
                continue
            b = b.slice(0, out + 1)
            texts = b.column(1).to_pylist()
            edited = [t[: len(t) - len(t) // 3] + after[: len(t) // 3] for t, after in pairwise(texts)]
            row, hashes, count = retained(b.column(1))
            new = retained(pa.array(edited, pa.string()))[:2]
            own, following = row < out, row > 0
            mine = row[own], hashes[own]
            cols = [
                b.column(0).slice(0, out), pa.array([len(t) for t in texts[:-1]], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                pa.array(hexes(*mine, out), pa.string()), pa.array(hexes(*new, out), pa.string()),
                pa.array(likeness(mine, new, out)), pa.array(likeness(mine, (row[following] - 1, hashes[following]), out)),
                pa.array(count[:out], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_shingles"])
        release()

    return _in_order(rows).mapInArrow(run, schema)
