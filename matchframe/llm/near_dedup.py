"""Near-duplicate documents: MinHash signatures joined by a multi-index Hamming scheme.

A signature is 32 symbols of 16 bits, each of the least hash of the document's shingles under one function (its lowest
bits, which are as even for long texts as for short ones); two documents differ in a symbol with probability one minus their Jaccard similarity. It is split into 8 chunks of 4 symbols. If two
signatures differ in 15 symbols or fewer, some chunk differs in at most one (pigeonhole), so each chunk is entered once
for every place of that one error, with that symbol left out: 32 keys a document, and every pair within distance 15 (most
pairs beyond it too) meets in one. At similarity 0.8 the expected distance is 6.4, and a pair shares no key with
probability (1 - 0.8192)^8 = 1.1e-6. Meeting pairs are confirmed on the whole shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from matchframe.llm import minhash
from matchframe.llm.linking import bit_map, in_map, link, slot_of
from matchframe.llm.text import blobs, mix, pieces, release, shingles, words
from matchframe.llm.store import stored

SYMBOLS, CHUNKS, BITS = 32, 8, 16
#: Share of the union, in percent, and words of a shingle unless a caller says otherwise.
PERCENT, WORDS = 80, 5


def symbols_of(low: np.ndarray) -> np.ndarray:
    """The lowest bits of the least hashes; their highest bits tend to 0 as sets grow."""
    return low & np.uint64((1 << BITS) - 1)


def chunk_keys(symbols: np.ndarray, chunks: int = CHUNKS) -> np.ndarray:
    """(rows, symbols) keys: every chunk with each one of its symbols left out."""
    n, m = symbols.shape
    size = m // chunks
    out = np.empty((n, m), np.uint64)
    for c in range(chunks):
        own = symbols[:, c * size : (c + 1) * size].astype(np.uint64)
        for gap in range(size):
            rest = [k for k in range(size) if k != gap]
            h = np.full(n, c * size + gap + 1, np.uint64)
            for k in rest:
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + own[:, k])
            out[:, c * size + gap] = h
    return out


def signatures(docs: DataFrame, size: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, size, d1, d2, sketch, keys) per row: set size, set digest, sketch and the keys of the multi-index."""
    schema = "id long, size long, d1 long, d2 long, sketch array<long>, keys array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            n = b.num_rows
            rows, hashes, _, _ = words(b.column(1))
            rows, hashes = shingles(rows, hashes, n, size)
            count = np.bincount(rows, minlength=n).astype(np.int64)
            d1, d2 = minhash.digest(rows, hashes, n)
            low = minhash.minima(rows, hashes, n, SYMBOLS)
            keys = chunk_keys(symbols_of(low)).view(np.int64)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * SYMBOLS, pa.int32()), pa.array(keys.ravel()))
            cols = [b.column(0), pa.array(count), pa.array(d1), pa.array(d2), minhash.sketch(rows, hashes, n), flat]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "size", "d1", "d2", "sketch", "keys"])
        release()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, schema)


def sets(docs: DataFrame, size: int, needed: np.ndarray, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, set): the set digest of every row whose id is in the map ``needed``, and its sorted shingle hashes as bytes."""
    sent = docs.sparkSession.sparkContext.broadcast(needed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            wanted = whole.filter(pa.array(in_map(sent.value, whole.column(0).to_numpy())))
            for b in pieces(iter([wanted])):
                n = b.num_rows
                rows, hashes, _, _ = words(b.column(1))
                rows, hashes = shingles(rows, hashes, n, size)
                d1, _ = minhash.digest(rows, hashes, n)
                yield pa.RecordBatch.from_arrays([pa.array(d1), blobs(hashes, np.bincount(rows, minlength=n))], names=["id", "set"])
        release()

    return docs.select(slot_of(F.col(id_col).cast("long")).alias("slot"), F.col(text).alias("text")).mapInArrow(run, "id long, set binary")


def labelled(docs: DataFrame, size: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, size, d1, head, class) per document row: its set's digest, the set's smallest id, and the class of the set.

    ``class`` is null for rows without shingles and for rows without an id; they are linked with nothing.
    """
    every = stored(signatures(docs, size, id_col, text))
    real = every.where((F.col("size") > 0) & F.col("id").isNotNull())
    # rows with equal sets are one node from the start; the smallest id among them names their document
    heads = stored(real.groupBy("d1").agg(F.min("id").alias("head"), *[F.first(c).alias(c) for c in ("size", "sketch", "keys")]))
    nodes = heads.select(F.col("d1").alias("id"), "size", "sketch", "keys")
    heads = heads.select("d1", "head")

    def whole(ids: DataFrame) -> DataFrame:
        wanted = heads.join(ids.withColumnRenamed("id", "d1"), "d1", "left_semi").select(slot_of(F.col("head")).alias("slot"))
        # what the map lets through besides is dropped by the joins with pairs
        return stored(sets(docs, size, bit_map(wanted), id_col, text))

    found = link(nodes, whole, percent)
    known = heads.join(found.select(F.col("id").alias("d1"), "component"), "d1", "left")
    known = known.select("d1", "head", F.coalesce("component", "d1").alias("class"))
    rows = every.select("id", "size", F.when((F.col("size") > 0) & F.col("id").isNotNull(), F.col("d1")).alias("d1"))
    return rows.join(known, "d1", "left")


def classes(docs: DataFrame, size: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every document row.

    ``component_id`` is the smallest id that links reach. Null and empty texts have no shingles and are linked with nothing.
    Rows that share an id are linked each by its own text. A null id is linked with nothing and kept.
    """
    rows = stored(labelled(docs, size, percent, id_col, text))
    least = rows.where("class is not null").groupBy("class").agg(F.min("head").alias("component_id"))
    out = rows.join(least, "class", "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias(id_col), F.col("size").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def unique(docs: DataFrame, size: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the one with the smallest id.

    Of repeated rows one stays. Rows without words, or without an id, stay.
    """
    rows = stored(labelled(docs, size, percent, id_col, text))
    stay = rows.where("class is not null").groupBy("class").agg(F.min(F.struct("id", "d1")).alias("s")).select("s.id", "s.d1")
    often = rows.where("class is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    often = stored(often)
    once = stay.join(often, "id", "left_anti").select(F.col("id").alias(id_col))
    wordless = rows.where("class is null and id is not null").select(F.col("id").alias(id_col))
    out = docs.join(once.unionByName(wordless.join(often.select(F.col("id").alias(id_col)), id_col, "left_anti")).distinct(), id_col, "left_semi")
    # rows that share an id are told apart by their sets
    shared = docs.join(often.select(F.col("id").alias(id_col)), id_col, "left_semi")
    at, name = docs.columns.index(text), text
    digest, wordless_, key, other = (free(n, docs.columns) for n in ("d1", "wordless", "id", "d"))

    def with_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, name):
            r, h, _, _ = words(b.column(at))
            r, h = shingles(r, h, b.num_rows, size)
            d1, _ = minhash.digest(r, h, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(d1), pa.array(np.bincount(r, minlength=b.num_rows) == 0)], names=[*b.schema.names, digest, wordless_])

    shared = shared.mapInArrow(with_digest, StructType([*docs.schema.fields]).add(digest, "long").add(wordless_, "boolean"))
    kept = stay.select(F.col("id").alias(key), F.col("d1").alias(other))
    told = shared.where(~F.col(wordless_)).join(kept, (F.col(id_col) == F.col(key)) & (F.col(digest) == F.col(other)), "left_semi").dropDuplicates([id_col, digest])
    silent = shared.where(wordless_).drop(digest, wordless_)
    return out.unionByName(told.drop(digest, wordless_)).unionByName(silent).unionByName(docs.where(F.col(id_col).isNull()))


def free(name: str, taken: list[str]) -> str:
    """``name`` behind as many underscores as it takes to differ from all names taken, whatever their case."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name = f"_{name}"
    return name
