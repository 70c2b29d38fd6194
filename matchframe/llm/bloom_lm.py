"""Language-model scores from a log-frequency Bloom filter.

Training counts c of words and word pairs are quantised to levels 1 + floor(log2 c), and an n-gram of level q is entered
under q keys, (n-gram, 1) to (n-gram, q). Asking for level 1, 2, ... until one is missing gives the level back; errors
are one-sided and rare. The filter is cut into blocks by n-gram, each built from the counts of its own n-grams in one
group, and broadcast to the workers in rounds of at most ``ROUND_BYTES``; it grows with the distinct n-grams. The smoothed
probability of a word interpolates the pair's and the word's estimate. Exact word counts, for the base score, come from
the same groups: every piece of the corpus asks each block for the counts of its own distinct words.
"""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchframe.llm.store import stored
from matchframe.llm.text import mix, pieces, release, words

#: Text bytes of a piece, bits of a block (a power of two), bits and probes for each entry, bytes broadcast in a round.
PIECE, BLOCK_BITS, BITS, PROBES, ROUND_BYTES = 4 << 20, 1 << 22, 6, 4, 256 << 20
#: Weight of the pair's estimate in a word's probability.
PAIR_WEIGHT = 0.4
FOLDS, HELD_OUT = 7, 2
END = np.uint64(0x3C79AC492BA7B653)
_PREVIOUS, _NEXT = np.uint64(0xD1342543DE82EF95), np.uint64(0xAF251AF3B0F025B5)
_LEVELS = 63


def held_out(doc_id: int | None) -> bool:
    """A null id is in training."""
    return doc_id is not None and crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


def _pack(a: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(a).tobytes(), codec="zstd", asbytes=True)


def _unpack(raw: bytes, dtype, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, decompressed_size=n * np.dtype(dtype).itemsize, codec="zstd", asbytes=True), dtype)


def encode(docs: DataFrame) -> DataFrame:
    """Pieces of the corpus with their words as places in the piece's sorted list of distinct word hashes."""
    schema = "piece long, ids array<long>, held binary, lens binary, vocab binary, n int, codes binary, train_tokens long, entries long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, limit=PIECE):
            ids, parts, at = b.column(0).to_pylist(), [], 0
            for small in pieces(iter([b])):
                rows, h, _, _ = words(small.column(1))
                parts.append((rows + at, h))
                at += small.num_rows
            rows, h = (np.concatenate(x) for x in zip(*parts, strict=True))
            held = np.array([held_out(i) for i in ids], bool)
            count = np.bincount(rows, minlength=len(ids))
            lens = count + 1
            tokens = np.full(len(h) + len(ids), END)
            tokens[np.arange(len(h)) + rows] = h
            vocab, codes = np.unique(tokens, return_inverse=True)
            train = np.repeat(~held, lens)
            pairs = np.unique(_pairs(codes, lens, vocab)[train])
            row = {
                "piece": uuid4().int >> 65, "ids": ids, "held": held.tobytes(), "lens": lens.astype(np.int32).tobytes(), "vocab": vocab.tobytes(),
                "n": len(codes), "codes": _pack(codes.astype(np.uint32)), "train_tokens": int(lens[~held].sum()), "entries": len(pairs) + len(vocab),
            }
            yield pa.RecordBatch.from_pylist([row], schema=_ENCODED)
        release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, schema)


_ENCODED = pa.schema([
    ("piece", pa.int64()), ("ids", pa.list_(pa.int64())), ("held", pa.binary()), ("lens", pa.binary()), ("vocab", pa.binary()),
    ("n", pa.int32()), ("codes", pa.binary()), ("train_tokens", pa.int64()), ("entries", pa.int64()),
])


def _pairs(codes: np.ndarray, lens: np.ndarray, vocab: np.ndarray) -> np.ndarray:
    """Previous and own code of every token as one number; a document's first token follows an end."""
    before = np.empty(len(codes), np.int64)
    before[1:] = codes[:-1]
    before[np.concatenate([[0], np.cumsum(lens)[:-1]])] = np.searchsorted(vocab, END)
    return before * len(vocab) + codes


def _pair_hash(pairs: np.ndarray, vocab: np.ndarray) -> np.ndarray:
    return mix(vocab[pairs // len(vocab)] * _PREVIOUS + vocab[pairs % len(vocab)] * _NEXT)


def _block(x: np.ndarray, blocks: int) -> np.ndarray:
    """Block of a hash, in the order of the hashes."""
    return ((x >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)


def _each(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _open(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    vocab = np.frombuffer(row["vocab"], np.uint64)
    codes = _unpack(row["codes"], np.uint32, row["n"]).astype(np.int64)
    return vocab, codes, np.frombuffer(row["lens"], np.int32).astype(np.int64), np.frombuffer(row["held"], bool)


def _counts(blocks: int):
    """Per piece and block: its words with their training counts (0 too), and its training pairs with theirs."""
    schema = pa.schema([("block", pa.int32()), ("piece", pa.int64()), ("words", pa.binary()), ("word_counts", pa.binary()), ("pairs", pa.binary()), ("pair_counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _each(batch):
                vocab, codes, lens, held = _open(row)
                train = np.repeat(~held, lens)
                count = np.bincount(codes[train], minlength=len(vocab)).astype(np.uint32)
                pairs, pair_count = np.unique(_pairs(codes, lens, vocab)[train], return_counts=True)
                keys = _pair_hash(pairs, vocab)
                order = np.argsort(keys)
                keys, pair_count = keys[order], pair_count[order].astype(np.uint32)
                edges = np.arange(blocks + 1)
                w = np.searchsorted(_block(vocab, blocks), edges)
                p = np.searchsorted(_block(keys, blocks), edges)
                used = np.flatnonzero((w[1:] > w[:-1]) | (p[1:] > p[:-1]))
                part = lambda a, e: [a[e[i] : e[i + 1]].tobytes() for i in used]
                cols = [used.astype(np.int32), np.full(len(used), row["piece"]), part(vocab, w), part(count, w), part(keys, p), part(pair_count, p)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)
        release()

    return run


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order].astype(np.int64)
    if not len(keys):
        return keys, counts
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def _places(x: np.ndarray, level: int) -> Iterator[np.ndarray]:
    """Bits, within the block, of an n-gram at a level."""
    h = mix(x + np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    step = (h >> np.uint64(32)) | np.uint64(1)
    for _ in range(PROBES):
        yield (h & np.uint64(BLOCK_BITS - 1)).astype(np.int64)
        h = h + step


def level_of(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log2 c) for counts from 1."""
    return np.frexp(counts.astype(np.float64))[1]


def estimate(levels: np.ndarray) -> np.ndarray:
    """The middle of a level's counts; 0 for level 0."""
    top = np.exp2(levels.astype(np.float64))
    return np.where(levels > 0, (top / 2 + top - 1) / 2, 0.0)


_BUILT = pa.schema([("block", pa.int32()), ("piece", pa.int64()), ("data", pa.binary()), ("known", pa.int64())])


def _build(table: pa.Table) -> pa.Table:
    """A block's part of the filter (piece null) and, for each piece, the exact counts of its words."""
    block = table.column("block")[0].as_py()
    glue = lambda name, dtype: np.frombuffer(b"".join(table.column(name).to_pylist()), dtype)
    asked = [np.frombuffer(x, np.uint64) for x in table.column("words").to_pylist()]
    keys, counts = _sums(glue("words", np.uint64), glue("word_counts", np.uint32))
    bits = np.zeros(BLOCK_BITS, bool)
    for x, c in ((keys, counts), _sums(glue("pairs", np.uint64), glue("pair_counts", np.uint32))):
        x, levels = x[c > 0], level_of(c[c > 0])
        level = 1
        while len(x):
            for at in _places(x, level):
                bits[at] = True
            level += 1
            x, levels = x[levels >= level], levels[levels >= level]
    answers = [counts[np.searchsorted(keys, a)].astype(np.uint32).tobytes() if len(a) else b"" for a in asked]
    rows = len(answers) + 1
    data = [np.packbits(bits, bitorder="little").tobytes(), *answers]
    cols = [[block] * rows, [None, *table.column("piece").to_pylist()], data, [int((counts > 0).sum()), *[0] * len(answers)]]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, _BUILT.types, strict=True)], schema=_BUILT)


def _probe(filters: np.ndarray, first: int, last: int, blocks: int, x: np.ndarray, levels: np.ndarray) -> None:
    """Fill in the levels of the n-grams whose blocks are first..last-1."""
    block = _block(x, blocks)
    own = np.flatnonzero((block >= first) & (block < last))
    base = (block[own] - first) * BLOCK_BITS
    for level in range(1, _LEVELS):
        keys = x[own]
        here = np.ones(len(own), bool)
        for at in _places(keys, level):
            todo = np.flatnonzero(here)
            if not len(todo):
                break
            bit = base[todo] + at[todo]
            here[todo] = (filters[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1
        own, base = own[here], base[here]
        if not len(own):
            return
        levels[own] = level


_PROBED = "piece long, ids array<long>, held binary, lens binary, vocab binary, n int, codes binary, answers array<struct<block:int,data:binary>>, word_levels binary, pair_levels binary"


def scores(docs: DataFrame, pair_weight: float = PAIR_WEIGHT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``.

    Null and empty texts are one end token. Rows whose id falls in the held-out fold are scored but not learned from;
    repeated rows are learned from once each. Without training rows every score is that of an empty count table.
    """
    spark = docs.sparkSession
    encoded = stored(encode(docs))
    total = encoded.agg(F.sum("train_tokens"), F.sum("entries")).first()
    n_train, entries = total[0] or 0, total[1] or 0
    blocks = max(1, -(-entries * BITS // BLOCK_BITS))
    counted = encoded.mapInArrow(_counts(blocks), "block int, piece long, words binary, word_counts binary, pairs binary, pair_counts binary")
    built = stored(counted.groupBy("block").applyInArrow(_build, "block int, piece long, data binary, known long"))
    known = built.agg(F.sum("known")).first()[0] or 0
    answers = built.where("piece is not null").groupBy("piece").agg(F.sort_array(F.collect_list(F.struct("block", "data"))).alias("answers"))
    empty = F.lit(None).cast("binary")
    table = encoded.join(answers, "piece").select("piece", "ids", "held", "lens", "vocab", "n", "codes", "answers", empty.alias("word_levels"), empty.alias("pair_levels"))
    a_round = max(1, ROUND_BYTES * 8 // BLOCK_BITS)
    for first in range(0, blocks, a_round):
        last = min(blocks, first + a_round)
        filters = np.zeros((last - first) * BLOCK_BITS // 8, np.uint8)
        part = built.where(F.col("piece").isNull() & F.col("block").between(first, last - 1)).select("block", "data")
        for row in part.toLocalIterator():
            at = (row[0] - first) * BLOCK_BITS // 8
            filters[at : at + BLOCK_BITS // 8] = np.frombuffer(row[1], np.uint8)
        sent = spark.sparkContext.broadcast(filters)
        del filters
        if last < blocks:
            table = stored(table.mapInArrow(_looked_up(sent, first, last, blocks), _PROBED))
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return table.mapInArrow(_scored(sent, first, blocks, n_train, known, pair_weight), out)


def _levels(row: dict, vocab: np.ndarray, pairs: np.ndarray, filters: np.ndarray, first: int, last: int, blocks: int) -> list[np.ndarray]:
    """Levels of the words and pairs: those of earlier rounds, and those of this round's blocks."""
    out = []
    for name, x in (("word_levels", vocab), ("pair_levels", _pair_hash(pairs, vocab))):
        levels = _unpack(row[name], np.uint8, len(x)).copy() if row[name] else np.zeros(len(x), np.uint8)
        _probe(filters, first, last, blocks, x, levels)
        out.append(levels)
    return out


def _looked_up(sent, first: int, last: int, blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _each(batch):
                vocab, codes, lens, _ = _open(row)
                levels = _levels(row, vocab, np.unique(_pairs(codes, lens, vocab)), sent.value, first, last, blocks)
                keep = [batch.schema.field(i) for i in range(8)]
                one = {f.name: row[f.name] for f in keep} | {"word_levels": _pack(levels[0]), "pair_levels": _pack(levels[1])}
                yield pa.RecordBatch.from_pylist([one], schema=pa.schema([*keep, ("word_levels", pa.binary()), ("pair_levels", pa.binary())]))

    return run


def _scored(sent, first: int, blocks: int, n_train: int, known: int, pair_weight: float):
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _each(batch):
                vocab, codes, lens, held = _open(row)
                begin = np.concatenate([[0], np.cumsum(lens)[:-1]])
                exact = np.frombuffer(b"".join(a["data"] for a in row["answers"]), np.uint32).astype(np.int64)
                base = np.log10((exact + 1) / (n_train + known + 1))
                pairs, where = np.unique(_pairs(codes, lens, vocab), return_inverse=True)
                word, pair = (estimate(x) for x in _levels(row, vocab, pairs, sent.value, first, blocks, blocks))
                before, own = word[pairs // len(vocab)], word[pairs % len(vocab)]
                alone = (own + 1) / (n_train + known + 1)
                # a pair is no more frequent than its first word
                joint = np.where(before > 0, pair_weight * np.minimum(pair, before) / np.maximum(before, 1) + (1 - pair_weight) * alone, alone)
                cols = [
                    pa.array(row["ids"], pa.int64()), pa.array(held), pa.array(lens), pa.array(np.add.reduceat((exact > 0)[codes].astype(np.int64), begin)),
                    pa.array(np.full(len(lens), n_train, np.int64)), pa.array(np.add.reduceat(base[codes], begin)), pa.array(np.add.reduceat(np.log10(joint)[where], begin)),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=names)
        release()

    return run
