"""Benchmark decontamination by the q-gram lemma.

An item of n characters that stands in a text with at most k edits shares at least ``n - q + 1 - k q`` q-grams with it,
all on diagonals (text position minus item position) that differ by k at most. Shared q-grams are counted in diagonal
bands of width 2(k+1) that overlap by half, so that any k+1 neighbouring diagonals lie in one band; only bands that
reach the bound are aligned, with a banded dynamic program over their diagonals. Characters are UTF-8 bytes, with A-Z
and the Latin-1 capitals lower-cased. ``k`` is ``EDITS`` times n, less for items so short that the bound would vanish.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchframe.llm.text import LOWER, bytes_of, pieces, release

Q = 8
#: Edits per character of an item; items of fewer bytes are too short to prove a leak and take no part.
EDITS, SHORTEST = 0.1, 24
#: Cells of the alignment that advance together: longer items go in smaller groups.
CELLS = 1 << 20
#: Bytes of benchmark text that one broadcast index covers; a larger benchmark is searched block by block.
BLOCK_BYTES = 4 << 20
_TABLE_BITS = 22


def fold(data: np.ndarray) -> np.ndarray:
    """A-Z and the capitals of Latin-1, in UTF-8, as small letters; no byte moves."""
    out = LOWER[data]
    latin = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)) + 1
    out[latin] += 0x20
    return out


def _grams(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from every position as one number."""
    if len(data) < Q:
        return np.zeros(0, np.uint64)
    two = data[:-1].astype(np.uint64) | (data[1:].astype(np.uint64) << np.uint64(8))
    four = two[:-2] | (two[2:] << np.uint64(16))
    return four[:-4] | (four[4:] << np.uint64(32))


def _slot(g: np.ndarray) -> np.ndarray:
    return ((g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)


def budget(n: int, edits: float = EDITS) -> int:
    return min(int(edits * n), (n - Q) // Q)


class Index:
    """Q-grams of a block of items."""

    def __init__(self, items: list[tuple[int, str]], edits: float = EDITS):
        raw = [fold(np.frombuffer((t or "").encode(), np.uint8)) for _, t in items]
        keep = [i for i, r in enumerate(raw) if len(r) >= SHORTEST]
        self.ids = [items[i][0] for i in keep]
        self.items = [raw[i] for i in keep]
        sizes = np.array([len(r) for r in self.items], np.int64)
        self.edits = np.array([budget(int(n), edits) for n in sizes], np.int64)
        self.least = sizes - Q + 1 - self.edits * Q
        self.width = self.edits + 1
        grams = [_grams(r) for r in self.items]
        flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(keep)), [len(g) for g in grams])
        at = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        flat, self.item, self.at = flat[order], item[order].astype(np.int64), at[order].astype(np.int64)
        self.grams, first = np.unique(flat, return_index=True)
        self.first = np.append(first, len(flat)).astype(np.int64)
        self.seen = np.zeros(1 << _TABLE_BITS, bool)
        self.seen[_slot(self.grams)] = True

    def search(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, item index, start, end, distance): the best place of each item in each row, ties to the earlier."""
        grams = _grams(data)
        if not len(grams) or not len(self.grams):
            return []
        at = np.flatnonzero(self.seen[_slot(grams)])
        row = np.searchsorted(offsets[1:], at, side="right")
        inside = at + Q <= offsets[row + 1]
        at, row = at[inside], row[inside]
        pos = np.searchsorted(self.grams, grams[at])
        pos[pos == len(self.grams)] = 0
        real = self.grams[pos] == grams[at]
        at, row, pos = at[real], row[real], pos[real]
        n = self.first[pos + 1] - self.first[pos]
        flat = np.repeat(self.first[pos] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
        at, row = np.repeat(at, n), np.repeat(row, n)
        item = self.item[flat]
        diagonal = at - offsets[row] - self.at[flat] + len(data)  # never negative: items are shorter than 2^40
        band = diagonal // self.width[item]
        found: dict[tuple[int, int], tuple[int, int, int]] = {}
        if not len(band):
            return []
        key = (row * len(self.ids) + item).astype(np.int64)
        span = int(band.max()) + 3
        whole = key * span + band
        at_item = self.at[flat]
        for distinct in (False, True):  # all shared q-grams first, then, in the bands that are left, distinct places
            if distinct:
                left = np.unique(whole[kept])
                places = int(at_item.max()) + 1
                pairs = np.unique(np.searchsorted(left, whole[kept]) * places + at_item[kept])
                whole = left[pairs // places]
            ordered = np.sort(whole)
            new = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
            keys, counts = ordered[new], np.diff(np.append(new, len(ordered)))
            if not len(keys):
                return []
            # a band and its right neighbour are one wide band; one that starts left of a filled band is that band alone
            right = np.minimum(np.searchsorted(keys, keys + 1), len(keys) - 1)
            both = counts + np.where(keys[right] == keys + 1, counts[right], 0)
            good = np.flatnonzero(both >= self.least[(keys // span) % len(self.ids)])
            kept = np.flatnonzero(np.isin(whole, np.concatenate([keys[good], keys[good] + 1]))) if not distinct else None
        todo = []
        for k, band_no in zip((keys[good] // span).tolist(), (keys[good] % span).tolist(), strict=True):
            r, i = divmod(k, len(self.ids))
            edits, w, text, item_ = int(self.edits[i]), int(self.width[i]), data[offsets[r] : offsets[r + 1]], self.items[i]
            low, high = band_no * w - len(data) - edits, band_no * w - len(data) + 2 * w - 1 + edits
            if len(text) < len(item_) - edits:
                continue
            a = max(0, low)
            exact = text[a : max(0, high + len(item_))].tobytes().find(item_.tobytes())
            if exact >= 0:
                self._keep(found, r, i, (a + exact, a + exact + len(item_), 0))
            else:
                todo.append((r, i, text, low, high))
        todo = [t for t in todo if found.get((t[0], t[1]), (0, 0, 1))[2] > 0]
        ends = align([self.items[t[1]] for t in todo], [t[2] for t in todo], np.array([t[3] for t in todo], np.int64), np.array([t[4] for t in todo], np.int64), np.array([self.edits[t[1]] for t in todo], np.int64))
        for t, hit in zip(todo, ends, strict=True):
            if hit:
                self._keep(found, t[0], t[1], hit)
        return [(r, i, *hit) for (r, i), hit in sorted(found.items())]

    @staticmethod
    def _keep(found: dict, r: int, i: int, hit: tuple[int, int, int]) -> None:
        old = found.get((r, i))
        if old is None or (hit[2], hit[0]) < (old[2], old[0]):
            found[r, i] = hit


def align(items: list[np.ndarray], texts: list[np.ndarray], low: np.ndarray, high: np.ndarray, most: np.ndarray) -> list[tuple[int, int, int] | None]:
    """(start, end, distance) of the best match of each whole item in its text on diagonals low..high, or None beyond ``most``.

    All pairs advance together, one item character a step. Ties go to the smaller end.
    """
    out: list[tuple[int, int, int] | None] = [None] * len(items)
    order = sorted(range(len(items)), key=lambda c: -len(items[c]))
    wide = (high - low + 1).tolist()
    first = 0
    while first < len(order):
        widest = wide[order[first]]
        own = order[first : first + max(1, min(1024, CELLS // widest))]
        if widest > 512:  # a long item does not widen the short ones after it
            own = [c for k, c in enumerate(own) if not k or 2 * wide[c] > widest]
            own = order[first : first + len(own)]
        first += len(own)
        n = np.array([len(items[c]) for c in own])
        lo, width = low[own], int((high[own] - low[own]).max()) + 1
        longest, sizes = int(n[0]), np.array([len(texts[c]) for c in own])
        chars = np.zeros((len(own), longest), np.int16)
        shown = np.full((len(own), longest + width), 256, np.int16)
        for k, c in enumerate(own):
            chars[k, : n[k]] = items[c]
            a, b = max(0, lo[k]), min(sizes[k], lo[k] + longest + width)
            if b > a:
                shown[k, a - lo[k] : b - lo[k]] = texts[c][a:b]
        steps = np.arange(width, dtype=np.int32)
        far = np.int32(longest + width + 1)
        place = (lo[:, None] + steps).astype(np.int32)  # text positions of the cells before item character 0
        size = sizes[:, None].astype(np.int32)
        outside = (steps >= (high[own] - lo + 1)[:, None]) | (place < 0) | (place > size)
        cost, start = np.where(outside, far, 0).astype(np.int32), place.copy()
        live = len(own)
        for i in range(longest + 1):
            while live and n[live - 1] == i:
                live -= 1
                end = int(np.argmin(cost[live]))
                c = own[live]
                if cost[live, end] <= most[c]:
                    out[c] = (int(start[live, end]), int(lo[live]) + i + end, int(cost[live, end]))
            if not live:
                break
            cost, start = cost[:live], start[:live]
            new = cost + (shown[:live, i : i + width] != chars[:live, i : i + 1])
            came = start.copy()
            up = cost[:, 1:] + 1  # the item's character is missing in the text
            better = up < new[:, :-1]
            np.copyto(new[:, :-1], up, where=better)
            np.copyto(came[:, :-1], start[:, 1:], where=better)
            at = place[:live] + (i + 1)
            new[(at < 0) | (at > size[:live])] = far
            new -= steps
            best = np.minimum.accumulate(new, axis=1)  # extra characters of the text
            source = np.maximum.accumulate(np.where(new == best, steps, 0), axis=1)
            start = np.take_along_axis(came, source, axis=1)
            cost = np.minimum(best + steps, far)
    return out


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", edits: float = EDITS) -> DataFrame:
    """(doc_id, item_id, start, end, distance): every benchmark item that stands in a document within its edit budget.

    Positions are bytes of the text. One row per document row and item, at its best place. Null and empty texts match
    nothing; items that are null or shorter than ``SHORTEST`` bytes, and an empty benchmark, match nothing.
    """
    spark = docs.sparkSession
    items = benchmark.select("item_id", F.col("text").alias("t")).where(F.octet_length("t") >= SHORTEST)
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.octet_length(F.col(text)) >= SHORTEST // 2)
    schema = "doc_id long, item_id long, start int, end int, distance int"
    out = None
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "t"), F.lit(blocks)) == block).orderBy("item_id").collect()
        index = spark.sparkContext.broadcast(Index([(r[0], r[1]) for r in own], edits))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            ix = index.value
            for b in pieces(batches):
                data, offsets = bytes_of(b.column(1))
                found = ix.search(fold(data), offsets) if len(data) else []
                ids = b.column(0).to_pylist()
                cols = list(zip(*((ids[r], ix.ids[i], s, e, d) for r, i, s, e, d in found), strict=True)) or [[]] * 5
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "item_id", "start", "end", "distance"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item stands; rows without a doc_id are judged by their own text too."""
    spark = docs.sparkSession
    items = benchmark.select("item_id", F.col("text").alias("t")).where(F.octet_length("t") >= SHORTEST)
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    at = docs.columns.index("text")
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "t"), F.lit(blocks)) == block).orderBy("item_id").collect()
        index = spark.sparkContext.broadcast(Index([(r[0], r[1]) for r in own], edits))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in pieces(batches):
                data, offsets = bytes_of(b.column(at))
                keep = np.ones(b.num_rows, bool)
                keep[[r for r, *_ in index.value.search(fold(data), offsets)] if len(data) else []] = False
                yield b.filter(pa.array(keep))
            release()

        docs = docs.mapInArrow(run, docs.schema)
    return docs
