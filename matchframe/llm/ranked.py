"""Ranked lexical search by per-term geometric blocking.

A document is a sparse vector of term impacts, an item (a query) one of term weights; the score is their inner product,
in 64-bit integers. Documents are read in segments. In a segment, the posting list of a term is clustered into blocks of
similar documents: documents evenly spaced in the list are centres, and each document joins the centre nearest to it in a
random projection of its vector. A block stores the coordinatewise maximum of its documents' vectors, so the inner
product of an item with that summary is at least the score of every document of the block. A block is skipped for an item
only if this bound is below the item's cutoff, a score that as many documents as are wanted are known to reach. Documents
of the other blocks are scored exactly.

The whole of a list is a block too: terms whose greatest possible products together stay below the cutoff cannot bring a
document there on their own, so an item visits the lists of its other terms only.

The first cutoffs come from the documents of one hash class (any documents give a safe cutoff); within a task they rise
from segment to segment. Ties with the cutoff are kept, so the result is that of scoring everything.

Documents are dealt to tasks by rows, not by terms, so a term that stands in all documents is no hot key, and a task holds
one segment. Only the terms of the items matter to the scores, so vectors hold these; the counts that the weights need
(documents, lengths, documents of each term) are taken over all documents. Items go to the workers in blocks of
``BLOCK_BYTES`` of text, each of which is one pass over the documents.

Terms are maximal runs of 0-9, A-Z, a-z and all characters beyond ASCII, with A-Z lower-cased. Null and empty texts have
none and are no documents. Rows of one item_id, null among them, are one item with the terms of all of them; an item
without terms, or whose terms stand nowhere, has no rows. Repeated document rows are documents each; a null doc_id comes
after the others on equal scores. Columns other than those named are not used. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchframe.llm.store import stored
from matchframe.llm.text import pieces, release, words
from matchframe.session import small_table

WANTED = 50
#: Documents of a block (about), and dimensions of the projection that blocks are formed in.
BLOCK, PROJECTED = 8, 16
#: Documents and postings of a segment.
SEGMENT, SEGMENT_POSTINGS = 1 << 13, 1 << 20
#: Bytes of item text that are searched in one pass; items and terms that are searched together in a task.
BLOCK_BYTES, GROUP_ITEMS, GROUP_TERMS = 4 << 20, 256, 1 << 15
#: One document in so many gives the first cutoffs.
FIRST = 16
_BREAK = ~np.isin(np.arange(256), [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])


@dataclass
class Items:
    """Items of a block: term numbers of each, and the block's terms by hash (``size`` bytes each) in ascending order."""

    ids: list[int | None]
    terms: list[np.ndarray]
    hashes: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int | None, str | None]]) -> Items:
        row, h, start, end = words(pa.array([t for _, t in rows], pa.string()), _BREAK)
        hashes, first, number = np.unique(h, return_index=True, return_inverse=True)
        ids = list(dict.fromkeys(i for i, _ in rows))
        place = {i: k for k, i in enumerate(ids)}
        owner = np.array([place[i] for i, _ in rows], np.int64)[row] if rows else row
        pairs = np.unique(owner * max(1, len(hashes)) + number) if len(row) else np.zeros(0, np.int64)
        edge = np.searchsorted(pairs, np.arange(len(ids) + 1) * max(1, len(hashes)))
        return cls(ids, [pairs[a:b] % max(1, len(hashes)) for a, b in zip(edge[:-1], edge[1:], strict=True)], hashes, (end - start)[first])


@dataclass
class Corpus:
    """Documents with a term, terms of all documents, and documents that hold each of a block's terms."""

    documents: int
    length: int
    holders: np.ndarray

    def weights(self) -> np.ndarray:
        return np.array([math.floor(1000 * math.log((2 * self.documents + 2) / (2 * int(n) + 1))) for n in self.holders], np.int64)

    def impacts(self, length: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Of terms that occur ``count`` times in documents of ``length`` terms."""
        m = 50 + (50 * length * self.documents) // self.length
        return (1_000_000_000 * count) // (1000 * count + 20 * m)


@dataclass
class Segment:
    """Documents by their postings: term and impact of document d from edge[d] to edge[d + 1]; ``null`` marks ids."""

    ids: np.ndarray
    null: np.ndarray
    edge: np.ndarray
    term: np.ndarray
    impact: np.ndarray


@dataclass
class Group:
    """Items that are searched together: their numbers, their terms in ascending order, weights by (term, item)."""

    items: np.ndarray
    terms: np.ndarray
    weights: np.ndarray


def groups_of(items: Items, weights: np.ndarray) -> list[Group]:
    out, at = [], 0
    while at < len(items.ids):
        to, total = at, 0
        while to < len(items.ids) and to - at < GROUP_ITEMS and (to == at or total + len(items.terms[to]) <= GROUP_TERMS):
            total += len(items.terms[to])
            to += 1
        own = np.unique(np.concatenate(items.terms[at:to]))
        w = np.zeros((len(own), to - at), np.int64)
        for k in range(at, to):
            w[np.searchsorted(own, items.terms[k]), k - at] = weights[items.terms[k]]
        out.append(Group(np.arange(at, to), own, w))
        at = to
    return out


def blocks_of(docs: np.ndarray, projected: np.ndarray) -> np.ndarray:
    """The block of each document of a posting list, numbered from 0."""
    n = -(-len(docs) // BLOCK)
    if n <= 1:
        return np.zeros(len(docs), np.int64)
    centres = docs[(np.arange(n) * len(docs)) // n]
    return np.unique(np.argmax(projected[docs] @ projected[centres].T, axis=1), return_inverse=True)[1]


def _spans(edge: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in docs, posting) of all postings of the given documents."""
    size = edge[docs + 1] - edge[docs]
    place = np.repeat(np.arange(len(docs)), size)
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    return place, np.arange(len(place)) - start[place] + edge[docs][place]


def candidates(segment: Segment, group: Group, cutoff: np.ndarray, counts: dict | None = None) -> np.ndarray:
    """Pairs (document * items + item) that no bound rules out; ``segment`` holds terms of the group, by their place in it."""
    n_items, n_terms = len(group.items), len(group.terms)
    by_term = np.argsort(segment.term, kind="stable")
    doc = np.repeat(np.arange(len(segment.ids)), np.diff(segment.edge))[by_term]
    list_edge = np.searchsorted(segment.term[by_term], np.arange(n_terms + 1))
    most = np.zeros(n_terms, np.int64)
    np.maximum.at(most, segment.term, segment.impact)
    # terms whose products together stay below the cutoff need no visit
    visit = np.zeros((n_terms, n_items), bool)
    for q in range(n_items):
        own = np.flatnonzero(group.weights[:, q] * most)
        product = group.weights[own, q] * most[own]
        order = np.argsort(product / (list_edge[own + 1] - list_edge[own]), kind="stable")  # long lists of little weight first
        visit[own[order], q] = np.cumsum(product[order]) >= cutoff[q]
    norm = np.sqrt(np.maximum(1, np.add.reduceat(segment.impact.astype(float) ** 2, segment.edge[:-1])))
    direction = np.random.default_rng(11).standard_normal((n_terms, PROJECTED)).astype(np.float32)
    projected = np.add.reduceat(direction[segment.term] * segment.impact[:, None].astype(np.float32), segment.edge[:-1], axis=0)
    projected /= norm[:, None].astype(np.float32)
    # products of summaries in floating point are exact while they stay below 2^53
    exact = float(group.weights.max(initial=0)) * float(most.max(initial=0)) * n_terms < 2**53
    kind = np.float64 if exact else np.int64
    weights, impact = group.weights.astype(kind), segment.impact.astype(kind)
    column = np.full(n_terms, -1)
    out = []
    for t in np.flatnonzero(visit.any(axis=1)):
        asked = np.flatnonzero(visit[t])
        docs = doc[list_edge[t] : list_edge[t + 1]]
        block = blocks_of(docs, projected)
        # only the terms of the items that ask matter to their bounds
        shared = np.flatnonzero(weights[:, asked].any(axis=1))
        column[shared] = np.arange(len(shared))
        place, posting = _spans(segment.edge, docs)
        at = column[segment.term[posting]]
        held = at >= 0
        summary = np.zeros((block.max() + 1) * len(shared), kind)
        np.maximum.at(summary, block[place[held]] * len(shared) + at[held], impact[posting[held]])
        column[shared] = -1
        open_ = summary.reshape(-1, len(shared)) @ weights[np.ix_(shared, asked)] >= cutoff[asked]
        if counts is not None:
            counts["blocks"] = counts.get("blocks", 0) + open_.size
            counts["skipped"] = counts.get("skipped", 0) + int((~open_).sum())
        i, j = np.nonzero(open_[block])
        out.append(docs[i] * n_items + asked[j])
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)


def scores_of(segment: Segment, group: Group, pairs: np.ndarray) -> np.ndarray:
    """Exact scores of pairs (document * items + item)."""
    n_items = len(group.items)
    out = np.zeros(len(pairs), np.int64)
    size = np.diff(segment.edge)
    step = max(1, (1 << 22) // max(1, int(size.max(initial=1))))
    for a in range(0, len(pairs), step):
        docs, item = pairs[a : a + step] // n_items, pairs[a : a + step] % n_items
        place, posting = _spans(segment.edge, docs)
        product = group.weights[segment.term[posting], item[place]] * segment.impact[posting]
        starts = np.concatenate([[0], np.cumsum(size[docs])[:-1]])
        out[a : a + step] = np.add.reduceat(product, starts)
    return out


def _only(segment: Segment, terms: np.ndarray) -> Segment:
    """The documents that hold one of ``terms``, with these alone, numbered by their place."""
    at = np.minimum(np.searchsorted(terms, segment.term), len(terms) - 1) if len(terms) else np.zeros(len(segment.term), np.int64)
    own = terms[at] == segment.term if len(terms) else np.zeros(len(segment.term), bool)
    total = np.concatenate([[0], np.cumsum(own)])[segment.edge]
    size = np.diff(total)
    keep = size > 0
    return Segment(segment.ids[keep], segment.null[keep], np.concatenate([[0], np.cumsum(size[keep])]), at[own], segment.impact[own])


class Best:
    """The best documents of each item so far."""

    def __init__(self, n_items: int, wanted: int, cutoff: np.ndarray):
        self.wanted, self.cutoff = wanted, np.maximum(cutoff, 1)
        self.rows = [np.zeros(0, np.int64) for _ in range(4)]  # item, score, id, null id
        self.n_items = n_items

    def add(self, item: np.ndarray, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        good = score >= self.cutoff[item]
        rows = [np.concatenate([a, b[good].astype(np.int64)]) for a, b in zip(self.rows, (item, score, ids, null), strict=True)]
        order = np.lexsort((rows[2], rows[3], -rows[1], rows[0]))
        rows = [r[order] for r in rows]
        place = np.arange(len(order)) - np.searchsorted(rows[0], rows[0])
        keep = place < self.wanted
        last = place == self.wanted - 1
        self.cutoff[rows[0][last]] = np.maximum(self.cutoff[rows[0][last]], rows[1][last])
        self.rows = [r[keep] for r in rows]


def vectors(docs: DataFrame, items: Items, id_col: str, text: str) -> DataFrame:
    """(doc_id, n, term, tf): terms of every document in all, and those of the items with their counts."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast((items.hashes, items.size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, size = sent.value
        for b in pieces(batches):
            row, h, start, end = words(b.column(1), _BREAK)
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            known = (hashes[at] == h) & (size[at] == end - start)
            pair, count = np.unique(row[known] * len(hashes) + at[known], return_counts=True)
            edge = np.searchsorted(pair, np.arange(b.num_rows + 1) * len(hashes)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(edge), pa.array(v.astype(np.int32))) for v in (pair % len(hashes), count)]
            n = np.bincount(row, minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "term", "tf"])
        release()

    return rows.mapInArrow(run, "doc_id long, n long, term array<int>, tf array<int>")


def _corpus(rows: DataFrame, n_terms: int) -> Corpus:
    total = rows.agg(F.count(F.when(F.col("n") > 0, 1)).alias("documents"), F.sum("n").alias("length")).first()
    holders = np.zeros(n_terms, np.int64)
    for r in rows.select(F.explode("term").alias("term")).groupBy("term").count().collect():
        holders[r["term"]] = r["count"]
    return Corpus(total["documents"], total["length"] or 0, holders)


def _segments(batches: Iterator[pa.RecordBatch], corpus: Corpus) -> Iterator[Segment]:
    parts: list[tuple[np.ndarray, ...]] = []

    def glued() -> Segment:
        ids, null, size, term, impact = (np.concatenate(p) for p in zip(*parts, strict=True))
        return Segment(ids, null, np.concatenate([[0], np.cumsum(size)]), term, impact)

    for b in batches:
        edge = b.column(2).offsets.to_numpy().astype(np.int64)
        length, ids = b.column(1).to_numpy(), b.column(0)
        null = ids.is_null().to_numpy(zero_copy_only=False)
        ids = ids.fill_null(0).to_numpy()
        term, count = (b.column(k).flatten().to_numpy().astype(np.int64) for k in (2, 3))
        edge = edge - edge[0]
        at = 0
        while at < b.num_rows:
            held = sum(len(p[0]) for p in parts), sum(len(p[3]) for p in parts)
            to = min(b.num_rows, at + SEGMENT - held[0], int(np.searchsorted(edge, edge[at] + SEGMENT_POSTINGS - held[1], side="right")) - 1)
            if to <= at and parts:
                yield glued()
                parts.clear()
                continue
            to = max(to, at + 1)
            size = np.diff(edge[at : to + 1])
            span = slice(edge[at], edge[to])
            impact = corpus.impacts(np.repeat(length[at:to], size), count[span])
            parts.append((ids[at:to], null[at:to], size, term[span], impact))
            at = to
    if parts:
        yield glued()


def _found(rows: DataFrame, items: Items, corpus: Corpus, wanted: int, cutoff: np.ndarray) -> DataFrame:
    """(item, doc_id, score): the documents of each task that may be among the wanted ones of an item."""
    sent = rows.sparkSession.sparkContext.broadcast((items, corpus, cutoff))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, corpus, cutoff = sent.value
        groups = groups_of(items, corpus.weights())
        best = [Best(len(g.items), wanted, cutoff[g.items]) for g in groups]
        for whole in _segments(batches, corpus):
            for g, b in zip(groups, best, strict=True):
                own = _only(whole, g.terms)
                if len(own.ids):
                    pairs = candidates(own, g, b.cutoff)
                    doc = pairs // len(g.items)
                    b.add(pairs % len(g.items), scores_of(own, g, pairs), own.ids[doc], own.null[doc])
        for g, b in zip(groups, best, strict=True):
            item, score, ids, null = b.rows
            cols = [pa.array(g.items[item], pa.int64()), pa.array(ids, pa.int64(), mask=null.astype(bool)), pa.array(score, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["item", "doc_id", "score"])
        release()

    return rows.where(F.size("term") > 0).select("doc_id", "n", "term", "tf").mapInArrow(run, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, wanted: int = WANTED, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the highest-scoring documents of each item, equal scores by ascending doc_id."""
    spark = docs.sparkSession
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("t"))
    total = asked.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id", "t").collect()
        known = Items.of([(r[0], r[1]) for r in own])
        if not len(known.hashes):
            continue
        rows = vectors(docs, known, id_col, text)
        # dealt out so that a task has about a segment, however small the vectors are
        rows = stored(rows.repartition(1 + docs.count() // SEGMENT))
        corpus = _corpus(rows, len(known.hashes))
        if not corpus.documents:
            continue
        place = Window.partitionBy("item").orderBy(F.desc("score"))
        first = _found(rows.where(F.pmod(F.xxhash64("doc_id", "n"), F.lit(FIRST)) == 0), known, corpus, wanted, np.ones(len(known.ids), np.int64))
        cutoff = np.ones(len(known.ids), np.int64)
        for r in first.withColumn("place", F.row_number().over(place)).where(F.col("place") == wanted).collect():
            cutoff[r["item"]] = r["score"]
        names = small_table(spark, list(enumerate(known.ids)), "item long, item_id long")
        found = _found(rows, known, corpus, wanted, cutoff).join(F.broadcast(names), "item")
        ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= wanted)
        out = out.unionByName(ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    return out


_TERMS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
#: DuckDB twin: every document scored for every item.
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL),
stats AS (SELECT count(*) FILTER (len(terms) > 0) AS docs, CAST(sum(len(terms)) AS BIGINT) AS total FROM d),
post AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY r, term),
asked AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE text IS NOT NULL)),
weight AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM post, stats WHERE term IN (SELECT term FROM asked) GROUP BY term
),
length AS (SELECT r, doc_id, 50 + (50 * CAST(len(terms) AS BIGINT) * docs) // total AS m FROM d, stats WHERE len(terms) > 0),
scored AS (
  SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM asked JOIN weight USING (term) JOIN post USING (term) JOIN length USING (r) GROUP BY item_id, r, doc_id
),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {WANTED}
"""
