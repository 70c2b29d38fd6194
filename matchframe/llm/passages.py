"""Substring dedup: paragraphs that repeat, by MinHash bands, exact confirmation and components; and repeated runs of words.

A paragraph is a line of ``LEAST`` words or more. Its shingles of five words give rows x bands minima; paragraphs that
agree in a whole band meet. The number of bands is tuned so that a pair at the threshold is missed with less than
``MISS``. Meeting paragraphs are confirmed by exact Jaccard similarity, and linked ones form classes, of which the first
paragraph (smallest doc_id, then place) stays. Paragraphs with equal shingle sets are one node from the start.

A run is ``LEAST`` words or more, whatever lines they stand on, that stand in the same order elsewhere too. Of the hashes of
25 words from all places, the least of each 26 neighbours is a mark, so every 50 words hold one, and equal runs an equal one.
Only ``LEAST`` words whose mark occurs twice are hashed and looked up. Places whose first occurrences follow one
another form a run, and its class is the run of those first occurrences. No pairs are formed: rows grow with the words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchframe.llm import minhash
from matchframe.llm.linking import MAP_BITS, bit_map, in_map, link, slot_of
from matchframe.llm.store import dropped, stored
from matchframe.llm.text import blobs, bytes_of, mix, pieces, release, rolled, shingles, words

LEAST, WORDS, PERCENT = 50, 5, 80
ROWS, MISS = 4, 5e-4


def tuned_bands(percent: int = PERCENT, rows: int = ROWS, miss: float = MISS) -> int:
    """Fewest bands of ``rows`` minima for which a pair at the threshold shares none with probability ``miss`` at most."""
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows))


def _paragraphs(column: pa.Array, least: int):
    """Per long line: its row, place, words, bytes from and to; and (line, hash) of its words, lines numbered from 0."""
    row, h, start, end = words(column)
    data, offsets = bytes_of(column)
    breaks = np.concatenate([[0], np.cumsum(data == 0x0A)])
    place = breaks[start] - breaks[offsets[:-1]][row]
    first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (place[1:] != place[:-1])])) if len(row) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(row)).astype(np.int64) - 1
    n = last - first + 1
    long = n >= least
    line = np.cumsum(long) - 1
    inside = np.repeat(long, n)
    first, last = first[long], last[long]
    return row[first], place[first], n[long], start[first], end[last], np.repeat(line, n)[inside], h[inside], data, offsets


def paragraphs(docs: DataFrame, bands: int, least: int = LEAST, text: str = "text") -> DataFrame:
    """(doc_id, paragraph, start, end, n_words, id, size, sketch, keys) of every long line; positions in code points."""
    schema = "doc_id long, paragraph int, start int, end int, n_words int, id long, size long, sketch array<long>, keys array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            row, place, n, start, end, line, h, data, offsets = _paragraphs(b.column(1), least)
            m = len(row)
            if not m:
                continue
            points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            before = points[offsets[:-1]][row]
            lines, h = shingles(line, h, m, WORDS)
            low = minhash.minima(lines, h, m, bands * ROWS).reshape(m, bands, ROWS)
            keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (m, bands))
            for r in range(ROWS):
                keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + low[:, :, r])
            keys = pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * bands, pa.int32()), pa.array(keys.view(np.int64).ravel()))
            whole = [place, points[start] - before, points[end] - before, n]
            cols = [b.column(0).take(pa.array(row)), *(pa.array(x.astype(np.int32)) for x in whole)]
            cols += [pa.array(minhash.digest(lines, h, m)[0]), pa.array(np.bincount(lines, minlength=m).astype(np.int64)), minhash.sketch(lines, h, m), keys]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "paragraph", "start", "end", "n_words", "id", "size", "sketch", "keys"])
        release()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.where("doc_id is not null and text is not null").mapInArrow(run, schema)


def _sets(docs: DataFrame, least: int, in_docs: np.ndarray, in_ids: np.ndarray) -> DataFrame:
    """(id, set) of the paragraphs, of documents in one map, whose ids are in the other; ``docs`` has slot and text."""
    sent = docs.sparkSession.sparkContext.broadcast((in_docs, in_ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            ours = whole.filter(pa.array(in_map(sent.value[0], whole.column(0).to_numpy())))
            for b in pieces(iter([ours])):
                row, _, _, _, _, line, h, _, _ = _paragraphs(b.column(1), least)
                m = len(row)
                if not m:
                    continue
                lines, h = shingles(line, h, m, WORDS)
                ids = minhash.digest(lines, h, m)[0]
                wanted = in_map(sent.value[1], ids & (MAP_BITS - 1))
                yield pa.RecordBatch.from_arrays([pa.array(ids[wanted]), blobs(h[wanted[lines]], np.bincount(lines, minlength=m)[wanted])], names=["id", "set"])
        release()

    return docs.mapInArrow(run, "id long, set binary")


def _least(value: np.ndarray, width: int) -> np.ndarray:
    """Of every ``width`` neighbours the place of the least value, the last one of equals."""
    if len(value) < width:
        return np.zeros(0, np.int64)
    at, size = np.arange(len(value)), 1
    while size < width:
        step = min(size, width - size)
        later = value[step:] <= value[:-step]
        at = np.where(later, at[step:], at[:-step])
        value = np.where(later, value[step:], value[:-step])
        size += step
    return at


def _marked(row: np.ndarray, h: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all ``least`` words from a place: whether they are of one row, the word of their mark (the last of the least hashes in
    them); and the hashes of the marks from every word."""
    size = (least + 1) // 2
    value = rolled(h, size)
    mark = _least(value, least - size + 1)
    return row[: len(mark)] == row[len(row) - len(mark) :], mark, value


def _places(column: pa.Array):
    """Row and hash of every word, first word of every row; line, start and end of every word, in code points of its row."""
    row, h, start, end = words(column)
    data, offsets = bytes_of(column)
    top = offsets[:-1][row]
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    breaks = np.concatenate([[0], np.cumsum(data == 0x0A)])
    return row, h, np.searchsorted(row, np.arange(len(column))), breaks[start] - breaks[top], points[start] - points[top], points[end] - points[top]


def _marks(source: DataFrame, least: int) -> DataFrame:
    """Per text of ``least`` words or more: doc_id, copy, n_words, line, last, start, end (of all its words), marks."""
    schema = "doc_id long, copy long, n_words int, line int, last int, start int, end int, marks array<struct<mark: long, place: int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            row, h, first, line, start, end = _places(b.column(2))
            n = np.bincount(row, minlength=b.num_rows)
            of = np.flatnonzero(n >= least)
            if not len(of):
                continue
            whole, mark, value = _marked(row, h, least)
            at = np.unique(mark[whole])
            edges = np.append(np.searchsorted(row[at], of), len(at))
            marks = pa.StructArray.from_arrays([pa.array(value[at].view(np.int64)), pa.array((at - first[row[at]]).astype(np.int32))], names=["mark", "place"])
            head, tail = first[of], first[of] + n[of] - 1
            cols = [b.column(0).take(pa.array(of)), b.column(1).take(pa.array(of)), *(pa.array(x.astype(np.int32)) for x in (n[of], line[head], line[tail], start[head], end[tail]))]
            cols.append(pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), marks))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "copy", "n_words", "line", "last", "start", "end", "marks"])
        release()

    return source.mapInArrow(run, schema)


def _holding(source: DataFrame, in_docs: np.ndarray) -> DataFrame:
    """``source`` (slot, doc_id, copy, text) without slot, of documents in the map."""
    sent = source.sparkSession.sparkContext.broadcast(in_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(in_map(sent.value, b.column(0).to_numpy()))).select([1, 2, 3])
        release()

    return source.select("slot", "doc_id", "copy", "text").mapInArrow(run, "doc_id long, copy long, text string")


def _apart(row: np.ndarray, gram: np.ndarray, place: np.ndarray, least: int) -> np.ndarray:
    """Which places to keep so that equal words of one row do not overlap, as they do in "a a a": the first, then the next free."""
    keep = np.ones(len(place), bool)
    order = np.lexsort((place, gram, row))
    again = np.flatnonzero((row[order[1:]] == row[order[:-1]]) & (gram[order[1:]] == gram[order[:-1]])) + 1
    taken, before = 0, -1
    for k in again.tolist():
        if k - 1 != before:  # a new group, whose first place stays
            taken = place[order[k - 1]]
        if place[order[k]] < taken + least:
            keep[order[k]] = False
        else:
            taken = place[order[k]]
        before = k
    return keep


def _around(marked: DataFrame, least: int) -> DataFrame:
    """(doc_id, copy, place, line, last, start, end, gram) of all ``least`` words whose mark is one of those at ``places``.

    ``marked`` has doc_id, copy, text and places.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            row, h, first, line, start, end = _places(b.column(2))
            gram = rolled(h, least)
            marks = b.column(3)
            shared = np.zeros(len(h), bool)
            shared[marks.flatten().to_numpy() + np.repeat(first, pc.list_value_length(marks).to_numpy())] = True
            whole, mark, _ = _marked(row, h, least)
            place = np.flatnonzero(whole & shared[mark])
            place = place[_apart(row[place], gram[place], place, least)]
            of, tail = pa.array(row[place]), place + least - 1
            cols = [b.column(0).take(of), b.column(1).take(of), *(pa.array(x.astype(np.int32)) for x in (place - first[row[place]], line[place], line[tail], start[place], end[tail]))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(gram[place].view(np.int64))], names=["doc_id", "copy", "place", "line", "last", "start", "end", "gram"])
        release()

    return marked.select("doc_id", "copy", "text", "places").mapInArrow(run, "doc_id long, copy long, place int, line int, last int, start int, end int, gram long")


def runs(docs: DataFrame, least: int = LEAST, text: str = "text") -> DataFrame:
    """Every run that stands in several places: doc_id, copy (a hash of its text), line and last (its lines), start, end,
    n_words, head_doc, head_copy, head_line, head_last, head_place (where its words stand first) and place, in words.

    Rows whose own place is their first are the classes; a class's other rows have their ``head_place`` inside it. A text
    that is equal to another's is one run as a whole.
    """
    source = docs.where(F.col("doc_id").isNotNull() & F.col(text).isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    source = source.where(F.col("doc_id").isNotNull()).select(slot_of(F.col("doc_id")).alias("slot"), "doc_id", F.xxhash64("text").alias("copy"), "text")
    every = stored(_marks(source.select("doc_id", "copy", "text"), least))
    texts = every.drop("marks").dropDuplicates(["doc_id", "copy"])
    firsts = stored(texts.groupBy("copy").agg(F.min("doc_id").alias("head_doc"), F.count(F.lit(1)).alias("n")))
    same = stored(texts.join(firsts.where("n > 1"), "copy").select(
        "doc_id", "copy", "line", "last", "start", "end", "n_words", "head_doc", F.col("copy").alias("head_copy"),
        F.col("line").alias("head_line"), F.col("last").alias("head_last"), F.lit(0).alias("head_place"), F.lit(0).alias("place"),
    ))
    # equal texts have their marks at equal places, which count once
    marks = every.select("copy", F.explode("marks").alias("m")).select("copy", "m.mark", "m.place")
    spot = F.xxhash64("copy", "place")
    shared = marks.groupBy("mark").agg(F.min(spot).alias("low"), F.max(spot).alias("high")).where("low < high")
    shared = stored(shared.select("mark"))
    hits = marks.join(shared, "mark").groupBy("copy").agg(F.collect_set("place").alias("places"))
    hits = stored(hits.join(firsts.select("copy", F.col("head_doc").alias("doc_id")), "copy"))
    dropped(every, shared)
    held = _holding(source, bit_map(hits.select(slot_of(F.col("doc_id")).alias("slot"))))
    # rows that repeat are in one place after the join
    marked = held.join(hits, ["doc_id", "copy"]).dropDuplicates(["doc_id", "copy"])
    grams = stored(_around(marked, least))
    dropped(hits)
    # the first of equal words by id, and of those whose words stand once nothing
    alike = Window.partitionBy("gram").orderBy("doc_id", "copy", "place")
    head = [F.first(c).over(alike.rowsBetween(Window.unboundedPreceding, 0)).alias(f"head_{n}") for c, n in (("doc_id", "doc"), ("copy", "copy"), ("place", "place"), ("line", "line"), ("last", "last"))]
    several = (F.row_number().over(alike) > 1) | F.lead("place").over(alike).isNotNull()
    placed = grams.select("*", *head, several.alias("several")).where("several").drop("gram", "several")
    # places of a run keep their distance from their first occurrences, and follow one another
    key = ["doc_id", "copy", "head_doc", "head_copy", "apart"]
    placed = placed.withColumn("apart", F.col("place") - F.col("head_place"))
    along = Window.partitionBy(*key).orderBy("place")
    begins = F.coalesce(F.lag("place").over(along) != F.col("place") - 1, F.lit(True))
    closes = F.coalesce(F.lead("place").over(along) != F.col("place") + 1, F.lit(True))
    edges = placed.select("*", begins.alias("begins"), closes.alias("closes")).where("begins or closes")
    # next to the place where a run begins stands the one where it closes, unless it is the same
    z = {c: F.when(F.col("closes"), F.col(c)).otherwise(F.lead(c).over(along)).alias(f"z_{c}") for c in ("place", "last", "end", "head_last")}
    spans = edges.select(*key, "line", "start", "head_place", "head_line", "begins", "place", *z.values()).where("begins")
    found = stored(spans.select(
        "doc_id", "copy", "line", F.col("z_last").alias("last"), "start", F.col("z_end").alias("end"), (F.col("z_place") - F.col("place") + least).alias("n_words"),
        "head_doc", "head_copy", "head_line", F.col("z_head_last").alias("head_last"), "head_place", "place",
    ))
    dropped(grams, firsts)
    return found.unionByName(same)


def _told(found: DataFrame, lines: DataFrame) -> DataFrame:
    """``found`` without the runs that stand in a line and first in a line of the same class; ``lines`` has the classes."""
    known = lines.groupBy("doc_id", "paragraph").agg(F.min("first").alias("low"), F.max("first").alias("high")).where("low = high")
    a = known.select("doc_id", F.col("paragraph").alias("line"), F.col("low").alias("class_a"))
    b = known.select(F.col("doc_id").alias("head_doc"), F.col("paragraph").alias("head_line"), F.col("low").alias("class_b"))
    out = found.join(a, ["doc_id", "line"], "left").join(b, ["head_doc", "head_line"], "left")
    told = (F.col("line") == F.col("last")) & (F.col("head_line") == F.col("head_last")) & (F.col("class_a") == F.col("class_b"))
    return out.where(~F.coalesce(told, F.lit(False))).drop("class_a", "class_b")


def _run_rows(every: DataFrame, lines: DataFrame) -> DataFrame:
    """Rows of ``repeats`` for the runs that lines do not tell."""
    own = F.expr("doc_id = head_doc and copy = head_copy and place = head_place")
    members = stored(_told(every.where(~own), lines))
    starts = every.where(own).groupBy("head_doc", "head_copy").agg(F.sort_array(F.collect_list(F.struct("place", "n_words", "line", "last", "start", "end"))).alias("starts"))
    # the longest of the runs of first occurrences around the place is the class: a whole text, or the one that begins last
    inside = F.expr("filter(starts, x -> x.place <= head_place and x.place + x.n_words >= head_place + n_words)")
    members = members.join(starts, ["head_doc", "head_copy"]).withColumn("head", F.element_at(inside, -1))
    members = stored(members.select("doc_id", "line", "start", "end", "n_words", "head_doc", "head_copy", "head"))
    named = [F.col("head_doc").alias("class_doc"), F.col("head.line").alias("class_paragraph"), F.col("head.start").alias("class_start")]
    removed = members.select("doc_id", F.col("line").alias("paragraph"), "start", "end", "n_words", *named, F.lit(True).alias("removed"))
    firsts = members.select("head_doc", "head_copy", "head").distinct()
    kept = firsts.select(F.col("head_doc").alias("doc_id"), F.col("head.line").alias("paragraph"), "head.start", "head.end", "head.n_words", *named, F.lit(False).alias("removed"))
    return removed.unionByName(kept).withColumn("unit", F.lit("run"))


def repeats(docs: DataFrame, least: int = LEAST, percent: int = PERCENT, text: str = "text") -> DataFrame:
    """Every paragraph and run that belongs to a class of several: doc_id, paragraph (a run's first line), start, end,
    n_words, class_doc, class_paragraph and class_start (where its class's first one stands), removed (all but the first)
    and unit ("line" or "run").

    Runs in lines that are in one class anyway are left out. Runs of a document may overlap. Null and empty texts have no paragraphs; rows without a doc_id take no part. Rows that repeat a doc_id are the same
    document: a paragraph at the same place with the same words counts once.
    """
    described = stored(paragraphs(docs, tuned_bands(percent), least, text))
    every = stored(described.drop("size", "sketch", "keys").dropDuplicates(["doc_id", "paragraph", "id"]))
    heads = stored(every.groupBy("id").agg(F.min(F.struct("doc_id", "paragraph", "start")).alias("head"), F.count(F.lit(1)).alias("n")))
    at_head = heads.select("id", "head.doc_id", "head.paragraph")
    nodes = stored(described.select("id", "size", "sketch", "keys").dropDuplicates(["id"]))
    dropped(described)
    source = docs.where("doc_id is not null and text is not null").select(slot_of(F.col("doc_id").cast("long")).alias("slot"), F.col(text).alias("text"))

    def sets_of(ids: DataFrame) -> DataFrame:
        in_docs = bit_map(at_head.join(ids, "id", "left_semi").select(slot_of(F.col("doc_id")).alias("slot")))
        in_ids = bit_map(ids.select(F.col("id").bitwiseAND(MAP_BITS - 1).alias("slot")))
        found = _sets(source, least, in_docs, in_ids).join(ids, "id", "left_semi")
        # a paragraph may stand several times in the documents that were let through
        return stored(found.groupBy("id").agg(F.first("set").alias("set")))

    found = link(nodes, sets_of, percent)
    dropped(nodes)
    of = heads.join(found, "id", "left").select("id", "head", "n", F.coalesce("component", "id").alias("class"))
    of = stored(of)
    classes = of.groupBy("class").agg(F.sum("n").alias("members"), F.min("head").alias("first")).where("members > 1")
    told = of.select("id", "class").join(classes, "class").select("id", "first")
    out = stored(every.join(told, "id"))
    dropped(every)
    removed = (F.col("doc_id") != F.col("first.doc_id")) | (F.col("paragraph") != F.col("first.paragraph"))
    first = [F.col("first.doc_id").alias("class_doc"), F.col("first.paragraph").alias("class_paragraph"), F.col("first.start").alias("class_start")]
    lines = out.select("doc_id", "paragraph", "start", "end", "n_words", *first, removed.alias("removed"), F.lit("line").alias("unit"))
    return lines.unionByName(_run_rows(runs(docs, least, text), out))
