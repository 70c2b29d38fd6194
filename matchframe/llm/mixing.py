"""Mixing sources to target weights by systematic sampling.

Within a source every document has the same expected number of copies, its target over its size. Documents are laid in
order of size, expected copies are summed from the front, one random offset is added, and a document is taken once for
every whole number the running sum passes. Neighbours in the order are of like size, so a source's words come within
about one document of its target. ``mix`` tells the copies of each document, ``emit`` gives the corpus itself, with a row
for each copy. Positions come from counts per (source, size, slice), never from one ordered group:
a source may hold any share of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchframe.llm.store import stored

#: Weights of the sources in order, repeating; share of all words; most copies.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Rows of one size that share an ordered slice.
SLICE = 1000
SEED = 20


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def ranked(keys: DataFrame, by: str) -> DataFrame:
    """``keys`` with ``rank`` from 0 in ascending order of ``by``, null last, without one task that sees all rows."""
    spread = stored(keys.repartitionByRange(F.col(by).asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    counts = spread.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row for each task
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col(by).asc_nulls_last()))
    return spread.withColumn("place", place).join(before, "part").withColumn("rank", F.col("before") + F.col("place") - 1).drop("part", "place", "before")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, rank, source_size, docs, target) from rows (source, size).

    Targets split ``share`` of all words by weight; one that exceeds ``most`` times its source's size stops there and its
    excess is shared again, until none is above. Each round is one aggregate; rounds are at most as many as sources.
    """
    table = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    table = stored(ranked(table, "source").withColumn("weight", weight).withColumn("most", most * F.col("source_size")))
    level, capped = 0.0, -1
    while True:
        above = F.col("weight") * level > F.col("most") if capped >= 0 else F.lit(False)
        row = table.agg(
            F.sum("source_size"), F.sum(F.when(above, F.col("most"))), F.sum(F.when(~above, F.col("weight"))), F.count(F.when(above, 1))
        ).first()
        if row[0] is None or row[3] == capped or row[2] is None:
            break
        level, capped = max(0.0, share * row[0] - (row[1] or 0)) / row[2], row[3]
    return table.withColumn("target", F.least(F.col("most").cast("double"), F.col("weight") * level)).drop("weight", "most")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED, keep_columns: bool = True) -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken (= copies x size); one row per input row, copies may be 0.

    Columns of these names are replaced. Null texts and empty ones have size 0; a null source is a source of its own, the
    last. Rows that are equal take any of their copies. The offset is a hash of the source and ``seed``, so reruns agree.
    ``keep_columns=False`` returns doc_id, source and the new columns only, and moves nothing else.
    """
    new = ["size", "source_size", "target", "copies", "taken"]
    kept = [c for c in docs.columns if c not in new] if keep_columns else ["doc_id", "source"]
    # the input row goes along as one column, so that none of its columns meets a working one
    rows = docs.select(F.struct(*kept).alias("row"), "doc_id", "source", word_count(F.col("text")).alias("size"))
    rows = rows if keep_columns else stored(rows)
    wanted = stored(targets(rows.select("source", "size"), weights, share, most))
    by_size = rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("rank").orderBy("size")
    by_size = by_size.join(wanted.select(F.col("source").alias("s"), "rank"), F.col("source").eqNullSafe(F.col("s")))
    by_size = stored(by_size.select("rank", "size", "n", (F.sum("n").over(order) - F.col("n")).alias("before")))
    # the slices of a size: from the narrow rows, then their places in it
    ranks = wanted.select(F.col("source").alias("s"), "rank", "source_size", "target")
    placed = rows.join(ranks, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    placed = placed.join(by_size.withColumn("slices", F.ceil(F.col("n") / SLICE)).drop("n"), ["rank", "size"])
    placed = placed.withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.col("slices")))
    narrow = placed.select("rank", "size", "slice")
    in_size = Window.partitionBy("rank", "size").orderBy("slice")
    slices = narrow.groupBy("rank", "size", "slice").agg(F.count(F.lit(1)).alias("m"))
    slices = slices.withColumn("ahead", F.sum("m").over(in_size) - F.col("m")).drop("m")
    within = F.row_number().over(Window.partitionBy("rank", "size", "slice").orderBy("doc_id")) - 1
    at = (F.col("before") + F.col("ahead") + F.col("within")).cast("double")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = F.pmod(F.xxhash64(F.lit(seed), F.lit("mix"), F.coalesce(F.col("source"), F.lit("")), F.col("source").isNull()), F.lit(1 << 30)) / F.lit(float(1 << 30))
    out = placed.join(slices, ["rank", "size", "slice"]).withColumn("within", within)
    out = out.withColumn("copies", (F.floor((at + 1) * rate + offset) - F.floor(at * rate + offset)).cast("long"))
    return out.withColumn("taken", F.col("copies") * F.col("size")).select("row.*", *new)


def emit(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as ``mix`` takes it, with the columns of ``mix`` and ``copy`` from 1.

    Rows with no copies are left out. A column of the input called ``copy`` is replaced.
    """
    mixed = mix(docs.drop("copy"), weights, share, most, seed)
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
