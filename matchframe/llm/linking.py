"""Links between sets that share a key, confirmed on the whole sets, and the classes the links form.

Shared by the near-duplicate operators. Items with equal sets are one class from the start; only one of them goes on.
A key's members are never paired with each other. In each round a key offers one of its members as a partner, and every
other member tests one partner, the one that most of its keys offer. Links merge classes. What is left after the rounds
are keys whose members are in different classes; those pairs of members that no round has tested, and whose sizes and
sketches allow a link, are tested as well, so no link between classes is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchframe.llm.minhash import SKETCH_BINS, SKETCH_LONGS
from matchframe.llm.store import dropped, stored
from matchframe.llm.text import release

#: Rounds in which keys offer partners before the rest is tested.
ROUNDS = 3
#: Standard deviations, and bits besides, by which the sketches of a linked pair may differ beyond what is expected: a
#: linked pair is beyond them with probability below 1e-8.
SKETCH_DEVIATIONS, SKETCH_SLACK = 5.6, 4


def components(links: DataFrame) -> DataFrame:
    """(id, component) for the ends of ``links`` (a, b): the smallest id that can be reached.

    Labels are handed to neighbours and through labels until none changes; a round is a few joins.
    """
    both = stored(links.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(links.select(F.col("b").alias("x"), F.col("a").alias("y"))).distinct())
    labels = both.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("id"), F.least("x", "y").alias("component"))
    labels = stored(labels)
    while True:
        of = labels.select(F.col("id").alias("y"), F.col("component").alias("near"))
        near = both.join(of, "y").groupBy("x").agg(F.min("near").alias("near")).withColumnRenamed("x", "id")
        lower = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("further"))
        lower = lower.join(jump, "component").select("id", "old", F.least("component", "further").alias("component"))
        lower = stored(lower)
        moved = lower.where("old <> component").limit(1).count()
        labels = lower.drop("old")
        if not moved:
            return labels


#: Bits of the map that tells which texts a step needs; its size is fixed, and what it lets through besides is dropped by
#: the joins that follow.
MAP_BITS = 1 << 24


def bit_map(slots: DataFrame) -> np.ndarray:
    """The values of ``slot`` (0 to MAP_BITS - 1) as a map of MAP_BITS / 8 bytes, whatever the number of rows."""
    rows = slots.groupBy(F.shiftright("slot", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("word")).collect()
    out = np.zeros(MAP_BITS // 64, np.int64)
    out[[r["at"] for r in rows]] = [r["word"] for r in rows]
    return out


def in_map(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bits.view(np.uint64)[slots >> 6] >> (slots & 63).astype(np.uint64)) & np.uint64(1) == 1


def slot_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(MAP_BITS))


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs whose sets (id, set: sorted 64-bit numbers as bytes) share ``percent`` of their union."""
    left = sets.select(F.col("id").alias("a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("id").alias("b"), F.col("set").alias("set_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                good[i] = _linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent)
            yield batch.select([0, 1]).filter(pa.array(good))

    found = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b")
    return found.mapInArrow(run, "a long, b long")


def _limit(least, percent: int, root, smaller):
    """Most bits that the sketches of a linked pair differ in, whose smaller set has ``least`` members.

    The pair's union fills at most ``bins`` bins, and a filled one differs in its bit with half the chance that its least
    hash does.
    """
    odds = (1 - percent / 100) / 2
    bins = smaller(least * (100 / percent), float(SKETCH_BINS))
    return bins * odds + root(bins * (odds * (1 - odds))) * SKETCH_DEVIATIONS + SKETCH_SLACK


def alike(percent: int) -> Column:
    """Sizes and sketches of a pair allow a link."""
    least = F.least("size_a", "size_b")
    differ = sum((F.bit_count(F.col("sketch_a")[i].bitwiseXOR(F.col("sketch_b")[i])) for i in range(SKETCH_LONGS)), F.lit(0))
    limit = _limit(least, percent, F.sqrt, lambda x, y: F.least(x, F.lit(y)))
    return (100 * least >= percent * F.greatest("size_a", "size_b")) & (differ <= limit)


def _described(pairs: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    a = items.select(F.col("id").alias("a"), F.col("size").alias("size_a"), F.col("sketch").alias("sketch_a"))
    b = items.select(F.col("id").alias("b"), F.col("size").alias("size_b"), F.col("sketch").alias("sketch_b"))
    return pairs.join(a, "a").join(b, "b").where(alike(percent)).select("a", "b")


def link(items: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """(id, component) for every item that is linked with another one.

    ``items``: id (unique), size, sketch, keys (array of longs), with no two equal sets; ``sets_of`` gives (id, set) of the
    items in a table of ids, as a table of ``stored`` that is dropped here. ``component`` is the smallest id of the class.
    """
    narrow = items.select("id", "size", "sketch")
    keyed = items.select("id", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = stored(keyed.join(shared.select("key"), "key").select("key", "id"))
    links, tested, classes = None, None, None
    for round_ in range(ROUNDS):
        order = F.struct(F.xxhash64(F.lit(round_), "id").alias("at"), F.col("id").alias("b"))
        offered = members.groupBy("key").agg(F.min(order)["b"].alias("b"))
        pairs = members.join(offered, "key").where("id <> b").groupBy(F.col("id").alias("a"), "b").agg(F.count(F.lit(1)).alias("n"))
        if classes is not None:
            pairs = _apart(pairs, classes)
        pairs = pairs.groupBy("a").agg(F.max(F.struct("n", "b"))["b"].alias("b"))
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = stored(_described(pairs, narrow, percent))
        if pairs.isEmpty():
            continue
        ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
        sets = sets_of(ends)
        new = stored(confirm(pairs, sets, percent))
        dropped(sets)
        tested = pairs if tested is None else tested.unionByName(pairs)
        if not new.isEmpty():
            links = new if links is None else links.unionByName(new)
            classes = components(links)
    rest = _between_classes(members, items, classes, sets_of, percent)
    dropped(members)
    if rest is not None and not rest.isEmpty():
        classes = components(rest if links is None else links.unionByName(rest))
    if classes is None:
        return items.select("id", F.col("id").alias("component")).limit(0)
    return classes


#: Members of a key that are compared at a time, and members of sets (8 bytes each) that are fetched together.
CHUNK, FETCH = 1024, 1 << 17


def _between_classes(members: DataFrame, items: DataFrame, classes: DataFrame | None, sets_of, percent: int) -> DataFrame | None:
    """Links (a, b) that join all classes that hold linked members of one key.

    Members are compared chunk by chunk; a pair is looked at in the first key it shares. What sizes and sketches allow
    goes on as lists for pairs of blocks, a block being items with the same fullest key around them, and sets are fetched block by
    block. A pair whose classes other links have joined by then needs no test. So rows grow with the members, not with
    their pairs.
    """
    of = _class_of(members, classes)
    mixed = of.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count(F.lit(1)).alias("n"))
    mixed = mixed.where("low < high").select("key", "n")
    left = stored(of.join(mixed, "key"))
    if left.isEmpty():
        return None
    # an item's home is the fullest key that it, or an item it shares a key with, has
    fullest = left.groupBy("id").agg(F.max(F.struct("n", "key")).alias("home"))
    around = left.select("key", "id").join(fullest, "id").groupBy("key").agg(F.max("home").alias("home"))
    home = left.select("key", "id", "class").join(around, "key").groupBy("id", "class").agg(F.max("home")["key"].alias("home"))
    home = home.join(items.select("id", "size"), "id")
    filled = home.groupBy("home").agg(F.sum("size").alias("filled"))
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("filled") / FETCH))
    block_of = stored(home.join(filled, "home").select("id", "class", F.xxhash64("home", part).alias("block")))
    # keys only tell whether an earlier one is shared; their upper halves do, wrongly with probability below 1e-8 a pair
    short = F.transform("keys", lambda k: F.shiftright(k, 32).cast("int")).alias("keys")
    row = F.struct("id", "class", "size", "sketch", "block", "keys")
    described = items.select("id", "size", "sketch", short)
    chunks = left.join(block_of.drop("class"), "id").join(described, "id").withColumn("chunks", F.ceil(F.col("n") / CHUNK))
    chunks = chunks.withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")))
    chunks = stored(chunks.groupBy("key", "chunk", "chunks").agg(F.collect_list(row).alias("rows")))
    within = chunks.select(F.lit(True).alias("own"), "key", "rows", F.col("rows").alias("rows_b"))
    split = chunks.where("chunks > 1")
    other = split.select("key", F.col("chunk").alias("chunk_b"), F.col("rows").alias("rows_b"))
    met = within.unionByName(split.join(other, "key").where("chunk < chunk_b").select(F.lit(False).alias("own"), "key", "rows", "rows_b"))
    lists = met.mapInArrow(_candidates(percent), "block_a long, block_b long, a array<long>, b array<long>")
    flat = [F.flatten(F.collect_list(c)).alias(c) for c in ("a", "b")]
    lists = lists.groupBy("block_a", "block_b").agg(*flat)
    # the side with fewer items comes first: its sets travel to the other's block
    turn = F.size(F.array_distinct("a")) > F.size(F.array_distinct("b"))
    sides = [("block_a", "block_b"), ("block_b", "block_a"), ("a", "b"), ("b", "a")]
    lists = stored(lists.select(*[F.when(turn, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in sides]))
    dropped(left, chunks)
    if lists.isEmpty():
        return None
    used = lists.select(F.explode(F.array_distinct(F.concat("a", "b"))).alias("id")).distinct()
    inside = stored(block_of.join(used, "id", "left_semi"))
    sets = sets_of(inside.select("id"))
    blocks = sets.join(inside, "id").groupBy("block").agg(F.collect_list(F.struct("id", "class", "set")).alias("sets"))
    blocks = stored(blocks)
    dropped(sets)
    first = blocks.select(F.col("block").alias("block_a"), F.col("sets").alias("sets_a"))
    second = blocks.select(F.col("block").alias("block_b"), F.col("sets").alias("sets_b"))
    work = lists.withColumn("ids_a", F.array_distinct("a")).withColumn("ids_b", F.array_distinct("b")).join(first, "block_a")
    alone = work.where("block_a = block_b").select("a", "b", "sets_a", F.expr("filter(sets_a, x -> false)").alias("sets_b"))
    across = work.where("block_a <> block_b").withColumn("sets_a", F.expr("filter(sets_a, x -> array_contains(ids_a, x.id))")).join(second, "block_b")
    across = across.select("a", "b", "sets_a", F.expr("filter(sets_b, x -> array_contains(ids_b, x.id))").alias("sets_b"))
    found = stored(alone.unionByName(across).mapInArrow(_verified(percent), "a long, b long"))
    dropped(block_of, lists, inside, blocks)
    return found


def _columns(rows: pa.Array, names: list[str]) -> list[np.ndarray]:
    return [rows.field(n).to_numpy(zero_copy_only=False) for n in names]


def _matrix(lists: pa.ListArray) -> np.ndarray:
    """Lists of one length as rows."""
    return lists.flatten().to_numpy().reshape(len(lists), -1)


def _candidates(percent: int):
    names = ["id", "class", "size", "block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, key, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                p, q = _columns(x.values, names), _columns(y.values, names)
                keys_p, keys_q = (_matrix(z.values.field("keys")) for z in (x, y))
                bits_p, bits_q = (_matrix(z.values.field("sketch")).view(np.uint64) for z in (x, y))
                ok = p[1][:, None] != q[1][None, :]
                ok &= 100 * np.minimum(p[2][:, None], q[2]) >= percent * np.maximum(p[2][:, None], q[2])
                differ = np.zeros(ok.shape, np.int16)
                for k in range(SKETCH_LONGS):
                    differ += np.bitwise_count(bits_p[:, k][:, None] ^ bits_q[:, k])
                ok &= differ <= _limit(np.minimum(p[2][:, None], q[2]), percent, np.sqrt, np.minimum)
                if own:
                    ok &= p[0][:, None] < q[0]
                i, j = np.nonzero(ok)
                for k in range(int(np.argmax(keys_p[0] == key >> 32))):  # seen in an earlier key
                    new = keys_p[i, k] != keys_q[j, k]
                    i, j = i[new], j[new]
                if not len(i):
                    continue
                a, b, block_a, block_b = p[0][i], q[0][j], p[3][i], q[3][j]
                turn = block_a > block_b
                a[turn], b[turn], block_a[turn], block_b[turn] = b[turn], a[turn], block_b[turn], block_a[turn]
                order = np.lexsort((block_b, block_a))
                a, b, block_a, block_b = a[order], b[order], block_a[order], block_b[order]
                first = np.flatnonzero(np.concatenate([[True], (block_a[1:] != block_a[:-1]) | (block_b[1:] != block_b[:-1])]))
                edges = pa.array(np.append(first, len(a)), pa.int32())
                cols = [pa.array(block_a[first]), pa.array(block_b[first]), *(pa.ListArray.from_arrays(edges, pa.array(z)) for z in (a, b))]
                yield pa.RecordBatch.from_arrays(cols, names=["block_a", "block_b", "a", "b"])

    return run


def _verified(percent: int):
    """Links of the listed pairs, but for those whose classes earlier links of the batch have joined already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            above: dict[int, int] = {}

            def top(c: int, above=above) -> int:
                while (up := above.get(c, c)) != c:
                    above[c] = above.get(up, up)
                    c = up
                return c

            for x, y, *sides in zip(*(batch.column(i) for i in range(4)), strict=True):
                sets, of = {}, {}
                for side in sides:
                    raw, ids = side.values.field("set"), side.values.field("id").to_pylist()
                    sets |= {i: np.frombuffer(raw[k].as_buffer(), np.uint64) for k, i in enumerate(ids)}
                    of |= dict(zip(ids, side.values.field("class").to_pylist(), strict=True))
                found = []
                for i, j in zip(x.values.to_pylist(), y.values.to_pylist(), strict=True):
                    p, q = top(of[i]), top(of[j])
                    if p != q and _linked(sets[i], sets[j], percent):
                        above[max(p, q)] = min(p, q)
                        found.append((i, j))
                yield pa.RecordBatch.from_arrays([pa.array([pair[k] for pair in found], pa.int64()) for k in (0, 1)], names=["a", "b"])
        release()

    return run


def _linked(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    both = np.concatenate([p, q])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(p) + len(q) - shared)


def _class_of(rows: DataFrame, classes: DataFrame | None) -> DataFrame:
    if classes is None:
        return rows.withColumn("class", F.col("id"))
    known = classes.select("id", F.col("component").alias("class"))
    return rows.join(known, "id", "left").withColumn("class", F.coalesce("class", "id"))


def _apart(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b, ...) whose ends are in different classes."""
    a = classes.select(F.col("id").alias("a"), F.col("component").alias("class_a"))
    b = classes.select(F.col("id").alias("b"), F.col("component").alias("class_b"))
    out = pairs.join(a, "a", "left").join(b, "b", "left")
    return out.where(F.coalesce("class_a", "a") != F.coalesce("class_b", "b")).drop("class_a", "class_b")
