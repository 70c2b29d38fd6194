"""Operators that keep their input's columns, with all their working names as extra columns."""

import pytest
from pyspark.sql import functions as F

from matchframe.llm import mixing, near_dedup

ROWS = [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, None), (3, "h i j k l m"), (3, "h i j k l m"), (4, ""), (None, "x y z")]
MIXING = ["row", "rank", "slices", "slice", "before", "ahead", "within", "s", "m", "n", "docs", "weight", "most", "place", "part"]
DEDUP = ["d1", "_d1", "__D1", "wordless", "_wordless", "_id", "id", "d", "_d", "head", "class", "size", "component"]


def plain(rows, columns):
    return sorted((tuple(r[c] for c in columns) for r in rows), key=str)


@pytest.mark.parametrize("name", MIXING)
def test_mixing_keeps_a_column_of_any_name(documents, name):
    docs = documents(ROWS)
    columns = [c for c in docs.columns if c != "size"]
    extra = docs.withColumn(name, F.lit("kept"))
    got = mixing.mix(extra).collect()
    assert {r[name] for r in got} == {"kept"} and plain(got, [*columns, "copies"]) == plain(mixing.mix(docs).collect(), [*columns, "copies"])


def test_mixing_and_near_duplicates_keep_all_names_at_once(documents):
    docs = documents(ROWS).drop("size")
    extra = docs.withColumns({c: F.lit(c) for c in {*MIXING, *DEDUP} - {"size", "__D1"}})
    got = mixing.emit(extra).collect()
    assert len(got) == mixing.emit(docs).count() and all(r[c] == c for r in got for c in MIXING)
    for frame in (docs.withColumns({c: F.lit(c) for c in DEDUP if c != "size" and c != "__D1"}), docs.withColumns({c: F.lit(c) for c in ("__D1", "_ID", "WORDLESS")})):
        kept = near_dedup.unique(frame)
        assert kept.columns == frame.columns
        assert plain(kept.collect(), docs.columns) == plain(near_dedup.unique(docs).collect(), docs.columns)
