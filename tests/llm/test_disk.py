"""What repeated passages take of the disk goes when it is used up."""

import os
import random
import time

import numpy as np
from pyspark.sql import functions as F

from matchframe.llm import passages, store, text
from matchframe.session import shared_folder
from tests.llm.test_operators import prose


def shuffled(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


def tables(spark):
    return {name for name in os.listdir(shared_folder(spark).removeprefix("file:")) if name.startswith("table-")}


def test_stored_leaves_no_shuffle_files(spark):
    before, option = shuffled(spark), spark.conf.get(store.CLEANUP)
    got = store.stored(spark.range(20000).groupBy((F.col("id") % 700).alias("k")).agg(F.collect_list("id").alias("ids")))
    until = time.time() + 3
    while (left := shuffled(spark) - before) and time.time() < until:
        time.sleep(0.1)
    assert not left and got.count() == 700 and spark.conf.get(store.CLEANUP) == option


def test_dropped_tables_are_those_stored(spark, tmp_path):
    ours, path = store.stored(spark.range(5)), f"{tmp_path}/table-of-others"
    spark.range(5).write.parquet(path)
    before = tables(spark)
    store.dropped(ours, spark.read.parquet(path))
    assert len(before - tables(spark)) == 1 and spark.read.parquet(path).count() == 5


def test_passages_keep_few_tables(spark, documents):
    rng = random.Random(4)
    shared = [prose(rng, n) for n in (60, 90)]
    rows = [(i, f"{prose(rng, 20)} {shared[i % 2]} {prose(rng, 5)}\n{shared[i % 2]}") for i in range(12)] + [(12, None), (13, f"{prose(rng, 20)} {shared[0]}")]
    before = tables(spark)
    got = passages.repeats(documents(rows))
    kept = tables(spark) - before
    read = {file.split("/")[-2] for file in got.inputFiles()}
    # no words, sketches, keys, marks or places are left; what is, has a row for a passage or a link at most
    assert read <= kept and all("keys" not in c and "marks" not in c and "gram" not in c and "set" not in c for c in (spark.read.parquet(f"{shared_folder(spark)}/{name}").columns for name in kept))
    assert {r.unit for r in got.collect()} == {"line", "run"}


def test_least_and_rolled(spark):
    rng = np.random.default_rng(3)
    for n in (0, 1, 25, 26, 27, 300):
        value = rng.integers(0, 9, n).astype(np.uint64)
        for width in (1, 2, 3, 16, 26):
            want = [k + width - 1 - int(np.argmin(value[k : k + width][::-1])) for k in range(n - width + 1)]
            assert passages._least(value, width).tolist() == want
        words = rng.integers(0, 2, n).astype(np.uint64)
        for size in (1, 3, 25):
            hashes = text.rolled(text.mix(words), size)
            spans = [tuple(words[k : k + size].tolist()) for k in range(n - size + 1)]
            assert len(hashes) == len(spans) and len(set(hashes.tolist())) == len(set(spans)) == len(set(zip(hashes.tolist(), spans, strict=True)))
