"""Teams that depend on each other, as connected components of the pairs that met."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchframe.session import written


def components(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(key, team, component): the smallest team of the same key that each team is connected with.

    Labels move along all pairs at once: a team takes the smallest label next to it, and what a label's holders have found
    goes to all of its holders, so long chains shorten by more than half a round. Every round is a written table; the
    rounds end when no label has moved. Pairs with a missing team connect nothing.
    """
    met = pairs.select(F.col(key).alias("key"), F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    both = F.explode(F.array(F.struct(F.col("a").alias("team"), F.col("b").alias("other")), F.struct(F.col("b").alias("team"), F.col("a").alias("other"))))
    sides = written(met.distinct().select("key", both.alias("s")).select("key", "s.*"))
    labels = written(sides.groupBy("key", "team").agg(F.min("other").alias("m")).select("key", "team", F.least("team", "m").alias("component"), F.lit(True).alias("moved")))
    # a key with one label is one component
    apart = labels.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    if apart.isEmpty():
        return labels.select("key", "team", "component")
    while True:
        near = sides.join(labels.select("key", F.col("team").alias("other"), "component"), ["key", "other"])
        near = near.groupBy("key", "team").agg(F.min("component").alias("near"))
        step = labels.join(near, ["key", "team"]).select("key", "team", "component", F.least("component", "near").alias("found"))
        told = step.groupBy("key", "component").agg(F.min("found").alias("told"))
        after = F.least("found", "told")
        labels = written(step.join(told, ["key", "component"]).select("key", "team", after.alias("component"), (after != F.col("component")).alias("moved")))
        if labels.where("moved").isEmpty():
            return labels.select("key", "team", "component")
