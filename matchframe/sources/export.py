"""Export of result tables as JSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchframe.sources.tables import nan_to_null


def export_payload(sections: dict[str, DataFrame], generated_at: str | None = None, model: str | None = None) -> DataFrame:
    """All sections of a result document as JSON records (section, record); NaN is null.

    One record per line instead of one nested document: no row holds a whole table, so a section may be of any size.
    """

    def records(name: str, df: DataFrame) -> DataFrame:
        body = F.to_json(F.struct(*nan_to_null(df).columns), {"ignoreNullFields": "false"})
        return nan_to_null(df).select(F.lit(name).alias("section"), body.alias("record"))

    parts = [records(name, df) for name, df in sections.items()]
    if generated_at is not None or model is not None:
        spark = next(iter(sections.values())).sparkSession
        head = spark.range(1).select(F.lit(generated_at).alias("generated_at"), F.lit(model).alias("model"))
        parts.insert(0, records("header", head))
    return reduce(DataFrame.unionByName, parts)


def write_payload(payload: DataFrame, path: str) -> None:
    """One folder per section, one JSON record per line."""
    payload.write.mode("overwrite").partitionBy("section").text(path)
