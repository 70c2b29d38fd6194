"""Tables handed on between the steps of an operator."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame

from matchframe.session import shared_folder

#: Whether a query's shuffle files go when it ends; otherwise they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: a lost executor costs no recompute, and plans stay short.

    Unlike a checkpoint it keeps nothing of the plan it came from, so loops do not pile up constraints. Nothing reads the
    shuffle files of the write again, so Spark (4.1 and later) is told to remove them at its end.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Remove tables that ``stored`` has returned and that nothing reads any more; files of others stay."""
    for table in tables:
        context = table.sparkSession.sparkContext
        ours = f"{shared_folder(table.sparkSession).rstrip('/').rpartition('/')[2]}/table-"
        for folder in {file.rpartition("/")[0] for file in table.inputFiles()}:
            if "/".join(folder.split("/")[-2:]).startswith(ours):
                path = context._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
