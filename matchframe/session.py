"""Session defaults, durable hand-overs and size checks shared by the operators."""

from __future__ import annotations

import os
import tempfile
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Below this many input bytes an ordered window keeps whole keys in one task.
WINDOW_BYTES = ("spark.matchframe.windowBytes", 1 << 30)
#: Most rows one task should see of a single key (and the size of a range chunk).
ROWS_PER_TASK = ("spark.matchframe.rowsPerTask", 20_000_000)


def local_session(cpus: int | str = "*", name: str = "matchframe", memory: str = "8g") -> SparkSession:
    """Session for tests and the bench; on a cluster the submitter's own session is used."""
    cores = os.cpu_count() if cpus == "*" else int(cpus)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def setting(spark: SparkSession, option: tuple[str, int]) -> int:
    name, default = option
    return int(spark.conf.get(name, str(default)))


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder all executors share; a folder of this machine only where Spark runs on it alone."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="matchframe-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so that lost executors cost no recompute."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, read back: computed once, and nothing of its plan is kept."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def input_bytes(df: DataFrame) -> int:
    """Bytes the plan's sources hold after pruning, as Catalyst estimates them (no job)."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def hottest_key(df: DataFrame, keys: list[str]) -> tuple[int, int]:
    """(rows, rows of the fullest key), one map-side combined aggregate."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    row = counts.agg(F.sum("n"), F.max("n")).first()
    return (row[0] or 0, row[1] or 0)


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Driver-side rows (a fixed list, a model's parameters) as a local relation of known size.

    Catalyst sees how large it is and broadcasts it only while it is below its own threshold.
    """
    struct = StructType.fromDDL(schema)
    fields = to_arrow_schema(struct)
    columns = [pa.array([row[i] for row in rows], type=f.type) for i, f in enumerate(fields)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=fields), schema=struct)
