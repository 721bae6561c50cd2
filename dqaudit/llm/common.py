"""Session and table helpers of this subpackage."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .exchange import MOST_BUCKETS

#: Ids up to this many go to every executor as a broadcast (8 MB); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: An estimate of so many bytes is none.
UNLIKELY = 1 << 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of the driver's rows, sent as Arrow: createDataFrame(rows) would start Python workers of another kind on the executors, which stay
    beside those of the Arrow functions."""
    to = to_arrow_schema(StructType.fromDDL(schema))
    cols = list(zip(*rows, strict=True)) or [()] * len(to)
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(cols, to, strict=True)], schema=to))


def ready(spark: SparkSession) -> None:
    """Makes checkpoint() usable: the session's folder, or a temporary one where none is set and the master is local."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        to = spark.conf.get("spark.checkpoint.dir", None)
        if to is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            to = tempfile.mkdtemp(prefix="checkpoint")
        sc.setCheckpointDir(to)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage in the shared folder; survives the loss of executors."""
    ready(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more (after a checkpoint, and del of the DataFrames before it);
    else they stay until the driver happens to collect its garbage."""
    for pause in (0.5, 0.5, 0.5, 0):  # Python lets go of its proxies first, and the listeners of the last query need a moment
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(pause)


def input_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the plan's size; where there is none (or a product of sizes beyond UNLIKELY), the bytes of its strings,
    which are summed in a scan of them."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size < UNLIKELY:
        return size
    strings = [F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c, kind in df.dtypes if kind == "string"]
    return df.agg(F.sum(sum(strings, F.lit(8)))).first()[0] or 0


def buckets(df: DataFrame, each: int) -> int:
    """Buckets of about ``each`` bytes for a table, MOST_BUCKETS at most; results don't depend on the number."""
    return max(1, min(MOST_BUCKETS, -(-input_bytes(df) // each)))


def drop_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of docs whose id isn't in ids; null ids stay.  ids is cut by a checkpoint and counted: up to
    BROADCAST_IDS are broadcast, so that the texts aren't shuffled; beyond, both sides are shuffled by id."""
    gone = checkpoint(ids.select(F.col(ids.columns[0]).alias("__gone")).where("__gone IS NOT NULL").distinct())
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, docs[key] == gone["__gone"], "left_anti")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A path of that name in the shared checkpoint folder."""
    ready(spark)
    # Spark's own folder of checkpoints has a new name for each context; what outlives a run lies beside it
    return f"{str(spark.conf.get('spark.checkpoint.dir', None) or spark.sparkContext.getCheckpointDir()).rstrip('/')}/{name}"


def new_folder(spark: SparkSession, name: str) -> str:
    """A path that isn't taken, within the shared checkpoint folder."""
    return shared_folder(spark, f"{name}-{uuid.uuid4().hex}")


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of an intermediate table."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
