"""What the corpus operators share: shared storage, worker imports, tables."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that numpy kernels hold at a time, beyond which a batch is cut between documents.
CHUNK_BYTES = 1 << 20

#: Words of a text: maximal runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of an Arrow batch at most: batches of documents, each held several times over on its way, stay at a few MB.
BATCH_ROWS = 1000

_resident: dict = {}


def resident(key=None, make=None):
    """A large object that a worker keeps between tasks, one at a time: asking for another, or for none, lets go of it and of memory freed before."""
    if key not in _resident:
        _resident.clear()
        trim()
        if make is not None:
            _resident[key] = make()
    return _resident.get(key)


def trim() -> None:
    """Gives freed memory back to the system, as processes of other sizes stand beside this one."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def prepare(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it, and bounds the session's Arrow batches."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [root, env.get("PYTHONPATH", "")]))
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. On a local session without one (tests), a temporary folder becomes it; on a cluster without one, an error, as executors could not read each other's tables."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="impulsia-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """The rows of df as a table in the shared folder: lineage ends there, so a lost executor costs a reread only. by: a column by which the table is bucketed (an external table of the session's catalog), so that joins on it don't shuffle its rows."""
    spark = df.sparkSession
    mark = uuid.uuid4().hex
    path = f"{shared_dir(spark)}/impulsia/{name}-{mark}"
    if by is None:
        df.write.option("compression", "zstd").parquet(path)
        made = spark.read.schema(df.schema).parquet(path)
    else:
        # As many buckets as a shuffle has partitions: rows that come from a shuffle by the column make one file a bucket.
        n = min(int(spark.conf.get("spark.sql.shuffle.partitions")), int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
        table_name = f"impulsia_{name}_{mark}"
        df.write.option("compression", "zstd").option("path", path).bucketBy(n, by).format("parquet").saveAsTable(table_name)
        made = spark.table(table_name)
        made._impulsia_table = table_name
    made._impulsia_path = path
    return made


def discard(*tables: DataFrame) -> None:
    """Removes tables of written() that nothing will read again."""
    for df in tables:
        spark, path = df.sparkSession, df._impulsia_path
        if getattr(df, "_impulsia_table", None):
            spark.sql(f"DROP TABLE IF EXISTS {df._impulsia_table}")
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(hadoop, True)


#: Keys that a join may broadcast because they are hot: a key is hot beyond its share of one in so many rows, so there are no more.
HOT_KEYS = 50_000
#: Keys of no more rows than this are never hot.
LEAST_HOT = 10_000


def hot_from(rows: int) -> int:
    """The number of rows beyond which a key of so many rows in all is hot."""
    return max(LEAST_HOT, rows // HOT_KEYS)


def place():
    """A number of each row, the same whenever a task is repeated, of a table that stored() has seen."""
    return F.monotonically_increasing_id()


def stored(df: DataFrame) -> DataFrame:
    """df if its rows come straight from files or the driver, so that they have the same places whenever they are read; else a table of them."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    nodes = {re.sub(r"^[\s:+\-]*", "", line).split(" ")[0].split("[")[0] for line in lines}
    return df if nodes <= {"Project", "Filter", "Relation", "LocalRelation"} else written(df, "stored")


def spread_join(left: DataFrame, right: DataFrame, key: str, times: str, hot: int, spread) -> DataFrame:
    """left with the columns of right (a row a key, a long), null where it has none. right's column times, which goes, says how many rows of left have the key: those of more than hot meet their right row by broadcast and are spread by a hash of spread over all tasks of the shuffled join."""
    rest = [c for c in right.columns if c not in (key, times)]
    found = F.struct(*rest)
    few = right.where(F.col(times) > hot).select(F.col(key).alias("_hot"), found.alias("_few"))
    many = right.where(F.col(times) <= hot).select(F.col(key).alias("_key"), found.alias("_many"))
    marked = left.join(F.broadcast(few), F.col(key) == F.col("_hot"), "left")
    # What a spread row meets by chance has no say.
    met = F.when(F.col("_few").isNotNull(), F.xxhash64(key, spread)).otherwise(F.col(key))
    both = marked.withColumn("_spread", met).join(many, F.col("_spread") == F.col("_key"), "left")
    value = F.coalesce("_few", "_many")
    return both.select(*left.columns, *(value[c].alias(c) for c in rest))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(df: DataFrame, bytes_each: int = 16 << 20) -> int:
    """How many hash partitions suit df: the session's number, or more where the input is large."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size if size < 1 << 60 else 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-known // bytes_each))


def learns(mod: int, out: int = 1, doc_id: str = "doc_id"):
    """True for rows that a model may learn from: the crc32 of the id as text leaves another remainder than out. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % mod != out
