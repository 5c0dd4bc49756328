"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Lists that tables of materialise() are entered in.
RECORDING: list[list[DataFrame]] = []


@contextmanager
def recorded(tables: list[DataFrame]) -> Iterator[None]:
    """Enter the tables that are made meanwhile in a list."""
    RECORDING.append(tables)
    try:
        yield
    finally:
        RECORDING.remove(tables)


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset (tests), a new local one."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset, and a cluster has no other folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="framefold-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/framefold-{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder: cuts the lineage and outlives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.framefold_path = path
    for tables in RECORDING:
        tables.append(out)
    return out


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialise() that no later plan reads."""
    for df in tables:
        at = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.framefold_path)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard_all_but(tables: list[DataFrame], docs: DataFrame) -> None:
    """Delete the tables, those that docs reads excepted, and forget them."""
    read = {unquote(x).split("://")[-1].split(":")[-1].lstrip("/") for x in docs.inputFiles()}
    kept = [t for t in tables if any(x.startswith(t.framefold_path.split("://")[-1].split(":")[-1].lstrip("/") + "/") for x in read)]
    discard(*[t for t in tables if not any(t is k for k in kept)])
    tables[:] = kept


def let_go(spark: SparkSession) -> None:
    """Have the driver drop the shuffle files of plans that have ended, which else stay until it happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(columns: list[str], name: str) -> str:
    """name, with as many underscores in front as set it apart from columns (whose case does not count)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def row_hash(docs: DataFrame) -> Column:
    """Two hashes of all columns, 128 bits in all: equal rows share them."""
    columns = [F.to_json(F.struct(c)) if "map<" in t or "variant" in t else F.col(c) for c, t in docs.dtypes]
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit("b"), *columns).alias("b"))
