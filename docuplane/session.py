"""Session settings and the storage that iterative plans share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Settings the plans rely on; all of them are runtime settings, so they also hold on a given session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "docuplane", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with RUNTIME_CONF; master and shuffle partitions only where given."""
    b = SparkSession.builder.appName(app).config("spark.ui.enabled", "false")
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.config(map=RUNTIME_CONF).getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply RUNTIME_CONF to a session made elsewhere."""
    for k, v in RUNTIME_CONF.items():
        spark.conf.set(k, v)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _local_dir() -> str:
    return "file://" + os.path.join(tempfile.gettempdir(), "docuplane-shared")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session. Where that is unset, a local folder for a local master
    (tests); RuntimeError for any other master, whose executors wouldn't see it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = _local_dir()
    return root.rstrip("/")


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Have a path of the shared folder removed when the driver ends: plans made of it may run until then."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(p if "." not in p.getName() else p.getParent())
    fs.deleteOnExit(p)


class Scratch:
    """Written tables in the shared folder that cut the lineage of iterative plans and outlive lost executors. They are removed when
    the driver ends, those that no returned plan reads by drop()."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}", 0
        remove_at_exit(spark, self.root)

    def write(self, df: DataFrame) -> str:
        """Write the rows, return the path."""
        self.n += 1
        path = f"{self.root}/{self.n:04d}"
        df.write.parquet(path)
        return path

    def cut(self, df: DataFrame) -> DataFrame:
        """The same rows, read back from a written table."""
        return self.spark.read.schema(df.schema).parquet(self.write(df))

    def read(self, *paths: str, schema=None) -> DataFrame:
        r = self.spark.read.schema(schema) if schema is not None else self.spark.read
        return r.parquet(*paths)

    def drop(self, path: str) -> None:
        """Remove one written table."""
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df over as many partitions as shuffles have, by the keys' hash: few bytes may be much work for what follows."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def small_enough(df: DataFrame, max_rows: int) -> bool:
    """Whether df has at most max_rows rows; reads no more than max_rows + 1 of them."""
    return df.limit(max_rows + 1).count() <= max_rows


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """df marked for a broadcast if its size is proven to be within max_rows, else df as it is (a shuffled join)."""
    return F.broadcast(df) if small_enough(df, max_rows) else df
