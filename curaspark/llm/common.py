"""Shared helpers: scratch tables in the folder all executors share, and word splitting."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII blanks.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: The same rule as a Java regular expression that matches the blanks between words.
BLANKS = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where none is set and all runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="curaspark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Spark's setting that shuffle files go when the query that made them has ended.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Named Parquet tables under the shared folder; they cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/curaspark/{name}-{uuid.uuid4().hex}"
        self.names: set[str] = set()

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path, before = f"{self.root}/{name}", self.spark.conf.get(FREE_SHUFFLES, None)
        self.spark.conf.set(FREE_SHUFFLES, "true")  # nothing reads them again
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
            self.names.add(name)
        finally:
            self.spark.conf.set(FREE_SHUFFLES, before) if before is not None else self.spark.conf.unset(FREE_SHUFFLES)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(conf).delete(path, True)
        self.names.discard(name)

    def keep(self, *names: str) -> None:
        """Drops all other tables."""
        for name in sorted(self.names - set(names)):
            self.drop(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(column: str = "text") -> Column:
    """The text, empty where null."""
    return F.coalesce(F.col(column), F.lit(""))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


#: Tables of so many narrow rows at most may be broadcast; beyond it the same join shuffles.
BROADCAST_ROWS = 500_000


def join_counted(left: DataFrame, right: DataFrame, on: str | list[str], how: str, right_rows: int, most: int | None = None) -> DataFrame:
    """A join whose right side, of narrow rows that were counted, is broadcast only when it has few of them."""
    return left.join(F.broadcast(right) if right_rows <= (BROADCAST_ROWS if most is None else most) else right, on, how)


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt out over all shuffle partitions: for small rows that each make much work, which Spark would gather in few tasks."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
