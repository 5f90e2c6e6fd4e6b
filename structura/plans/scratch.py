"""Tables that cut the lineage of iterative plans, in the folder that spark.checkpoint.dir names."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_left: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor see; one of our own only where the setting is missing, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = getattr(spark.sparkContext, "_structura_plans_dir", None) or tempfile.mkdtemp(prefix="structura-plans-")
        spark.sparkContext._structura_plans_dir = base
    return base.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Rounds:
    """Written tables of an iterative plan; keeps the last two, so that a round can read the one before it."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.kept, self.growing = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", [], {}
        _left.append((spark, self.root))

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{uuid.uuid4().hex[:10]}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def append(self, name: str, df: DataFrame) -> DataFrame:
        """Add what is new to a table that grows round by round, and give only that: earlier rows are never written again."""
        parts = self.growing.setdefault(name, [])
        df.write.parquet(path := f"{self.root}/{name}/part{len(parts)}")
        parts.append((path, df.schema))
        return self.spark.read.schema(df.schema).parquet(path)

    def has(self, name: str) -> bool:
        return name in self.growing

    def all(self, name: str) -> DataFrame:
        """All rows added to a table so far."""
        parts = self.growing[name]
        return self.spark.read.schema(parts[0][1]).parquet(*[path for path, _ in parts])

    def step(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{uuid.uuid4().hex[:10]}"
        df.write.parquet(path)
        self.kept.append(path)
        if len(self.kept) > 2:
            remove(self.spark, self.kept.pop(0))
        return self.spark.read.schema(df.schema).parquet(path)


@atexit.register
def _sweep() -> None:
    for spark, root in _left:
        try:
            if spark.sparkContext._jsc is not None:
                remove(spark, root)
        except Exception:  # noqa: BLE001  the session has ended
            pass
