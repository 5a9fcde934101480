"""A stored table with one row for each key, changed by upserts that readers see as a whole or not at all.

Rows lie in Parquet folders, one for each bucket of keys. An upsert rewrites only the buckets that its keys fall in, in a new folder, and then
publishes a version: a small file that names the folder of every bucket. A reader takes the newest version and reads what it names, so it
sees the table before or after an upsert. Of two upserts that start from one version, the one that publishes second starts again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def last_rows(df: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """One row for each key: the last by order; equal or no orders leave the greatest row."""
    row = F.struct(*df.columns)
    rank = F.struct(F.col(order).alias("o"), row.alias("r")) if order else row
    return df.groupBy(F.col(key).alias("__key")).agg(F.max_by(row, rank).alias("__row")).select("__row.*")


class KeyedTable:
    """path: a folder that driver and executors share. buckets: how many parts a table has; an upsert rewrites whole parts."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = spark.createDataFrame([], schema).schema
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        where = self._path(self.path)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = where.getFileSystem(conf)
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)

    def version(self) -> tuple[int, dict[str, str]]:
        """The newest version's number, 0 if there is none, and the folder of each bucket that has rows."""
        folder = self._path(f"{self.path}/_versions")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        last = max((n for n in names if n.endswith(".json") and n[0] != "."), default=None)
        if last is None:
            return 0, {}
        text = self.spark.read.text(f"{self.path}/_versions/{last}", wholetext=True).first()[0]
        return int(last.split(".")[0]), json.loads(text)

    def _rows(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._rows(sorted(self.version()[1].values()))

    def _publish(self, number: int, folders: dict[str, str]) -> bool:
        """Whether the version was free."""
        draft, final = self._path(f"{self.path}/_versions/.{uuid.uuid4().hex}"), self._path(f"{self.path}/_versions/{number:012d}.json")
        out = self._fs.create(draft, False)
        out.write(json.dumps(folders).encode())
        out.close()
        gateway = self.spark.sparkContext._gateway
        plain = gateway.new_array(getattr(gateway.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            self._files.rename(draft, final, plain)  # fails if the version is there
            return True
        except Exception as e:
            if "FileAlreadyExists" not in str(e):
                raise
            self._fs.delete(draft, False)
            return False

    def upsert(self, fresh: DataFrame, order: str | None = None, tries: int = 5) -> int:
        """Puts rows in place of those of the same keys; returns the version. Repeated keys leave their last row; no rows change nothing."""
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        new = last_rows(fresh, self.key, order).select(*self.schema.names)
        for _ in range(tries):
            number, folders = self.version()
            hit = sorted(r[0] for r in new.select(bucket).distinct().collect())  # a number for each bucket at most
            if not hit:
                return number
            old = self._rows([folders[str(b)] for b in hit if str(b) in folders])
            rows = old.join(new.select(F.col(self.key).alias("__key")), F.col(self.key).eqNullSafe(F.col("__key")), "left_anti").unionByName(new)
            place = f"data/{number + 1:012d}-{uuid.uuid4().hex}"
            rows.withColumn("__bucket", bucket).repartition("__bucket").write.partitionBy("__bucket").parquet(f"{self.path}/{place}")
            if self._publish(number + 1, {**folders, **{str(b): f"{place}/__bucket={b}" for b in hit}}):
                return number + 1
            self._fs.delete(self._path(f"{self.path}/{place}"), True)
        raise RuntimeError(f"{tries} other upserts came first")

    def vacuum(self, keep: int = 1) -> None:
        """Drops versions but the newest few, and the folders that these don't name. Only when nobody reads older versions or writes."""
        number, _ = self.version()
        used = set()
        for status in self._fs.listStatus(self._path(f"{self.path}/_versions")):
            name = status.getPath().getName()
            if name.startswith(".") or int(name.split(".")[0]) <= number - keep:
                self._fs.delete(status.getPath(), False)
            else:
                used |= {f.split("/")[1] for f in json.loads(self.spark.read.text(status.getPath().toString(), wholetext=True).first()[0]).values()}
        for status in self._fs.listStatus(self._path(f"{self.path}/data")):
            if status.getPath().getName() not in used:
                self._fs.delete(status.getPath(), True)
