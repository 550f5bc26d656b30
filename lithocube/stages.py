"""Stored stages of a run: each is a table under a key of what it depends on, and is made once."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Raised when a stage comes to mean something else, so that tables stored before aren't taken for it.
VERSION = 1


def fingerprint(df: DataFrame) -> str:
    """A digest of a table's columns and rows, whatever their order: counts and two sums of row hashes, aggregated where the rows are."""
    names = sorted(df.columns)
    row = F.xxhash64(*names)
    found = df.agg(F.count(F.lit(1)), F.sum(row.cast("decimal(38,0)")), F.sum(F.xxhash64(F.lit(1), row).cast("decimal(38,0)"))).first()
    return hashlib.sha256(json.dumps([sorted(df.dtypes), [str(x) for x in found]]).encode()).hexdigest()


class Stages:
    """A folder of stages. `stage` gives a stored table if a whole one is there: Spark writes its mark of success last, so a torn one has none
    and is made again. `made` names what was made here, in order."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.made = spark, folder.rstrip("/"), []

    def _whole(self, path: str) -> bool:
        mark = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return mark.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(mark)

    def stage(self, name: str, settings: dict, inputs: list[str], make: Callable[[], DataFrame]) -> tuple[DataFrame, str]:
        """(table, key): the key is a digest of name, settings and the inputs' keys or fingerprints."""
        key = hashlib.sha256(json.dumps([VERSION, name, settings, inputs], sort_keys=True, default=str).encode()).hexdigest()[:24]
        path = f"{self.folder}/{name}-{key}"
        if not self._whole(path):
            make().write.mode("overwrite").parquet(path)
            self.made.append(name)
        return self.spark.read.parquet(path), key
