"""A store of stage tables with a commit record for each.

A stage is a Parquet table below the store's folder. Its record is written last, so a
table whose writer died has none and is refused. The record holds the table's schema and what
it was made from; a stage is used again only for the same inputs.
"""

from __future__ import annotations

import json
import posixpath
import time
import uuid
from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_RECORD = "_records"


class UnfinishedStage(FileNotFoundError):
    """The stage has no commit record: it was never written, or not to its end."""


class StageStore:
    """Stage tables below ``root``, a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _records(self, name: str) -> str:
        return posixpath.join(self.root, _RECORD, name)

    def record(self, name: str) -> dict | None:
        """The stage's commit record, or None."""
        try:
            lines = self.spark.read.text(self._records(name)).collect()  # one line
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return None
            raise
        return json.loads(lines[0][0]) if lines else None

    def write(self, name: str, df: DataFrame, inputs: Mapping[str, object] | None = None) -> DataFrame:
        """Write ``df`` as the stage and go on from the written copy.

        Every write has a folder of its own: readers of an earlier version keep theirs, and
        the record moves to the new one once it is complete.
        """
        path = posixpath.join(self.root, name, uuid.uuid4().hex)
        df.write.parquet(path)
        record = {"stage": name, "path": path, "schema": df.schema.jsonValue(), "inputs": _plain(inputs),
                  "finished": time.time()}
        line = self.spark.createDataFrame([(json.dumps(record),)], "value string")
        line.coalesce(1).write.mode("overwrite").text(self._records(name))
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        record = self.record(name)
        if record is None:
            raise UnfinishedStage(f"stage {name} in {self.root}: no commit record, run the earlier stage first")
        return self.spark.read.schema(StructType.fromJson(record["schema"])).parquet(record["path"])

    def once(self, name: str, build: Callable[[], DataFrame], inputs: Mapping[str, object] | None = None) -> DataFrame:
        """The stage as it is if its record names the same inputs, else built and written."""
        record = self.record(name)
        if record is not None and record["inputs"] == _plain(inputs):
            return self.read(name)
        return self.write(name, build(), inputs)

    def names(self) -> list[str]:
        """The finished stages."""
        folder = self._path(posixpath.join(self.root, _RECORD))
        files = self._files(folder)
        return sorted(f.getPath().getName() for f in files.listStatus(folder)) if files.exists(folder) else []

    def remove(self) -> None:
        """Delete the store's folder with all stages. The end of a run calls this."""
        folder = self._path(self.root)
        self._files(folder).delete(folder, True)

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _files(self, path):
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def __enter__(self) -> StageStore:
        return self

    def __exit__(self, *_) -> None:
        self.remove()


def _plain(inputs: Mapping[str, object] | None) -> dict[str, str]:
    """Inputs as text: parameters, file lists, versions of earlier stages."""
    return {str(k): repr(v) for k, v in sorted((inputs or {}).items())}
