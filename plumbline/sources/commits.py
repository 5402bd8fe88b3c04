"""Tables that grow by whole batches: what a manifest names is there, everything else is not.

A batch is written to a folder of its own; then a numbered manifest is created, which names the folder. Readers follow the manifests, so that a half-written or abandoned
folder is never read. A manifest's number can be created once: a writer that finds it taken looks at what others have committed since, and tries the next. The
file system must create files exclusively (HDFS does; of object stores, those with conditional writes).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.functions.tables import scratch_path
from plumbline.operators.sampling import resume


class Batches:
    """The committed batches below a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.fs = self.hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def manifests(self) -> dict[int, dict]:
        """The manifests by number."""
        folder = self.hadoop.Path(f"{self.path}/manifests")
        if not self.fs.exists(folder):
            return {}
        numbers = sorted(int(s.getPath().getName().removesuffix(".json")) for s in self.fs.listStatus(folder) if s.getPath().getName().endswith(".json"))
        lines = self.spark.read.text(f"{self.path}/manifests/*.json", wholetext=True) if numbers else None
        found = [json.loads(r["value"]) for r in lines.collect()] if lines is not None else []  # a line a batch
        return {m["number"]: m for m in sorted(found, key=lambda m: m["number"])}

    def read(self, schema, since: int = -1) -> DataFrame:
        """The rows of all committed batches after number ``since``."""
        folders = [m["folder"] for n, m in self.manifests().items() if n > since and m["folder"]]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def has(self, name: str) -> bool:
        return any(m["name"] == name for m in self.manifests().values())

    def write(self, rows: DataFrame) -> str:
        """Writes rows to a new folder, which no reader sees yet, and returns its name."""
        folder = f"batches/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        return folder

    def publish(self, number: int, folder: str, name: str) -> bool:
        """Creates a manifest; false if the number is taken."""
        try:
            out = self.fs.create(self.hadoop.Path(f"{self.path}/manifests/{number:020d}.json"), False)
        except Exception as error:
            if "FileAlreadyExists" in str(error) or "already exists" in str(error):
                return False
            raise
        out.write(bytearray(json.dumps({"number": number, "folder": folder, "name": name}).encode()))
        out.close()
        return True

    def append(self, rows: DataFrame, name: str) -> bool:
        """Commits a batch once: false, and nothing written, where one of this name is committed already."""
        if self.has(name):
            return False
        folder = self.write(rows)
        while True:
            done = self.manifests()
            if any(m["name"] == name for m in done.values()):
                return False
            if self.publish(max(done, default=-1) + 1, folder, name):
                return True


def resume_batches(batches: Batches, planned: DataFrame, score: Callable[[DataFrame], DataFrame], schema, key: str = "key") -> int:
    """Scores the planned rows whose key no committed batch has, and commits them; returns how many were scored.

    Where other writers commit meanwhile, the rows whose keys they brought are left out before the next try: each key is committed once, however many run.
    """
    seen = max(batches.manifests(), default=-1)
    todo, _ = resume(planned, batches.read(schema), key)
    own = scratch_path(batches.spark, "scored")
    score(todo).dropDuplicates([key]).write.parquet(own)
    rows = batches.spark.read.schema(schema).parquet(own)
    while True:
        folder = batches.write(rows)
        if batches.publish(seen + 1, folder, folder):
            return batches.spark.read.schema(schema).parquet(f"{batches.path}/{folder}").count()
        seen = max(batches.manifests())  # before the keys are read: what comes later is met by the next try
        rows = batches.spark.read.schema(schema).parquet(own).join(batches.read(schema).select(key), key, "left_anti")
