"""Retention: media of expired jobs is deleted in two phases, rows are kept; owners may erase everything."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame

from plumbline.functions.tables import written
from plumbline.operators.jobs import mark_deleted, select_expired
from plumbline.params import PARAMS


def sweep(jobs: DataFrame, now: Column, delete: Callable[[str], bool], limit: int | None = PARAMS.sweep_limit) -> DataFrame:
    """Jobs after one sweep. ``delete`` removes the object of a key and tells whether it did; only then the job is marked, so a failed
    deletion is tried again by the next sweep. What was deleted is written before it is used, so that the result may be read any number of times.
    ``delete`` must tell true of a key that is gone, as lost tasks run again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [i for i, key in zip(batch.column("id").to_pylist(), batch.column("storage_key").to_pylist(), strict=True) if delete(key)]
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.int64())], ["id"])

    deleted = select_expired(jobs, now, limit).select("id", "storage_key").mapInArrow(run, "id long")
    deleted = written(deleted, "deleted")
    return mark_deleted(jobs, deleted, now)
