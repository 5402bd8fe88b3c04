"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.tables import drop, scratch_path, written

__all__ = ["LOWER", "SPACE", "SPACE_RUN", "UPPER", "ascii_lower", "drop", "fresh", "handing_back", "least_hashes", "light_batches", "scratch_path", "shuffle_partitions", "words", "written"]

#: ASCII letters and the six ASCII white-space characters of the word rule [^\x20\x09-\x0D]+.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
SPACE = " \t\n\x0b\x0c\r"
SPACE_RUN = "[ \\t-\\r]+"


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words between ASCII white space of the lower-cased text; null and blank texts have none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE_RUN), "")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


@contextmanager
def light_batches(spark: SparkSession, rows: int = 500, size: int = 8 << 20) -> Iterator[None]:
    """Arrow batches of few rows and bytes for the jobs run inside: for rows that hold whole texts, of which some are very long."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(size)}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def handing_back(partition: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``partition``, after whose last batch the Python worker hands its free memory back to the system.

    Later stages reuse the workers: what one stage has freed but the allocators keep would stand beside what the next one and the executor need.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from partition(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library alone
            if trim:
                trim(0)

    return run


def fresh(name: str, columns: list[str]) -> str:
    """``name``, with as many underscores as no column shares it (in any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def least_hashes(hash_: Column, wanted: int, rows: int) -> Column:
    """A bound below which the ``wanted`` smallest of at least ``rows`` 64-bit hashes lie, with all but no doubt: eight times as many are expected there.

    Before an ordered limit it keeps what tasks hand on as small as the limit, however many tasks there are.
    """
    share = min(1.0, 8 * wanted / max(1, rows))
    return hash_ <= int(-(2**63) + share * (2**64 - 1025)) if share < 1 else F.lit(True)
