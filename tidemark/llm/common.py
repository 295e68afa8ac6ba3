"""What the operators of this subpackage share: table access, lineage cuts, batches of texts."""

from __future__ import annotations

import ctypes
import functools
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut, remove, remove_at_end, shared_dir
from ..functions.names import fresh

__all__ = ["chunks", "cut", "dealt", "fresh", "remove", "remove_at_end", "settle", "settled", "shared_dir", "table", "text_of"]

#: Bytes of text that one vectorised step takes at most; a longer text is a step of its own.
CHUNK_CHARS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, parts: int, column: str) -> DataFrame:
    """``df`` dealt into ``parts`` by a column and written so (see :func:`cut`): what groups by that column then reads it in
    place. Only a plan that is not adapted on its way tells how its rows lie."""
    spark = df.sparkSession
    before = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        return cut(df.repartition(parts, column))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


@functools.cache
def _trim() -> Callable[[int], int] | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None


def settle() -> None:
    """Give back to the system what Arrow's and C's allocators hold free: a Python worker outlives its task, and what it
    holds stands beside the next stage's memory."""
    pa.default_memory_pool().release_unused()
    if (trim := _trim()) is not None:
        trim(0)


def settled(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` over batches, whose memory goes back when it has ended."""

    @functools.wraps(run)
    def to_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        settle()

    return to_end


def text_of(column: str = "text"):
    """The text column, null read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def chunks(batches: Iterator[pa.RecordBatch], column: str, most: int = CHUNK_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches whose texts hold about ``most`` bytes together, with the texts (null read as empty).

    Only one slice's texts are Python strings at a time, and what is no longer needed goes back to the system.
    """
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
        start = held = 0
        for i, n in enumerate([*sizes, most + 1]):
            if i > start and (held + n > most or i == len(sizes)):
                yield batch.slice(start, i - start), [t or "" for t in texts.slice(start, i - start).to_pylist()]
                start, held = i, 0
            held += n
        del batch, texts
        settle()
