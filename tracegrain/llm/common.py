"""What the corpus operators share: durable intermediate tables, Arrow batches, hashing and the train/held-out fold.

Nulls: a null text counts as the empty text, a null id stays null. Operators select the columns they need by
name first, so further columns, whatever they are called, never clash.
"""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import shared_dir, staged, unstaged  # noqa: F401

#: Rows of text that a kernel gets, and that Spark sends to Python, at once; they bound memory, not what is read.
ARROW_ROWS, BATCH_ROWS = 1000, 2000
#: Bytes of text that a kernel works on at once.
CHUNK_BYTES = 1 << 20


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with null texts as empty ones."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def map_texts(df: DataFrame, kernel, schema: str, make=None, keep=None) -> DataFrame:
    """``kernel`` over Arrow batches of at most ARROW_ROWS rows; ``make()`` gives what it needs, once a task. ``keep`` is the
    key of what the task takes from its worker, see ``resident``.

    ``kernel(batch, made)`` returns one pyarrow RecordBatch or an iterable of them.
    """
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        release(keep)
        made = make() if make else None
        for whole in batches:
            for at in range(0, whole.num_rows, ARROW_ROWS):
                out = kernel(whole.slice(at, ARROW_ROWS), made)
                for part in [out] if isinstance(out, dict) else out:
                    yield pa.RecordBatch.from_arrays([pa.array(part[f.name], type=f.type) for f in arrow], schema=arrow)

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def small_batches(spark: SparkSession) -> None:
    """Texts can be long: have Spark send fewer rows at once than its default, unless the session asks for fewer still."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "0")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


_resident: dict = {}


def resident(key, make):
    """What a worker process keeps for its later tasks, one thing at a time; see ``release``."""
    if key not in _resident:
        release()
        _resident[key] = make()
    return _resident[key]


def release(keep=None) -> None:
    """Forget what earlier tasks left in this worker, but for ``keep``, and give the memory back."""
    if any(key != keep for key in _resident):
        _resident.clear()
        trim()


def trim() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library frees by itself
        pass


def byte_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    return batch.column(name).cast(pa.binary()).to_pylist()


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that learning never sees: crc32 of the id as text, mod 3, is 1. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place where it can be."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


class Memo(dict):
    """A dict that fills itself by ``make``. At half of ``limit`` entries it becomes the older generation, from which
    entries that are asked for again come back; so memory is bounded and frequent keys stay."""

    def __init__(self, make, limit: int = 400_000):
        super().__init__()
        self.make, self.limit, self.old = make, limit // 2, {}

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value
