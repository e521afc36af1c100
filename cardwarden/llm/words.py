"""Words, lower case and row plumbing that the operators of this package share.

A word is a run of ``[^\\x20\\x09-\\x0D]``. Texts travel to Python as UTF-8 bytes: ``bytes.split()``
cuts at exactly those six separators and ``bytes.lower()`` changes A-Z only, both in C.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# A-Z become a-z, every other ASCII character that is no digit or letter becomes a blank.
_ALNUM = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)


def alnum_words(text: bytes) -> list[bytes]:
    """Words of letters, digits and non-ASCII characters, A-Z lower-cased."""
    return text.translate(_ALNUM).split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slim(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just the id and the text as bytes, so no other column can clash or travel."""
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("binary").alias("text"))


def free_name(name: str, df: DataFrame) -> str:
    """``name``, with as many underscores before it as keep it apart from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def record_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    arrays = [pa.array(list(c), f.type) for c, f in zip(columns, schema)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def give_back() -> None:
    """Return freed memory to the system. A Python worker lives on between tasks, and what a task
    freed would else stay with it, beside all other workers of the executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, giving its task's memory back when it ends."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def map_texts(
    df: DataFrame,
    make: Callable[[], Callable[[bytes], tuple]],
    fields: str,
    keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """One row per row of ``df``: the columns ``keep``, then what ``make()(text)`` returns.

    ``make`` runs once a task, so models and compressors are built once. A null text counts as
    empty. Nothing but the current Arrow batch is held.
    """
    kept = [df.schema[c] for c in keep]
    out = T.StructType([*kept, *T.StructType.fromDDL(fields).fields])
    arrow = to_arrow_schema(out)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = make()
        for batch in batches:
            rows = [judge(t or b"") for t in batch.column(len(keep)).to_pylist()]
            made = record_batch(rows, pa.schema(list(arrow)[len(keep) :]))
            columns = [batch.column(i).cast(arrow.field(i).type) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, *made.columns], schema=arrow)

    return df.select(*keep, "text").mapInArrow(run, out)
