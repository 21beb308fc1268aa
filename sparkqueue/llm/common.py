"""What the corpus operators share: tables, the shared folder, and byte-level word hashing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkqueue.sources.folders import shared_folder

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    A lost executor loses no part of it, and both sides of a later join on it are plain scans,
    so adaptive execution can split a skewed key. Zstandard, whose buffers lie in the heap: those of the
    default codec lie outside and pile up until the next collection.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def drop_written(*tables: DataFrame) -> None:
    """Delete tables made by :func:`written` that no later plan reads. Any other table is left alone."""
    for df in tables:
        if folder := getattr(df, "_written_to", None):
            drop_folder(df.sparkSession, folder)


def drop_folder(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def documents_only(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns of ``docs``; a name it lacks comes as null, other columns go."""
    kinds = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}
    return docs.select(*(docs[c] if c in docs.columns else F.lit(None).cast(kinds[c]).alias(c) for c in columns))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of ``df`` has it (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def text_batches(batch: pa.RecordBatch, most_bytes: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a piece has at most so many bytes of ``text``, or one row."""
    ends = np.cumsum(np.asarray(pc.binary_length(batch.column("text")).fill_null(0), dtype=np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most_bytes, "right")))
        yield batch.slice(at, to - at)
        at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column, and where each row starts (one more entry at the end)."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    buffers = column.buffers()
    starts = np.frombuffer(buffers[1], dtype=wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8)[starts[0] : starts[-1]] if buffers[2] is not None and starts[-1] > starts[0] else np.zeros(0, np.uint8)
    return data, starts - starts[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers (murmur3's constants)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(33))
        x = x * U64(0xFF51AFD7ED558CCD)
        x = x ^ (x >> U64(33))
        x = x * U64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> U64(33))


#: Multiplier of the rolling word hash, and its inverse modulo 2**64.
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_BYTE = mix64(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))

#: The six characters that separate words: space and 0x09 to 0x0D.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True

#: A-Z to a-z; every other byte stays.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@lru_cache(maxsize=4)
def _powers(p: int, n: int) -> np.ndarray:
    out = np.ones(n, U64)
    with np.errstate(over="ignore"):
        out[1:] = U64(p)
        return np.cumprod(out, dtype=U64)


def powers(p: int, n: int) -> np.ndarray:
    return _powers(p, 1 << max(16, int(n).bit_length()))[:n]


def word_bounds(inside: np.ndarray, starts: np.ndarray, alone: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First character and end of each word of all rows, and per row the index of its first word (one more at the end).

    Words are runs of characters that are ``inside``; one that is also ``alone`` is a word by
    itself. A word never crosses a row, as rows are cut at ``starts``.
    """
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(starts), np.int64)
    new_row = np.zeros(n + 1, bool)
    new_row[starts[:-1][starts[:-1] < n]] = True
    cut = new_row[1:n] if alone is None else new_row[1:n] | alone[1:] | alone[:-1]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | cut
    first = np.flatnonzero(begins)
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | cut
    return first, np.flatnonzero(stops) + 1, np.searchsorted(first, starts)


#: Steps after which the rest of a long word is hashed on its own.
ROUNDS = 8


def _chained(first: np.ndarray, end: np.ndarray, width: int, key: int, step, rest) -> np.ndarray:
    """Hashes of some stretches, ``width`` units a step: ``step`` gives the units at each place, ``rest`` hashes what is left."""
    size = end - first
    with np.errstate(over="ignore"):
        out = mix64(size.astype(U64) * U64(0x9FB21C651E98DF25) + U64(key & (1 << 64) - 1))
        some = np.arange(len(first))
        for j in range(ROUNDS):
            some = some[size[some] > j * width]
            if not len(some):
                break
            out[some] = mix64((out[some] ^ step(first[some] + j * width, size[some] - j * width)) * U64(0xD6E8FEB86659FD93) + U64(j))
        for i in some[size[some] > ROUNDS * width]:
            out[i] ^= U64(rest(int(first[i]) + ROUNDS * width, int(end[i]), int(out[i])))
    return out


def byte_hashes(data: np.ndarray, first: np.ndarray, end: np.ndarray, key: int = 0) -> np.ndarray:
    """64-bit hashes of some stretches of bytes, under a key.

    Eight bytes at a time go through a mix that is not linear, and all beyond 64 bytes through
    xxhash, so no pair of words collides by construction, as under a polynomial modulo 2**64.
    """
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))

    def step(place: np.ndarray, left: np.ndarray) -> np.ndarray:
        return eight[place] & (U64((1 << 64) - 1) >> (U64(64) - U64(8) * np.minimum(left, 8).astype(U64)))

    return _chained(first, end, 8, key, step, lambda a, b, seed: xxhash.xxh3_64_intdigest(data[a:b].tobytes(), seed))


def word_hashes(data: np.ndarray, starts: np.ndarray, separator: np.ndarray = SEPARATOR, key: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of every row: hashes of their bytes under a key, first bytes, ends, and per row the index of its first word (one more at the end)."""
    first, end, at = word_bounds(~separator[data], starts)
    return byte_hashes(data, first, end, key), first, end, at


def token_hashes(values: np.ndarray, inside: np.ndarray, starts: np.ndarray, alone: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`word_hashes`, of words whose characters have the 64-bit ``values``; see :func:`word_bounds`."""
    first, end, at = word_bounds(inside, starts, alone)
    return _chained(first, end, 1, 0, lambda place, left: values[place], lambda a, b, seed: xxhash.xxh3_64_intdigest(values[a:b].tobytes(), seed)), first, end, at


def shingle_hashes(words: np.ndarray, word_starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each run of ``size`` words of a row; a shorter row with words is one shingle.

    Returns the hashes row by row and, per row, where its hashes start (one more at the end).
    """
    counts = np.diff(word_starts)
    many = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    at = np.concatenate(([0], np.cumsum(many)))
    total = int(at[-1])
    if total == 0:
        return np.zeros(0, U64), at
    row = np.repeat(np.arange(len(counts)), many)
    pos = np.arange(total) - at[row] + word_starts[row]
    length = np.minimum(counts, size)[row]
    out = np.full(total, 0x2545F4914F6CDD1D, U64)
    padded = np.concatenate((words, np.zeros(size, U64)))
    with np.errstate(over="ignore"):
        for j in range(size):
            out = np.where(j < length, mix64(out * U64(0x9FB21C651E98DF25) + padded[pos + j] + U64(j)), out)
    return out, at


def bounded_batches(spark: SparkSession, rows: int = 1024, most_bytes: int = 8 << 20) -> None:
    """Hand Python at most ``rows`` rows and some ``most_bytes`` at once (or one row), so that long texts don't fill a worker.

    The session's own settings stay where they are tighter. They are lowered for good, as plans read
    them when they run.
    """
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", most_bytes)):
        key = f"spark.sql.execution.arrow.{name}"
        now = int(spark.conf.get(key).rstrip("b"))
        if now <= 0 or now > most:
            spark.conf.set(key, most)


def partitions_for(df: DataFrame, bytes_each: int = 64 << 20) -> int:
    """Partitions that follow the plan's size estimate; the session's shuffle setting at least.

    A plan over no files has no estimate (Spark says 2**63 - 1 bytes, or a product with that).
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return least if size >= 1 << 60 else max(least, -(-size // bytes_each))
