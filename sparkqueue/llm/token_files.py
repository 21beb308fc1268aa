"""Token ids as flat unsigned integer files with 64-bit document offsets.

One set of files per range of doc_ids, in ascending doc_id order:

* ``part-N-A.tokens``: the ids of its documents one after the other, little-endian unsigned, 16
  bits where the vocabulary fits and 32 else;
* ``part-N-A.offsets``: signed 64-bit, where each document starts in that file, and its end;
* ``part-N-A.docs``: signed 64-bit doc_ids; ``part-N-A.nulls``: one byte each, 1 where it is null.

N is the partition and A the task attempt. Only the files that the manifest lists count, so a lost
or repeated task leaves at most files that nobody reads. The base of a partition (ids in all
earlier ones) is the prefix sum of the manifest's sizes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkqueue.llm import common, files, units

MANIFEST = "part int, prefix string, docs long, tokens long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


class UnitIds:
    """Ids of pre-tokens: a cache of at most ``most``, which are encoded when first met."""

    def __init__(self, tokenizer_file: str, dtype: str, most: int = 1_000_000):
        import os

        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer, self.dtype = Tokenizer.from_file(tokenizer_file), np.dtype(dtype)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Where the ids of a pre-token lie in the pool.
        self.known = units.Known(np.zeros(0, np.uint64), np.zeros(0, np.int64), most)
        self.size, self.pool = np.zeros(0, np.int64), np.zeros(0, self.dtype)
        self.start = np.zeros(0, np.int64)
        self.splits = self._splits()

    def _splits(self) -> bool:
        """Whether this tokenizer cuts as is expected here: GPT-2's byte-level pattern, no prefix space or normaliser."""
        import json

        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        return pre.get("type") == "ByteLevel" and pre.get("use_regex", False) and not pre.get("add_prefix_space") and not spec.get("normalizer")

    def ids(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, as the tokenizer gives them for each whole text, and
        how many each has; with ``end_id``, each text ends with it."""
        texts = pc.fill_null(texts, "")
        # A text that holds an added token's string, which no cut may part, goes to the tokenizer whole.
        whole = np.full(len(texts), not self.splits)
        for t in self.added:
            whole |= pc.match_substring(texts, t).to_numpy(zero_copy_only=False)
        cut = pc.if_else(pa.array(whole), "", texts) if whole.any() else texts
        data, starts = common.text_bytes(cut)
        first, row = units.cut(data, starts, units.byte_level_cuts(data))
        parts, sizes = [], np.zeros(len(first), np.int64)
        for at, a, b in units.groups(first, len(data)):
            own, many = self._units(data, a, b)
            parts.append(own)
            sizes[at : at + len(a)] = many
        ids = np.concatenate(parts) if parts else np.zeros(0, self.dtype)
        bounds = np.concatenate(([0], np.cumsum(sizes)))[row]
        if end_id is None and not whole.any():
            return ids, np.diff(bounds)
        end = np.asarray([] if end_id is None else [end_id], self.dtype)
        if not whole.any():
            return np.insert(ids, bounds[1:], end[0]), np.diff(bounds) + 1
        rows = [np.concatenate((self.ids(texts[i].as_py()) if whole[i] else ids[bounds[i] : bounds[i + 1]], end)) for i in range(len(texts))]
        return np.concatenate(rows), np.array([len(r) for r in rows])

    def _units(self, data: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some pre-tokens one after the other, and how many each has."""
        hashes, where, place = units.distinct(data, first, end)
        there, at = self.known.find(hashes)
        lacking = np.flatnonzero(~there)
        raw = data.tobytes() if len(lacking) else b""
        texts = [raw[a:b].decode() for a, b in zip(first[where[lacking]].tolist(), end[where[lacking]].tolist(), strict=True)]
        new = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        size, start = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        size[there], start[there] = self.size[at[there]], self.start[at[there]]
        size[lacking] = [len(x) for x in new]
        start[lacking] = len(self.pool) + np.cumsum(size[lacking]) - size[lacking]
        pool = np.concatenate((self.pool, np.fromiter(chain.from_iterable(new), self.dtype, int(size[lacking].sum())))) if new else self.pool
        if room := min(len(new), self.known.most - len(self.known.hashes)):
            kept = lacking[:room]
            self.known.add(hashes[kept], len(self.size) + np.arange(room))
            self.size, self.start = np.concatenate((self.size, size[kept])), np.concatenate((self.start, start[kept]))
            self.pool = pool[: start[kept[-1]] + size[kept[-1]]]
        many = size[place]
        ends = np.cumsum(many)
        return pool[np.arange(int(ends[-1])) + np.repeat(start[place] - ends + many, many)] if len(ends) else pool[:0], many


@lru_cache(maxsize=2)
def worker_units(tokenizer_file: str, dtype: str) -> UnitIds:
    """One cache for all tasks of a Python worker; what it holds changes no result."""
    return UnitIds(tokenizer_file, dtype)


def id_type(tokenizer_file: str, end_id: int) -> str:
    from tokenizers import Tokenizer

    most = max(Tokenizer.from_file(tokenizer_file).get_vocab_size(with_added_tokens=True) - 1, end_id)
    return "<u2" if most < 1 << 16 else "<u4"


def write_token_files(docs: DataFrame, folder: str, tokenizer_file: str, end_id: int = 2, partitions: int | None = None) -> DataFrame:
    """Encode every whole text, end it with ``end_id`` and write the files; returns the manifest.

    A null text is empty: its document holds the end id alone. Null doc_ids come first. Rows with
    equal doc_ids are all written, in the order of their texts' hashes and then the texts. An
    empty table gives an empty manifest.
    """
    common.bounded_batches(docs.sparkSession)
    dtype = id_type(tokenizer_file, end_id)
    rows = common.documents_only(docs, "doc_id", "text").withColumn("tie", F.xxhash64("text"))
    n = partitions or common.partitions_for(docs)
    dealt = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        prefix = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
        own, lengths, ids, nulls = None, [], [], []
        out, stream = None, None
        try:
            for batch in batches:
                if batch.num_rows and stream is None:
                    own = worker_units(tokenizer_file, dtype)
                    out = files.writing(f"{folder}/{prefix}.tokens")
                    stream = out.__enter__()
                if not batch.num_rows:
                    continue
                found, many = own.encode(batch.column("text"), end_id)
                stream.write(found.tobytes())
                lengths.append(many)
                column = batch.column("doc_id")
                ids.append(pc.fill_null(column, 0).to_numpy(zero_copy_only=False).astype("<i8"))
                nulls.append(pc.is_null(column).to_numpy(zero_copy_only=False).astype("u1"))
        finally:
            if out is not None:
                out.__exit__(None, None, None)
        if not lengths:
            return
        lengths = np.concatenate(lengths)
        offsets = np.concatenate(([0], np.cumsum(lengths))).astype("<i8")
        for name, array in (("offsets", offsets), ("docs", np.concatenate(ids)), ("nulls", np.concatenate(nulls))):
            with files.writing(f"{folder}/{prefix}.{name}") as f:
                f.write(array.tobytes())
        yield pa.RecordBatch.from_pydict({"part": pa.array([task.partitionId()], pa.int32()), "prefix": [prefix], "docs": pa.array([len(lengths)], pa.int64()), "tokens": pa.array([int(offsets[-1])], pa.int64())})

    return common.written(dealt.drop("tie").mapInArrow(write, MANIFEST), "token-manifest")


def read_token_files(spark: SparkSession, manifest: DataFrame, folder: str, dtype: str) -> DataFrame:
    """One row per document, from the files: ``doc_id, start, n_tokens, ids_crc32``.

    ``start`` counts the ids of all documents before it; the checksum is over its ids as
    little-endian unsigned 32-bit integers. The manifest has a row per file and is all that the
    driver holds.
    """
    parts = sorted((r.part, r.prefix, r.tokens) for r in manifest.collect())
    bases = np.concatenate(([0], np.cumsum([t for *_, t in parts]))).tolist()
    listed = spark.createDataFrame([(p, prefix, int(b)) for (p, prefix, _), b in zip(parts, bases, strict=False)], "part int, prefix string, base long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at = f"{folder}/{row['prefix']}"
                ids, offsets = files.mapped(f"{at}.tokens", dtype), files.mapped(f"{at}.offsets", "<i8")
                docs, nulls = files.mapped(f"{at}.docs", "<i8"), files.mapped(f"{at}.nulls", "u1")
                crcs = [zlib.crc32(np.asarray(ids[a:b], "<u4").tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.asarray(docs), mask=np.asarray(nulls) == 1), pa.array(offsets[:-1] + row["base"]), pa.array(np.diff(offsets)), pa.array(crcs, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return listed.repartition(max(1, len(parts)), "part").mapInArrow(read, READ)


def token_files(docs: DataFrame, tokenizer_file: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Write the files under the shared folder (or ``folder``) and read every document back."""
    spark = docs.sparkSession
    folder = folder or common.fresh_path(spark, "token-files")
    manifest = write_token_files(docs, folder, tokenizer_file, end_id)
    return read_token_files(spark, manifest, folder, id_type(tokenizer_file, end_id))
