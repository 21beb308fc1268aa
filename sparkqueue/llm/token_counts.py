"""Token counts of documents under a sentencepiece vocabulary, without any shuffle of pre-tokens.

Two tiers answer for a pre-token's length: a compact hash table of the corpus's frequent pre-tokens
(two sorted arrays, ten bytes an entry), broadcast once, and a bounded cache that a Python worker
keeps from task to task, for which what the table lacks is encoded. The table is built from counts
over all documents: each task keeps a bounded counter and hands on only its most frequent entries,
so what is shuffled is bounded by tasks, not by text. The table and the caches decide the speed
alone; the counts are the same without them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkqueue.llm import common, units

U64 = np.uint64
#: The mark that sentencepiece writes for a space.
SPACE_MARK = "▁"
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def cut(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the texts as the model sees them (a space before each), and their pre-tokens; see :func:`units.cut`."""
    texts = pc.replace_substring(pc.fill_null(texts, ""), SPACE_MARK, " ")
    texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(" ", texts, ""))
    data, starts = common.text_bytes(texts)
    return data, *units.cut(data, starts, units.piece_cuts(data))


class UnitLengths:
    """Lengths of pre-tokens: a table that is given, and a cache of at most ``most`` others that are encoded when met."""

    def __init__(self, model_file: str, most: int = 1_000_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.cache = units.Known(np.zeros(0, U64), np.zeros(0, np.int64), most)
        self.splits = self._splits()

    def _splits(self) -> bool:
        """Whether no piece reaches over a space or a line end, and white space is kept as it is."""
        pieces = (self.model.id_to_piece(i) for i in range(self.model.vocab_size()))
        whole = all(SPACE_MARK not in p.lstrip(SPACE_MARK) and "\n" not in p for p in pieces)
        marks = self.model.encode(" a  b \n c", out_type=str)
        return whole and "".join(marks).replace("<0x0A>", "\n") == f" {' a  b '}\n c".replace(" ", SPACE_MARK)

    def lengths(self, units: list[str]) -> list[int]:
        # A line end before a unit keeps the model's own leading space away from it.
        return [len(x) - 2 for x in self.model.encode(["\n" + u for u in units], num_threads=1)] if units else []

    def counts(self, texts: pa.Array, table: units.Known | None = None) -> np.ndarray:
        """Tokens of each text."""
        if not self.splits:
            return np.array([len(self.model.encode(t, num_threads=1)) if t else 0 for t in texts.to_pylist()], np.int64)
        data, first, row = cut(texts)
        total = np.zeros(len(first) + 1, np.int64)
        for at, a, b in units.groups(first, len(data)):
            hashes, where, place = units.distinct(data, a, b)
            there, found = self.cache.find(hashes)
            found = found.copy()
            if table is not None:
                known, lengths = table.find(hashes)
                found[known], there = lengths[known], there | known
            lacking = np.flatnonzero(~there)
            raw = data.tobytes() if len(lacking) else b""
            found[lacking] = self.lengths([raw[x:y].decode() for x, y in zip(a[where[lacking]].tolist(), b[where[lacking]].tolist(), strict=True)])
            self.cache.add(hashes[lacking], found[lacking])
            total[at + 1 : at + 1 + len(a)] = found[place]
        total = np.cumsum(total)
        return total[row[1:]] - total[row[:-1]]


@lru_cache(maxsize=2)
def worker_lengths(model_file: str) -> UnitLengths:
    """One model and one cache for all tasks of a Python worker."""
    return UnitLengths(model_file)


def frequent_units(docs: DataFrame, table_size: int = 1 << 16, per_task: int = 1 << 12, counter_size: int = 200_000) -> list[str]:
    """The most frequent pre-tokens of all documents, ``table_size`` at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            data, first, _ = cut(batch.column(0))
            for _, a, b in units.groups(first, len(data)):
                _, where, place = units.distinct(data, a, b)
                times = np.bincount(place, minlength=len(where))
                # One that is alone among half a million is not frequent.
                few = np.flatnonzero((b[where] - a[where] <= 64) & (times > 1))
                raw = data.tobytes()
                seen.update({raw[x:y]: n for x, y, n in zip(a[where[few]].tolist(), b[where[few]].tolist(), times[few].tolist(), strict=True)})
                if len(seen) > counter_size:
                    seen = Counter(dict(seen.most_common(counter_size // 2)))
        top = seen.most_common(per_task)
        yield pa.RecordBatch.from_pydict({"unit": pa.array([u.decode() for u, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64())})

    counted = docs.select("text").mapInArrow(count, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))
    return [r.unit for r in counted.orderBy(F.desc("n"), "unit").limit(table_size).collect()]


def table_of(names: list[str], known: UnitLengths) -> units.Known:
    """The compact table of some pre-tokens' lengths."""
    data, starts = common.text_bytes(pa.array(names, pa.string()))
    return units.Known(common.byte_hashes(data, starts[:-1], starts[1:]), np.array(known.lengths(names), np.uint16), len(names))


def token_counts(docs: DataFrame, model_file: str, limit: int = 4096, table_size: int = 1 << 16) -> DataFrame:
    """Tokens of each whole text: ``doc_id, n_bytes, n_tokens, over_limit``.

    A null text counts as empty: no bytes, no tokens. Rows stay as many as they are, repeated
    doc_ids included; a null doc_id stays null; further columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    common.bounded_batches(spark)
    rows = common.documents_only(docs, "doc_id", "text")
    shared = spark.sparkContext.broadcast(table_of(frequent_units(rows, table_size), UnitLengths(model_file)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, table = worker_lengths(model_file), shared.value
        for batch in batches:
            texts = batch.column("text")
            tokens = own.counts(texts, table)
            n_bytes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n_bytes, pa.array(tokens), pa.array(tokens > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(count, SCHEMA)
