"""A byte-level convolutional network that scores the quality of whole texts, in numpy.

A text is cut into overlapping chunks of WIDTH bytes, STRIDE apart, from its first byte to its
last. Each byte is one of 512 symbols: its value, and whether the four bytes that start there were
seen at one of the LAGS before (a byte-level sign of repetition). Learned filters score each chunk
from the symbols' learned embeddings; the largest score of each filter over all chunks, through a
small hidden layer, gives one probability.

A filter's sum over a chunk is a sum of table rows (offset and symbol), so scoring needs no
multiplications besides the last layers, and only the chunk that won a filter gets a gradient.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkqueue.llm import common

WIDTH, STRIDE = 16, 8
LAGS = range(2, 33)
SYMBOLS = 512
#: Bytes of a text that are scored at once; a longer one is taken in stretches that overlap as far as a symbol or a chunk reaches.
STRETCH = 1 << 19


def symbols(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A symbol for each byte of the rows that ``starts`` cuts; a lag never reaches into another row."""
    n = len(data)
    four = np.zeros(n, np.uint32)
    for j in range(4):
        four[: n - j] |= data[j:].astype(np.uint32) << np.uint32(8 * j)
    seen = np.zeros(n, bool)
    lengths = np.diff(starts)
    within = np.arange(n) - np.repeat(starts[:-1], lengths)
    left = np.repeat(lengths, lengths) - within
    for lag in LAGS:
        seen[lag:] |= (four[lag:] == four[:-lag]) & (within[lag:] >= lag)
    return data.astype(np.int32) + 256 * (seen & (left >= 4))


def chunks(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all chunks (chunk by offset; SYMBOLS past a row's end), and each row's first chunk."""
    lengths = np.diff(starts)
    many = np.maximum(1, -(-(lengths - WIDTH) // STRIDE) + 1)
    first = np.concatenate(([0], np.cumsum(many)))
    row = np.repeat(np.arange(len(lengths)), many)
    at = (np.arange(first[-1]) - first[row]) * STRIDE
    marks = np.concatenate((symbols(data, starts), [SYMBOLS])).astype(np.int32)
    out = np.empty((len(row), WIDTH), np.int32)
    for j in range(WIDTH):
        out[:, j] = marks[np.where(at + j < lengths[row], starts[row] + at + j, len(data))]
    return out, first


class ByteNet:
    """The network: embedding, filters, hidden layer, output. ``fit`` learns it, ``score`` applies it."""

    def __init__(self, filters: int = 24, size: int = 8, hidden: int = 12, seed: int = 1):
        r = np.random.default_rng(seed)
        self.p = {
            "embed": r.normal(0, 0.5, (SYMBOLS + 1, size)).astype(np.float32),
            "conv": r.normal(0, (WIDTH * size) ** -0.5, (WIDTH, size, filters)).astype(np.float32),
            "bias": np.zeros(filters, np.float32),
            "dense": r.normal(0, filters**-0.5, (filters, hidden)).astype(np.float32),
            "dense_bias": np.zeros(hidden, np.float32),
            "out": r.normal(0, hidden**-0.5, hidden).astype(np.float32),
            "out_bias": np.zeros(1, np.float32),
        }

    def tables(self) -> np.ndarray:
        return np.einsum("se,wef->wsf", self.p["embed"], self.p["conv"])

    def pooled(self, tables: np.ndarray, marks: np.ndarray, first: np.ndarray, where: bool = False):
        """The largest score of each filter per row, and with ``where`` the chunk that has it."""
        sums = tables[0][marks[:, 0]]
        for j in range(1, WIDTH):
            sums += tables[j][marks[:, j]]
        best = np.maximum.reduceat(sums, first[:-1], axis=0)
        if not where:
            return best
        return best, np.stack([a + np.argmax(sums[a:b], axis=0) for a, b in zip(first[:-1], first[1:], strict=True)])

    def head(self, best: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pool = np.tanh(best + self.p["bias"])
        hidden = np.tanh(pool @ self.p["dense"] + self.p["dense_bias"])
        return pool, hidden, 1 / (1 + np.exp(-np.clip(hidden @ self.p["out"] + self.p["out_bias"][0], -30, 30)))

    def pooled_long(self, tables: np.ndarray, data: np.ndarray) -> np.ndarray:
        """As :func:`pooled`, of one long text, stretch by stretch."""
        n, best = len(data), None
        many = max(1, -(-(n - WIDTH) // STRIDE) + 1)
        for c in range(0, many, STRETCH // STRIDE):
            d = min(many, c + STRETCH // STRIDE)
            a, b = c * STRIDE, min(n, (d - 1) * STRIDE + WIDTH)
            low, high = max(0, a - max(LAGS)), min(n, b + 4)
            marks = np.full((d - 1 - c) * STRIDE + WIDTH, SYMBOLS, np.int32)
            marks[: b - a] = symbols(data[low:high], np.array([0, high - low]))[a - low : b - low]
            own = self.pooled(tables, np.lib.stride_tricks.sliding_window_view(marks, WIDTH)[::STRIDE], np.array([0, d - c]))[0]
            best = own if best is None else np.maximum(best, own)
        return best

    def score(self, tables: np.ndarray, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        if len(starts) < 2:
            return np.zeros(0)
        if len(data) <= STRETCH:
            return self.head(self.pooled(tables, *chunks(data, starts)))[2]
        return self.head(np.stack([self.pooled_long(tables, data[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]))[2]

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = 14, batch: int = 24, rate: float = 0.004, decay: float = 1e-4, seed: int = 1) -> ByteNet:
        cut = [chunks(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0].astype(np.uint16) for t in texts]
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step = 0
        for epoch in range(epochs):
            for rows in np.array_split(r.permutation(len(cut)), max(1, len(cut) // batch)):
                step += 1
                marks = np.concatenate([cut[i] for i in rows]).astype(np.int32)
                first = np.concatenate(([0], np.cumsum([len(cut[i]) for i in rows])))
                g = self._gradient(marks, first, labels[rows].astype(np.float32))
                now = rate * (1 - epoch / epochs)
                for k, x in self.p.items():
                    d = g[k] + decay * x
                    m[k] += 0.1 * (d - m[k])
                    v[k] += 0.001 * (d * d - v[k])
                    x -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-7)
        return self

    def _gradient(self, marks: np.ndarray, first: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        best, where = self.pooled(self.tables(), marks, first, where=True)
        pool, hidden, p = self.head(best)
        d_out = ((p - labels) / len(labels)).astype(np.float32)
        d_hidden = np.outer(d_out, self.p["out"]) * (1 - hidden**2)
        d_best = (d_hidden @ self.p["dense"].T) * (1 - pool**2)
        won = marks[where]  # row, filter, offset
        embed = np.zeros_like(self.p["embed"])
        np.add.at(embed, won, np.einsum("rf,wef->rfwe", d_best, self.p["conv"], optimize=True))
        return {
            "embed": embed,
            "conv": np.einsum("rf,rfwe->wef", d_best, self.p["embed"][won], optimize=True),
            "bias": d_best.sum(0),
            "dense": pool.T @ d_hidden,
            "dense_bias": d_hidden.sum(0),
            "out": hidden.T @ d_out,
            "out_bias": np.array([d_out.sum()], np.float32),
        }


class Constant:
    """The score where nothing can be learned: the labels' mean, or one half without labels."""

    def __init__(self, value: float):
        self.value = value

    def tables(self) -> None:
        return None

    def score(self, tables: None, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return np.full(len(starts) - 1, self.value)


def fit_quality(docs: DataFrame, labels: DataFrame, train: Column, sample: int = 3000, longest: int = 1 << 17, most_bytes: int = 64 << 20) -> ByteNet | Constant:
    """Learn from ``sample`` labelled rows of ``most_bytes`` of text in all, the bound on what the driver holds.

    They are those with the smallest hashes of doc_id among labels that ``train`` (a condition on
    doc_id) admits; rows with a null label or a text of over ``longest`` bytes are not among them. Of
    several labels of one document the least counts.
    """
    known = labels.select("doc_id", "quality").where(train & F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    chosen = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = common.documents_only(docs, "doc_id", "text").where(F.octet_length(F.coalesce("text", F.lit(""))) <= longest).join(F.broadcast(chosen), "doc_id")
    order = F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")
    rows = rows.orderBy(*order).limit(sample)
    # A window over no more rows than the sample has.
    so_far = F.sum(F.octet_length(F.coalesce("text", F.lit("")))).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    found = rows.select("text", "quality", so_far.alias("so_far")).where(F.col("so_far") <= most_bytes).collect()
    known = np.array([min(1, max(0, r.quality)) for r in found], np.float32)
    if len(set(known.tolist())) < 2:
        return Constant(float(known.mean()) if len(known) else 0.5)
    return ByteNet().fit([(r.text or "").encode() for r in found], known)


def score_quality(docs: DataFrame, net: ByteNet | Constant, keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """The columns ``keep`` of each document with its score (a column ``name``, which no kept one has), from the whole text alone.

    A null text scores as an empty one: a single chunk of padding. Rows stay as many as they are.
    Kept columns that the documents lack are null; others are not read.
    """
    if name.lower() in (c.lower() for c in keep):
        raise ValueError(f"the documents have a column {name!r}")
    spark = docs.sparkSession
    common.bounded_batches(spark)
    shared = spark.sparkContext.broadcast((net, net.tables()))
    rows = common.documents_only(docs, *dict.fromkeys([*keep, "text"]))
    schema = T.StructType([*(rows.schema[c] for c in keep), T.StructField(name, T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, tables = shared.value
        for batch in batches:
            for piece in common.text_batches(batch, 1 << 19):
                found = own.score(tables, *common.text_bytes(piece.column("text")))
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in keep), pa.array(found.astype(np.float64))], names=[*keep, name])

    return rows.mapInArrow(score, schema)
