"""Document fingerprints by content-defined chunking.

A gear hash of the last 16 bytes decides where a text is cut: where its top bits are zero. Cutting
is normalised: below the normal size a rarer pattern of bits is needed, above it a commoner one, so
sizes gather around the normal one. An insertion moves only the cuts near it. The fingerprint is
the set of the chunks' digests, each with its chunk's length; the containment of one document in
another is the share of its bytes whose chunks the other has too.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkqueue.llm import common

LEAST, NORMAL, MOST = 16, 32, 128
WINDOW = 16
#: Cut where these bits of the 16-bit hash are zero: 1 place in 128 below the normal size, else 1 in 16.
RARE, COMMON = np.uint16(0xFE00), np.uint16(0xF000)
GEAR = (common.mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) >> np.uint64(48)).astype(np.uint16)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte, the hash of the 16 bytes that end there: the sum of GEAR[byte] << age."""
    h = GEAR[data]
    reach = 1
    with np.errstate(over="ignore"):
        while reach < WINDOW:
            h[reach:] = h[reach:] + (h[:-reach] << np.uint16(reach))
            reach *= 2
    return h


def cuts(data: np.ndarray) -> list[int]:
    """Ends of the chunks of one text. No chunk but the last is shorter than LEAST, so a window that decides lies within the text."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    h = gear_hashes(data)
    often = np.flatnonzero((h & COMMON) == 0) + 1
    rare = often[(h[often - 1] & RARE) == 0].tolist()
    often = often.tolist()
    out, at = [], 0
    while at < n:
        end = min(n, at + MOST)
        k = bisect_left(rare, at + LEAST)
        if k < len(rare) and rare[k] < at + NORMAL:
            end = min(end, rare[k])
        else:
            k = bisect_left(often, at + NORMAL)
            if k < len(often):
                end = min(end, often[k])
        out.append(end)
        at = end
    return out


def fingerprint(text: bytes) -> dict[str, int]:
    """Chunk digest -> chunk length, of one text."""
    at, out = 0, {}
    for end in cuts(np.frombuffer(text, np.uint8)):
        out[xxhash.xxh64_hexdigest(text[at:end])[:10]] = end - at
        at = end
    return out


def as_text(found: dict[str, int]) -> str:
    """Ten hexadecimal digits and the length, chunk by chunk in the digests' order."""
    return ",".join(f"{digest}{length:x}" for digest, length in sorted(found.items()))


def containment(a: dict[str, int], b: dict[str, int]) -> float:
    """The share of ``a``'s weight that ``b`` has too; of two empty ones 1, of one empty one 0."""
    if not a or not b:
        return float(not a and not b)
    return sum(n for digest, n in a.items() if digest in b) / sum(a.values())


#: Partitions, at most, and sampled places for each; a partition is sorted and streamed, so its size bounds no memory.
MOST_PARTS, SAMPLED = 20_000, 30


def bounds_of(sample: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds ``place, within`` that cut rows like the ``sample`` of places into even parts.

    A doc_id (or the lack of one) that takes several parts is cut by hash.
    """
    if parts < 2 or not len(sample):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.sort(sample)[np.arange(1, parts) * len(sample) // parts]
    place, times = np.unique(cut, return_counts=True)
    within = [(k << 64) // (n + 1) - (1 << 63) if n > 1 else -(1 << 63) for n in times.tolist() for k in (range(1, n + 1) if n > 1 else (0,))]
    return np.repeat(place, times), np.array(within, np.int64)


def part_of(bounds: tuple[np.ndarray, np.ndarray], place: np.ndarray, within: np.ndarray) -> np.ndarray:
    """The number of bounds at or below each place."""
    low, high = np.searchsorted(bounds[0], place), np.searchsorted(bounds[0], place, "right")
    for i in np.flatnonzero(high > low):
        high[i] = low[i] + np.searchsorted(bounds[1][low[i] : high[i]], within[i], "right")
    return high.astype(np.int32)


def in_next_order(docs: DataFrame) -> DataFrame:
    """Documents in descending doc_id order, cut into partitions that each end with the row that follows.

    Bounds come from a sample of doc_ids. A partition's last document needs the first of the next
    lower partition (and the lowest document the highest of all): those heads, one a partition,
    are dealt to both, ``ahead`` marking the copy. So nothing but the range is sorted, and no task
    sees more than its range. Null doc_ids come after all others; rows of equal doc_id in the order of
    their texts' hashes, then texts, and many of them are cut by hash as well. Only equal rows can't
    be told apart and lie together.
    """
    spark = docs.sparkSession
    least = -(1 << 63)
    rows = common.documents_only(docs, "doc_id", "text").withColumns({"place": F.coalesce("doc_id", F.lit(least)), "within": F.bitwise_not(F.xxhash64("text"))})
    many = rows.count()
    parts = max(1, min(common.partitions_for(docs), MOST_PARTS, many))
    share = min(1.0, SAMPLED * parts * 1.5 / max(1, many))
    sample = np.array([r.place for r in rows.select("place").sample(fraction=share, seed=1).collect()], np.int64)
    shared = spark.sparkContext.broadcast(bounds_of(sample, parts))

    @F.pandas_udf("int")
    def part(place: pd.Series, within: pd.Series) -> pd.Series:
        return pd.Series(part_of(shared.value, place.to_numpy(), within.to_numpy()))

    heads = rows.select("place", "within", part("place", "within").alias("part")).groupBy("part").agg(F.max(F.struct("place", "within")).alias("head")).collect()
    heads = sorted((r.part, r.head.place, r.head.within) for r in heads)
    # The copy of a head goes to the next higher partition, and the highest head to the lowest one.
    copies = spark.sparkContext.broadcast({(place, within): heads[(i + 1) % len(heads)][0] for i, (_, place, within) in enumerate(heads)})

    @F.pandas_udf("int")
    def copy(place: pd.Series, within: pd.Series) -> pd.Series:
        return pd.Series([copies.value.get(x) for x in zip(place.tolist(), within.tolist(), strict=True)], dtype="Int32")

    dealt = rows.withColumns({"part": part("place", "within"), "copy": copy("place", "within")})
    own = F.struct("part", F.lit(False).alias("ahead"))
    to = F.when(F.col("copy").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("copy").alias("part"), F.lit(True).alias("ahead"))))
    dealt = dealt.select("doc_id", "text", "place", "within", F.explode(to).alias("to")).select("doc_id", "text", "place", "within", "to.part", "to.ahead")
    order = ["part", "ahead", F.col("place").desc(), F.col("doc_id").desc_nulls_last(), F.col("within").desc(), "text"]
    return dealt.repartitionById(max(1, len(bounds_of(sample, parts)[0]) + 1), F.col("part")).sortWithinPartitions(*order).select("doc_id", "text", "part", "ahead")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """The fingerprint of each whole text, and of the text edited with its next document's start.

    The next document is the one that follows in descending doc_id order; after the last comes the
    first, and a lone document follows itself. The last third of the code points (rounded down) is
    replaced by as many from the next document's start, or all that it has. A null text is empty;
    an empty text has the empty fingerprint. Rows stay as many as they are.
    """
    common.bounded_batches(docs.sparkSession)
    dealt = in_next_order(docs)

    def row(doc, now: str, own: dict[str, int], then: str, other: dict[str, int]) -> tuple:
        m = len(now) // 3
        edited = (now[: len(now) - m] + then[:m]).encode()
        found = fingerprint(edited)
        return (doc, len(now), hashlib.sha256(edited).hexdigest(), as_text(own), as_text(found), containment(own, found), containment(own, other))

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        held = part = None
        for batch in batches:
            out = []
            for doc, text, at, ahead in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "part", "ahead")), strict=True):
                text = text or ""
                own = fingerprint(text.encode())
                if part != at:
                    held = None
                if held is not None:
                    out.append(row(*held, text, own))
                held, part = (None if ahead else (doc, text, own)), at
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * len(kinds), kinds, strict=True)], names=names)

    return dealt.mapInArrow(pair, SCHEMA)
