"""Language identification with bit-sliced Bloom filters of byte n-grams.

Each slot of the filter holds one bit per language. An n-gram sets the bit of its language in each
of its slots; the AND of those slots gives all languages that contain it. For a text, the bits are
counted per language over all its n-grams, and the count that chance alone would give (from how
full the language's slice is) is taken off. The largest corrected count decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkqueue.llm import common

#: Bytes of an n-gram; four fit an unsigned 32-bit integer.
GRAM = 4
GAP = b" " * GRAM
MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
LETTER = re.compile(r"[^\W\d_]")


#: Bytes of n-grams that are looked up at once.
STRETCH = 1 << 20


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of all texts, lower case, and where each text's n-grams start (one more at the end).

    A gap is before and after each text, so its n-grams are the same whatever stands beside it.
    """
    rows = [GAP + t.lower().encode("utf-8", "replace") + GAP for t in texts]
    return _grams(np.frombuffer(b"".join([*rows, GAP]), np.uint8))[: sum(map(len, rows))], np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int64)


def _grams(data: np.ndarray) -> np.ndarray:
    """The n-gram that starts at each byte but the last ones."""
    found = np.zeros(max(0, len(data) - GRAM + 1), np.uint32)
    for j in range(GRAM):
        found |= data[j : j + len(found)].astype(np.uint32) << np.uint32(8 * j)
    return found


class LanguageFilters:
    """The filters of some languages; each language gets at most ``most`` n-grams."""

    def __init__(self, names: list[str], sets: list[np.ndarray], bits: int = 20):
        self.names, self.bits, self.words = names, bits, -(-len(names) // 64) or 1
        kind = next(k for k, n in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 1 << 30)) if len(names) <= n)
        self.slots = np.zeros((self.words, 1 << bits), kind)
        for at, found in enumerate(sets):
            word, bit = divmod(at, 64)
            for slot in self._slots(found):
                self.slots[word][slot] |= kind(1 << bit)
        self.kind = kind
        # The share of other n-grams that a language's slice lets through.
        self.chance = np.array([np.mean(self.slots[at // 64] >> kind(at % 64) & kind(1)) ** len(MULTIPLIERS) for at in range(len(names))])

    def _slots(self, found: np.ndarray) -> list[np.ndarray]:
        with np.errstate(over="ignore"):
            return [(found * np.uint32(m)) >> np.uint32(32 - self.bits) for m in MULTIPLIERS]

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Corrected counts (text by language), and n-grams per text."""
        if len(texts) == 1 and len(texts[0]) > STRETCH:
            out, n = self._long(texts[0])
        else:
            found, starts = grams(texts)
            out, n = self._hits(found, starts[:-1]), np.diff(starts)
        return np.maximum(0, (out - n[:, None] * self.chance) / (1 - self.chance)), n

    def _long(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Counts of one long text, stretch by stretch."""
        data = np.frombuffer(GAP + text.lower().encode("utf-8", "replace") + GAP + GAP, np.uint8)
        n = len(data) - GRAM
        return sum(self._hits(_grams(data[a : min(n, a + STRETCH) + GRAM - 1]), np.zeros(1, np.int64)) for a in range(0, n, STRETCH)), np.array([n])

    def _hits(self, found: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """How many n-grams of each text each language's slice lets through."""
        out = np.zeros((len(starts), len(self.names)))
        slots = self._slots(found)
        for word in range(self.words):
            mask = self.slots[word][slots[0]]
            for s in slots[1:]:
                mask &= self.slots[word][s]
            for at in range(64 * word, min(len(self.names), 64 * word + 64)):
                hit = (mask >> self.kind(at % 64) & self.kind(1)).astype(np.int32)
                out[:, at] = np.add.reduceat(hit, starts) if len(starts) else 0
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """For each text a language and the winner's share against the runner-up."""
        sure = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
        names, score = ["und"] * len(texts), np.zeros(len(texts))
        if sure and self.names:
            counts, _ = self.counts([texts[i] for i in sure])
            order = np.argsort(-counts, axis=1, kind="stable")
            top = counts[np.arange(len(sure)), order[:, 0]]
            second = counts[np.arange(len(sure)), order[:, 1]] if len(self.names) > 1 else np.zeros(len(sure))
            for k, i in enumerate(sure):
                names[i] = self.names[order[k, 0]]
            score[sure] = np.where(top > 0, top / np.maximum(top + second, 1e-9), 0.5)
        return names, score


def held_out(modulus: int, remainder: int) -> Column:
    """Whether a document is in the fold that nothing is learned from; one without an id is."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(True))


#: N-grams of texts that are held before they are summed up.
HELD = 1 << 22


def commonest_grams(texts: Iterable[str], most: int) -> np.ndarray:
    """Of some texts' n-grams, the ``most`` that occur most often; they must be in two texts, if there are eight."""
    total = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    held, size, rows = [], 0, 0

    def summed() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found, times, of = (np.concatenate(x) for x in zip(total, *held, strict=True))
        order = np.argsort(found, kind="stable")
        found, times, of = found[order], times[order], of[order]
        new = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1]))) if len(found) else np.zeros(0, np.int64)
        return (found[new], np.add.reduceat(times, new), np.add.reduceat(of, new)) if len(found) else total

    for text in texts:
        found, times = np.unique(grams([text])[0], return_counts=True)
        held.append((found, times, np.ones(len(found), np.int64)))
        size, rows = size + len(found), rows + 1
        if size > HELD:
            total, held, size = summed(), [], 0
    found, times, of = summed()
    enough = of >= (2 if rows >= 8 else 1)
    return found[enough][np.lexsort((found[enough], -times[enough]))][:most]


def fit_language_filters(train: DataFrame, per_language: int = 400, longest: int = 1 << 20, most: int = 20_000, most_languages: int = 1024) -> LanguageFilters:
    """Learn from the ``per_language`` distinct labelled texts of each language whose hashes are least.

    Copies of a text count once, so a language with fewer texts gives all of them, however often one
    is repeated. Rows with a null text or language, or with a text of over ``longest`` bytes, are not
    in the sample. The driver reads it in order of language and holds one language's n-gram counts at
    a time. Labels that name more than ``most_languages`` languages are refused, as the filters (a bit
    a language in each slot, so 128 MB at 1024) go to every worker. An n-gram counts if two sampled
    rows of its language have it, or if the language has fewer than eight rows.
    """
    rows = common.documents_only(train, "text", "lang").where("text is not null and lang is not null").where(F.octet_length("text") <= longest)
    rows = rows.withColumn("_at", F.shiftrightunsigned(F.xxhash64("text", F.lit(17)), 1))
    keys = common.written(rows.select("lang", "_at").distinct(), "language-keys")
    sizes = {r.lang: r.n for r in keys.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(most_languages + 1).collect()}
    if not sizes or len(sizes) > most_languages:
        common.drop_written(keys)
        if sizes:
            raise ValueError(f"the labels name more than {most_languages} languages")
        return LanguageFilters([], [])

    def within(bounds: dict[str, int]) -> Column:
        return F.col("_at") <= F.create_map(*(F.lit(x) for pair in bounds.items() for x in pair))[F.col("lang")]

    # Twice the share holds the least hashes with all but certainty; the driver sees their exact bound.
    top = (1 << 63) - 1
    some: dict[str, list[int]] = {}
    for r in keys.where(within({lang: min(top, top * (2 * per_language + 50) // n) for lang, n in sizes.items()})).toLocalIterator():
        some.setdefault(r.lang, []).append(r["_at"])
    common.drop_written(keys)
    sample = rows.where(within({lang: sorted(own)[:per_language][-1] for lang, own in some.items()})).distinct().orderBy("lang", "_at")
    names, sets = [], []
    for lang, own in groupby(sample.toLocalIterator(), key=lambda r: r.lang):
        names.append(lang)
        sets.append(commonest_grams((r.text for r in own), most))
    return LanguageFilters(names, sets)


def identify_languages(docs: DataFrame, filters: LanguageFilters) -> DataFrame:
    """``doc_id, lang_pred, score`` of each whole text.

    A null or empty text, or one without any letter, is ``und`` with score 0. With no language
    learned, all are ``und``. Equal texts get equal results; other columns are not read.
    """
    spark = docs.sparkSession
    common.bounded_batches(spark)
    shared = spark.sparkContext.broadcast(filters)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in common.text_batches(batch, 1 << 20):
                names, score = shared.value.predict(piece.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return common.documents_only(docs, "doc_id", "text").mapInArrow(predict, "doc_id long, lang_pred string, score double")
