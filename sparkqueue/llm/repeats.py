"""Removal of passages that repeat across documents: winnowed anchors and three exchanges of hashes.

A byte goes if a string of THRESHOLD bytes covers it that also starts in a document with a smaller
doc_id. This stands in for distributed prefix doubling, which sorts a row of ranks and place for
every byte in every round; measured, that is many times the disk that there is (see the README). So
ranks are hashes, which need no renumbering, they are taken at a sample of places that no match can
miss, and places drop out as soon as their rank is theirs alone:

1. Every string of 50 bytes has 32 places for a string of 19. The one with the least hash is its
   anchor; equal strings have equal anchors. Neighbouring strings mostly share theirs, so anchors
   are some 6 in 100 places. Their 19-byte ranks are exchanged by rank and counted; anchors whose
   rank lies in a single document drop out, with all strings that they stand for.
2. What is left is ranked by a longer string: all that a run of strings with one anchor covers (50
   to 81 bytes). Runs whose rank also lies in a smaller doc_id go as a whole. Runs that are the
   first of their rank, but not the only one of their anchor, stay open; the rest is settled.
3. Each string of an open run is ranked at the threshold, by the pair of its ranks at offsets 0 and
   25, and goes if the least doc_id of its rank is smaller than its own.

A rank is a 64-bit hash of the string, so equal strings have equal ranks everywhere. (A false match
needs two of N ranked strings to collide: N * N / 2**65.)

Documents lie in blocks, files of the shared folder, of BLOCK_BYTES of text at most or one document.
A round is a task per block that sends, for each range of ranks, its sorted distinct ranks; a task
per range, whose number follows the size of the text, answers with a code for each; the next round
reads the answers in the same order. What a round finds out about a block (its runs, and which are
left) is put beside it, so the next one neither searches for anchors nor asks again. A task that is run
again writes the same files again. So a rank crosses the network
once per block, however often the block has it, and a very common passage is no larger in its range
than any other rank.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkqueue.llm import common, files

U64 = np.uint64
THRESHOLD, GRAM, PLACES = 50, 19, 32
HALF = THRESHOLD // 2
#: Bytes that are hashed at once; a longer document is taken in overlapping stretches.
STRETCH = 1 << 18
NO_ID = np.iinfo(np.int64).max
#: Strings that round 3 ranks at once; a block has as many groups of them as it needs.
STRINGS_AT_ONCE = 1_000_000
#: Text of a block, and input that a range of ranks stands for.
BLOCK_BYTES, RANGE_BYTES = 8 << 20, 16 << 20
#: Ranks of a message, and bytes of messages that leave a worker at once: large rows are costly in Spark's heap.
RANKS_AT_ONCE, SENT_AT_ONCE = 1 << 12, 1 << 20
#: Tasks of a round, at most; a task takes its blocks one after the other.
MOST_TASKS = 50_000
BLOCKS = "block long, path string"
SENT = "part int, block long, sub int, ranks binary, more binary"
ANSWER = "part int, block long, sub int, codes binary"


class Hashes:
    """Hashes of any substrings of some bytes, by position and length."""

    def __init__(self, data: np.ndarray):
        self.total = np.zeros(len(data) + 1, U64)
        with np.errstate(over="ignore"):
            np.cumsum(common._BYTE[data] * common.powers(common._P, len(data)), out=self.total[1:])
        self.back = common.powers(common._P_INV, len(data) + 1)

    def at(self, first: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        with np.errstate(over="ignore"):
            return common.mix64((self.total[end] - self.total[first]) * self.back[first])


def runs(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings with one anchor: first string, number of strings, anchor."""
    n = len(data)
    empty = np.zeros(0, np.int64)
    if n < THRESHOLD:
        return empty, empty, empty
    least = Hashes(data).at(slice(0, n - GRAM + 1), slice(GRAM, n + 1))
    place = np.arange(len(least), dtype=np.int32)
    reach = 1
    while reach < PLACES:
        later = least[reach:] < least[:-reach]
        place = np.where(later, place[reach:], place[:-reach])
        least = np.where(later, least[reach:], least[:-reach])
        reach *= 2
    lengths = np.diff(starts)
    many = np.maximum(0, lengths - THRESHOLD + 1)
    at = np.arange(int(many.sum())) + np.repeat(starts[:-1] - np.concatenate(([0], np.cumsum(many)[:-1])), many)
    if not len(at):
        return empty, empty, empty
    anchor = place[at]
    new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)))
    first = at[new]
    return first, np.diff(np.concatenate((np.flatnonzero(new), [len(at)]))), anchor[new].astype(np.int64)


class Block:
    """The documents of one file, and what the rounds so far say of them.

    Runs are held as ``first`` (byte), ``count`` (strings) and ``offset`` (of the anchor); the rounds
    work on ever fewer of them.
    """

    def __init__(self, uri: str, parts: int, at_once: int = STRINGS_AT_ONCE):
        path = files.local_path(uri)
        if path is None:
            from pyarrow import fs

            store, path = fs.FileSystem.from_uri(uri)
            table = pq.read_table(path, filesystem=store, columns=["doc_id", "text"])
        else:
            table = pq.read_table(path, columns=["doc_id", "text"])
        self.uri, self.parts, self.at_once = uri, parts, at_once
        self.ids = table.column("doc_id").combine_chunks() if table.num_rows else pa.array([], pa.int64())
        self.order = self.ids.fill_null(NO_ID).to_numpy().astype(np.int64)
        text = table.column("text").cast(pa.large_string())
        self.data, self.starts = common.text_bytes(text.combine_chunks()) if table.num_rows else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
        found = self.kept("runs")
        if found is None:
            found = [(a + f, n, g - f) for a, b, s in self.pieces() for f, n, g in [runs(self.data[a:b], s)]]
            join = lambda k, kind: np.concatenate([x[k] for x in found]).astype(kind) if found else np.zeros(0, kind)
            first = join(0, np.int64)
            found = [np.diff(first, prepend=0).astype(np.uint32), join(1, np.uint8), join(2, np.uint8)]
            self.keep_file("runs", found)
        self.first, self.count, self.offset = np.cumsum(found[0], dtype=np.int64), found[1].astype(np.int64), found[2].astype(np.int64)

    def kept(self, name: str) -> list[np.ndarray] | None:
        """What an earlier round put beside the block."""
        data = files.get(f"{self.uri}.{name}")
        return None if data is None else [c.to_numpy() for c in pa.ipc.open_stream(pa.py_buffer(data)).read_all().columns]

    def keep_file(self, name: str, columns: list[np.ndarray]) -> None:
        table = pa.table({str(k): pa.array(c) for k, c in enumerate(columns)})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(table)
        files.put(f"{self.uri}.{name}", sink.getvalue().to_pybytes())

    def docs_of(self, at: np.ndarray) -> np.ndarray:
        return self.order[np.searchsorted(self.starts, at, "right") - 1]

    def ranks(self, which: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray]:
        """Of some runs (ascending): the anchors' ranks, and with ``whole`` the runs' own."""
        gram, own = np.zeros(len(which), U64), np.zeros(len(which) if whole else 0, U64)
        first, count, offset = self.first[which], self.count[which], self.offset[which]
        for a, b, _ in self.pieces():
            i, j = np.searchsorted(first, [a, b if b - a <= STRETCH else a + STRETCH])
            if i == j:
                continue
            hashes, f = Hashes(self.data[a:b]), first[i:j] - a
            gram[i:j] = hashes.at(f + offset[i:j], f + offset[i:j] + GRAM)
            if whole:
                with np.errstate(over="ignore"):
                    own[i:j] = common.mix64(hashes.at(f, f + count[i:j] + THRESHOLD - 1) + (count[i:j] * 64 + offset[i:j]).astype(U64))
        # Anchors are the least of many, so their hashes crowd at the low end; mixed again, they lie evenly in the ranges.
        gram = common.mix64(gram ^ U64(0x5851F42D4C957F2D))
        return self.part_of(gram) << U64(32) | gram & U64(0xFFFFFFFF), own

    def part_of(self, ranks: np.ndarray) -> np.ndarray:
        """The range of ranks that a rank is in, from its upper half."""
        return (ranks >> U64(32)) * U64(self.parts) >> U64(32)

    def pieces(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """Stretches of the bytes that hold every string: start, end, and where their rows start (one more at the end)."""
        row, n = 0, len(self.starts) - 1
        while row < n:
            a = int(self.starts[row])
            to = max(row + 1, int(np.searchsorted(self.starts, a + STRETCH, "right")) - 1)
            b = int(self.starts[to])
            if b - a <= STRETCH:
                yield a, b, self.starts[row : to + 1] - a
            else:
                for s in range(a, max(a + 1, b - THRESHOLD + 1), STRETCH):
                    e = min(b, s + STRETCH + THRESHOLD - 1)
                    yield s, e, np.array([0, e - s])
            row = to

    # Round 1: anchors' ranks.

    def _anchors(self) -> np.ndarray:
        gram, _ = self.ranks(np.arange(len(self.first)), False)
        self.known, new, self.place = np.unique(gram, return_index=True, return_inverse=True)
        return new

    def anchors(self) -> Iterator[tuple[int, int, bytes, bytes]]:
        self._anchors()
        if not len(self.known):
            return
        doc = self.docs_of(self.first)
        least, most = np.full(len(self.known), NO_ID), np.full(len(self.known), np.iinfo(np.int64).min)
        np.minimum.at(least, self.place, doc)
        np.maximum.at(most, self.place, doc)
        for part, sub, a, b in self.cut(self.known >> U64(32)):
            yield part, sub, self.known[a:b].astype("<u4").tobytes(), np.packbits(least[a:b] != most[a:b]).tobytes()

    def cut(self, part: np.ndarray, group: int = 0) -> Iterator[tuple[int, int, int, int]]:
        """Stretches of equal, ascending ``part``, of bounded length: the part, a number that is the stretch's own in it, start and end."""
        there, new = np.unique(part, return_index=True)
        for p, a, b in zip(there.tolist(), new.tolist(), [*new[1:].tolist(), *[len(part)] * (len(part) > 0)], strict=True):
            for k, at in enumerate(range(a, b, RANKS_AT_ONCE)):
                yield p, group << 16 | k, at, min(b, at + RANKS_AT_ONCE)

    def drop_lone(self, codes: dict[tuple[int, int], bytes]) -> np.ndarray:
        """The runs whose anchors lie in several documents."""
        self._anchors()
        stays = np.zeros(len(self.known), bool)
        for part, sub, a, b in self.cut(self.known >> U64(32)):
            stays[a:b] = np.unpackbits(np.frombuffer(codes[sub, part], np.uint8), count=b - a)
        return np.flatnonzero(stays[self.place]) if len(self.known) else np.zeros(0, np.int64)

    # Round 2: runs' ranks.

    def run_ranks(self, left: np.ndarray) -> Iterator[tuple[int, int, bytes, bytes]]:
        (gram, whole), doc = self.ranks(left, True), self.docs_of(self.first[left])
        order = np.lexsort((doc, whole, gram))
        new = np.ones(len(order), bool)
        new[1:] = (gram[order][1:] != gram[order][:-1]) | (whole[order][1:] != whole[order][:-1])
        self.entry = np.empty(len(order), np.int64)
        self.entry[order] = np.cumsum(new) - 1
        head = order[new]
        self.entry_doc = doc[head]
        self.entry_part = gram[head] >> U64(32)
        for part, sub, a, b in self.cut(self.entry_part):
            yield part, sub, gram[head[a:b]].astype("<u4").tobytes(), whole[head[a:b]].tobytes() + self.entry_doc[a:b].tobytes()

    def settle(self, left: np.ndarray, codes: dict[tuple[int, int], bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Which runs go as a whole, and which stay open."""
        for _ in self.run_ranks(left):
            pass
        code = np.concatenate([np.frombuffer(codes[sub, p], np.uint8) for p, sub, _, _ in self.cut(self.entry_part)]) if len(self.entry_part) else np.zeros(0, np.uint8)
        own = code[self.entry]
        later = self.docs_of(self.first[left]) > self.entry_doc[self.entry]
        return left[later | (own == GONE)], left[~later & (own == OPEN)]

    # Round 3: strings' ranks, each the pair of its halves' ranks.

    def strings(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The strings of the open runs, in groups of bounded size: place and rank."""
        held, many = [], 0
        first = self.first[self.open]
        for a, b, _ in self.pieces():
            # The stretches overlap, but the runs of each are its own: they start before the next.
            i, j = np.searchsorted(first, [a, b if b - a <= STRETCH else a + STRETCH])
            if i == j:
                continue
            own = self.open[i:j]
            hashes = Hashes(self.data[a:b])
            count = self.count[own]
            at = np.repeat(self.first[own] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum()) - a
            with np.errstate(over="ignore"):
                held.append((at + a, common.mix64(hashes.at(at, at + HALF) * U64(0x9FB21C651E98DF25) + hashes.at(at + HALF, at + THRESHOLD))))
            many += len(at)
            if many >= self.at_once:
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held, many = [], 0
        if held:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))

    def distinct(self, at: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct ranks, the least document of each, and each string's document and place among the ranks."""
        doc = self.docs_of(at)
        ranks, place = np.unique(rank, return_inverse=True)
        least = np.full(len(ranks), NO_ID)
        np.minimum.at(least, place, doc)
        return ranks, least, doc, place

    def string_ranks(self) -> Iterator[tuple[int, int, bytes, bytes]]:
        for group, (at, rank) in enumerate(self.strings()):
            ranks, least, _, _ = self.distinct(at, rank)
            for part, sub, a, b in self.cut(self.part_of(ranks), group):
                yield part, sub, ranks[a:b].tobytes(), least[a:b].tobytes()

    def merged(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal stretches of some that may overlap: row, start, end, in order. None reaches over a row's end."""
        order = np.argsort(start, kind="stable")
        start, end = start[order], np.maximum.accumulate(end[order])
        row = np.searchsorted(self.starts, start, "right") - 1
        new = np.ones(len(start), bool)
        new[1:] = (start[1:] > end[:-1]) | (row[1:] != row[:-1])
        at = np.flatnonzero(new)
        last = np.concatenate((at[1:], [len(start)])).astype(np.int64) - 1 if len(at) else at
        return row[new], start[new], end[last]

    def spans(self, codes: dict[tuple[int, int], bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The maximal stretches of bytes that go: row, start, end, in order."""
        found = [self.merged(self.first[self.gone], self.first[self.gone] + self.count[self.gone] + THRESHOLD - 1)]
        for group, (at, rank) in enumerate(self.strings()):
            ranks, least, doc, place = self.distinct(at, rank)
            elsewhere = np.zeros(len(ranks), bool)
            for part, sub, a, b in self.cut(self.part_of(ranks), group):
                elsewhere[a:b] = np.unpackbits(np.frombuffer(codes[sub, part], np.uint8), count=b - a)
            goes = at[elsewhere[place] | (doc > least[place])]
            found.append(self.merged(goes, goes + THRESHOLD))
        _, start, end = (np.concatenate(x) for x in zip(*found, strict=True))
        return self.merged(start, end)

    def kept_hashes(self, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[str]:
        """SHA-256 of what is left of each row."""
        first = np.searchsorted(row, np.arange(len(self.starts)))
        out = []
        for i, (a, b) in enumerate(zip(self.starts[:-1].tolist(), self.starts[1:].tolist(), strict=True)):
            found = hashlib.sha256()
            for k in range(first[i], first[i + 1]):
                found.update(self.data[a : start[k]])
                a = int(end[k])
            found.update(self.data[a:b])
            out.append(found.hexdigest())
        return out


#: Codes of a run's rank: settled as kept, gone, or open.
KEPT, GONE, OPEN = 0, 1, 2


def count_anchors(ranks: list[np.ndarray], more: list[bytes]) -> list[bytes]:
    """Per block, a bit for each rank: whether it lies in several documents."""
    every, place, times = np.unique(np.concatenate(ranks), return_inverse=True, return_counts=True)
    several = times > 1
    own = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=len(r)) for r, m in zip(ranks, more, strict=True)]).astype(bool)
    several[place[own]] = True
    return [np.packbits(x).tobytes() for x in np.split(several[place], np.cumsum([len(r) for r in ranks])[:-1])]


def judge_runs(ranks: list[np.ndarray], more: list[bytes]) -> list[bytes]:
    """Per block, a code for each run's rank, given its anchor's rank and the least document that has it."""
    gram = np.concatenate(ranks)
    whole = np.concatenate([np.frombuffer(m, "<u8")[: len(r)] for r, m in zip(ranks, more, strict=True)])
    doc = np.concatenate([np.frombuffer(m, "<i8")[len(r) :] for r, m in zip(ranks, more, strict=True)])
    order = np.lexsort((doc, whole, gram))
    g, w, d = gram[order], whole[order], doc[order]
    new_gram = np.concatenate(([True], g[1:] != g[:-1]))
    new = new_gram | np.concatenate(([True], w[1:] != w[:-1]))
    run = np.cumsum(new) - 1
    code = np.where(d > d[new][run], GONE, KEPT).astype(np.uint8)
    # Of an anchor's runs, more than one kind and more than one first document: open.
    at = np.flatnonzero(new_gram[new])
    firsts = d[new]
    mixed = np.minimum.reduceat(firsts, at) != np.maximum.reduceat(firsts, at)
    of = np.repeat(mixed, np.diff(np.concatenate((at, [len(firsts)]))))[run]
    code[(code == KEPT) & of] = OPEN
    out = np.empty_like(code)
    out[order] = code
    return [x.tobytes() for x in np.split(out, np.cumsum([len(r) for r in ranks])[:-1])]


def judge_strings(ranks: list[np.ndarray], more: list[bytes]) -> list[bytes]:
    """Per block, a bit for each string's rank: whether a smaller document than the block's least has it."""
    rank, doc = np.concatenate(ranks), np.concatenate([np.frombuffer(m, "<i8") for m in more])
    every, place = np.unique(rank, return_inverse=True)
    least = np.full(len(every), NO_ID)
    np.minimum.at(least, place, doc)
    return [np.packbits(x).tobytes() for x in np.split(least[place] < doc, np.cumsum([len(r) for r in ranks])[:-1])]


def _round(asked: DataFrame, parts: int, send: Callable, kind: str, judge: Callable, name: str) -> DataFrame:
    """Send each block's ranks to the ranges they are in; the answers come back with the block's number."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, path, codes in _blocks_in(batches):
            held, size = [], 0
            for message in send(path, codes):
                held.append(message)
                size += len(message[2]) + len(message[3])
                if size > SENT_AT_ONCE:
                    yield batch_of(block, held)
                    held, size = [], 0
            if held:
                yield batch_of(block, held)

    def batch_of(block: int, held: list[tuple]) -> pa.RecordBatch:
        part, sub, ranks, more = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([block] * len(held), pa.int64()), pa.array(sub, pa.int32()), pa.array(ranks, pa.binary()), pa.array(more, pa.binary())], names=["part", "block", "sub", "ranks", "more"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # All that a partition holds is of one range.
        held = list(batches)
        if not sum(b.num_rows for b in held):
            return
        table = pa.Table.from_batches(held)
        codes = judge([np.frombuffer(r.as_py(), kind) for r in table.column("ranks")], [m.as_py() for m in table.column("more")])
        yield from pa.table({"part": table.column("part"), "block": table.column("block"), "sub": table.column("sub"), "codes": pa.array(codes, pa.binary())}).to_batches()

    return common.written(asked.mapInArrow(ask, SENT).repartitionById(parts, F.col("part")).mapInArrow(answer, ANSWER), name)


def _asked(blocks: DataFrame, many: int, answers: DataFrame | None = None) -> DataFrame:
    """Each block's row, and after it the answers to its ranks, in one partition."""
    rows = blocks.select("block", "path", F.lit(None).cast("int").alias("sub"), F.lit(None).cast("int").alias("part"), F.lit(None).cast("binary").alias("codes"))
    if answers is not None:
        rows = rows.union(answers.select("block", F.lit(None).cast("string"), "sub", "part", "codes"))
    return rows.repartition(min(many, MOST_TASKS), "block").sortWithinPartitions("block", F.col("path").isNull())


def _blocks_in(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, dict[tuple[int, int], bytes]]]:
    """Blocks one by one, with the answers that follow them."""
    now = path = None
    codes: dict[tuple[int, int], bytes] = {}
    for batch in batches:
        for row in batch.to_pylist():
            if row["path"] is not None:
                if now is not None:
                    yield now, path, codes
                now, path, codes = row["block"], row["path"], {}
            else:
                codes[row["sub"], row["part"]] = row["codes"]
    if now is not None:
        yield now, path, codes


def write_blocks(docs: DataFrame, folder: str, most_bytes: int = BLOCK_BYTES, most_rows: int = 100_000) -> DataFrame:
    """The documents as files of bounded size, a row for each: ``block, path``. Only files that are listed count."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        held, size, rows, k = [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            path = f"{folder}/block-{task.partitionId():06d}-{k:04d}-{task.taskAttemptId()}.parquet"
            with files.writing(path) as out:
                pq.write_table(pa.Table.from_batches(held), out, compression="zstd")
            return pa.RecordBatch.from_pydict({"block": pa.array([task.partitionId() << 32 | k], pa.int64()), "path": [path]})

        for batch in batches:
            for piece in common.text_batches(batch, min(most_bytes, 1 << 19)):
                own = piece.column("text").nbytes
                if held and (size + own > most_bytes or rows + piece.num_rows > most_rows):
                    yield flush()
                    held, size, rows, k = [], 0, 0, k + 1
                held.append(piece)
                size, rows = size + own, rows + piece.num_rows
        if rows:
            yield flush()

    return common.written(common.documents_only(docs, "doc_id", "text").mapInArrow(write, BLOCKS), "block-list")


def without_repeats(docs: DataFrame, block_bytes: int = BLOCK_BYTES, block_rows: int = 100_000, strings_at_once: int = STRINGS_AT_ONCE) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of each whole text.

    Matches are of UTF-8 bytes and never cross documents; within one document nothing repeats.
    A null text is empty. A null doc_id counts as larger than any other, and rows of equal doc_id
    as one document. Texts of fewer than 50 bytes lose nothing. Other columns are not read.
    """
    spark = docs.sparkSession
    common.bounded_batches(spark)
    blocks = write_blocks(docs, common.fresh_path(spark, "blocks"), block_bytes, block_rows)
    many = max(1, blocks.count())
    parts = common.partitions_for(docs, RANGE_BYTES)

    def left_of(block: Block, codes: dict[tuple[int, int], bytes]) -> np.ndarray:
        left = block.drop_lone(codes)
        block.keep_file("left", [left])
        return left

    def first(path: str, codes: dict) -> Iterator:
        return Block(path, parts, strings_at_once).anchors()

    def second(path: str, codes: dict) -> Iterator:
        block = Block(path, parts, strings_at_once)
        return block.run_ranks(left_of(block, codes))

    def third(path: str, codes: dict) -> Iterator:
        block = Block(path, parts, strings_at_once)
        block.gone, block.open = block.settle(block.kept("left")[0], codes)
        block.keep_file("gone", [block.gone])
        block.keep_file("open", [block.open])
        return block.string_ranks()

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, path, codes in _blocks_in(batches):
            block = Block(path, parts, strings_at_once)
            block.gone, block.open = block.kept("gone")[0], block.kept("open")[0]
            span_row, start, end = block.spans(codes)
            rows = len(block.starts) - 1
            yield pa.RecordBatch.from_arrays(
                [
                    block.ids,
                    pa.array(np.diff(block.starts)),
                    pa.array(np.bincount(span_row, end - start, rows).astype(np.int64)),
                    pa.array(np.bincount(span_row, minlength=rows).astype(np.int64)),
                    pa.array(block.kept_hashes(span_row, start, end), pa.string()),
                ],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    one = _round(_asked(blocks, many), parts, first, "<u4", count_anchors, "anchors")
    two = _round(_asked(blocks, many, one), parts, second, "<u4", judge_runs, "runs")
    common.drop_written(one)
    three = _round(_asked(blocks, many, two), parts, third, "<u8", judge_strings, "strings")
    common.drop_written(two)
    return _asked(blocks, many, three).mapInArrow(last, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
