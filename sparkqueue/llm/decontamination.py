"""Benchmark decontamination: which documents hold a benchmark item, whole or slightly edited.

Items and documents are sequences of words: runs of Unicode letters, digits and marks, lower case, so
case, punctuation and white space don't matter. In scripts without spaces (Chinese, Japanese, Thai and
the like) each character is a word, and so is each symbol beyond ASCII. A document holds an item of L
words if some stretch of it can be turned into the item by at most L * (100 - percent) / 100 word edits,
or if it holds the item's N characters (those of words alone) with at most a quarter of that share of N
edited, where that is one edit or more: so typos in many words don't hide a passage.

The search embeds the part-sized window at each word of a document with a CGK random walk: step j
writes the word under the pointer, and moves the pointer on or not as a random function of that
word and j says. Few edits change few steps, so edit distance becomes Hamming distance, and sampling
some steps is a locality-sensitive hash for it. Windows and parts of items whose sampled steps agree
are candidates. An item of fewer than twice PART words is one part. A longer one is cut into parts of
PART words and more, with their share of the allowed edits each: at least one of them keeps to its
share in any match, so the cost of a long item grows with its length alone. Walks and samples are
repeated until parts with as many edits as allowed are found with the target recall, which is
simulated when the index is built, and until each part lies whole inside one walk, by which all its
exact copies are found. Where ``most_walks`` walks don't get there (as for few percents alike), the
parts' items are searched without loss instead: an item is cut into one piece more than its allowed
edits, so a match holds one of them whole, and all places of all pieces are candidates. Each
candidate is confirmed by the exact edit distance, of the part and then of the whole item.

Before walking, a window is passed over if too few of its word pairs occur in any item at all. An
edit spoils two of an item's word pairs at most, so this is a necessary condition of a match and
nothing is lost by it. Character edits are searched by exact pieces alone.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkqueue.llm import common

U64 = np.uint64

#: First and last characters of scripts written without spaces between words.
UNSPACED = (
    (0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19FF), (0x1A20, 0x1AAF), (0x1B00, 0x1B7F), (0x3005, 0x3007), (0x3021, 0x3035),
    (0x303B, 0x30FA), (0x30FC, 0x312F), (0x31A0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA000, 0xA4CF), (0xA980, 0xA9FF), (0xAA60, 0xAADF),
    (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x16FE0, 0x18DFF), (0x1AFF0, 0x1B2FF), (0x20000, 0x3FFFF),
)
#: What a character is: between words, part of one, a word by itself, or nothing (format characters).
APART, PART, ALONE, NOTHING = range(4)

#: Words of a long item's parts, at least.
PART = 12
#: Steps that a hash samples, and steps walked for each word of the shortest item of a class.
SAMPLED, STEPS = 4, 2
PAIR_BITS = 22
#: Sizes by which pieces of at least the first are looked for.
HEADS = (9, 12, 16, 32, 64, 128)
#: Bytes of text that a task searches in one go; a text of over half as many is taken in overlapping stretches of a quarter.
BYTES_AT_ONCE = 12_000_000


@lru_cache(maxsize=1)
def characters() -> tuple[np.ndarray, np.ndarray]:
    """What each character is, and the hash of its lower case."""
    kind, lower = np.full(0x40000, ALONE, np.uint8), np.arange(0x40000, dtype=U64)
    for c in range(0x40000):
        one = chr(c)
        group = unicodedata.category(one)
        if group == "Cf":
            kind[c] = NOTHING
        elif group[0] in "PZ" or group in ("Cc", "Cs") or group[0] == "S" and c < 128:
            kind[c] = APART
        elif group[0] in "LNM":
            kind[c] = PART
        if len(small := one.lower()) == 1:
            lower[c] = ord(small)
    for a, b in UNSPACED:
        own = kind[a : b + 1]
        own[own == PART] = ALONE
    with np.errstate(over="ignore"):
        return kind, common.mix64((lower + U64(1)) * U64(0xD6E8FEB86659FD93))


def symbols_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and kind of each character of all rows, and where each row starts (one more at the end)."""
    return _symbols(*common.text_bytes(texts))


def _symbols(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kinds, hashes = characters()
    if len(data) and data.max() >= 128:
        # The bytes after a character's first are folded into it.
        lead = (data & 0xC0) != 0x80
        at = np.flatnonzero(lead)
        starts = np.concatenate(([0], np.cumsum(lead)))[starts]
        symbols = data[at].astype(np.uint32)
        wide = np.flatnonzero(symbols >= 0xC0)
        code, place = symbols[wide], at[wide]
        size = 2 + (code >= 0xE0) + (code >= 0xF0)
        full = code & (0x7F >> size).astype(np.uint32)
        for j in range(1, 4):
            more = size > j
            full[more] = full[more] << np.uint32(6) | data[np.minimum(place[more] + j, len(data) - 1)] & np.uint32(0x3F)
        symbols[wide] = np.minimum(full, 0x3FFFF)
    else:
        symbols = data
    kind = kinds[symbols]
    if (gone := kind == NOTHING).any():
        starts = np.concatenate(([0], np.cumsum(~gone)))[starts]
        symbols, kind = symbols[~gone], kind[~gone]
    return hashes[symbols], kind, starts


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes (never 0) of all rows, and where each row's words start (one more at the end)."""
    return _words(*symbols_of(texts))


def _words(values: np.ndarray, kind: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, _, _, first = common.token_hashes(values, kind != APART, starts, kind == ALONE)
    return np.maximum(found, U64(1)), first


def letters_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`words_of`, with each character of a word for itself."""
    return _letters(*symbols_of(texts))


def _letters(values: np.ndarray, kind: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = kind != APART
    return np.maximum(values[inside], U64(1)), np.concatenate(([0], np.cumsum(inside)))[starts]


def pairs_of(words: np.ndarray) -> np.ndarray:
    """For each word but the last, the place in the pair table of it and the next."""
    with np.errstate(over="ignore"):
        return (common.mix64(words[:-1] * U64(0x9FB21C651E98DF25) + words[1:]) >> U64(64 - PAIR_BITS)).astype(np.int64)


def walk(words: np.ndarray, at: np.ndarray, steps: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """From each place in ``at``: the hash of the words at the sampled ``steps``, and where the pointer was last.

    ``words`` has zeros enough at its end. The bit that moves the pointer is a hash of the word
    there, the step and the salt.
    """
    place, found = at.copy(), np.zeros(len(at), U64)
    sampled = set(steps.tolist())
    with np.errstate(over="ignore"):
        for j in range(int(steps[-1]) + 1):
            now = words[place]
            if j in sampled:
                found = found * U64(0x9FB21C651E98DF25) + now
                last = place.copy()
            step = U64((salt + j * 0x9E3779B97F4A7C15) & (1 << 64) - 1)
            place += ((now ^ step) * U64(0xFF51AFD7ED558CCD) >> U64(63)).astype(np.int64)
    return common.mix64(found), last


def runs_of(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words, by its first."""
    n = len(words)
    if n < size:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, U64), np.cumsum(words * common.powers(common._P, n), dtype=U64)))
        return common.mix64((total[size:] - total[: n + 1 - size]) * common.powers(common._P_INV, n + 1)[: n + 1 - size])


def least_distance(item: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """For each row of ``texts``, the least edit distance between the item and any stretch of the row."""
    width = texts.shape[1]
    ramp = np.arange(width + 1)
    row = np.zeros((len(texts), width + 1), np.int32)
    for i, word in enumerate(item):
        now = np.empty_like(row)
        now[:, 0] = i + 1
        now[:, 1:] = np.minimum(row[:, :-1] + (texts != word), row[:, 1:] + 1)
        row = np.minimum.accumulate(now - ramp, axis=1) + ramp
    return row.min(axis=1)


def stretches(data: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hash and kind of the characters of one long text, some ``size`` bytes at a time; no word is cut."""
    held = [np.zeros(0, U64), np.zeros(0, np.uint8)]
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + size)
        while end < n and data[end] & 0xC0 == 0x80:
            end += 1
        values, kind, _ = _symbols(data[at:end], np.array([0, end - at]))
        held, at = [np.concatenate((held[0], values)), np.concatenate((held[1], kind))], end
        # As far as a character that no word goes on after.
        whole = np.flatnonzero(held[1] != PART)
        cut = len(held[1]) if at == n else int(whole[-1]) + 1 if len(whole) else 0
        if cut:
            yield held[0][:cut], held[1][:cut]
            held = [held[0][cut:], held[1][cut:]]


@dataclass(frozen=True)
class Part:
    """Words ``at`` to ``at + size`` of an item, and how many of them may be edited."""

    item: int
    at: int
    size: int
    allowed: int


@dataclass
class SizeClass:
    """Parts of like length, with the hashes of their repeated walks.

    ``reach`` words from its start hold any match, with ``pairs`` known word pairs at least.
    """

    least: int
    reach: int
    pairs: int
    steps: list[np.ndarray] = field(default_factory=list)
    salts: list[int] = field(default_factory=list)
    hashes: list[np.ndarray] = field(default_factory=list)
    parts: list[np.ndarray] = field(default_factory=list)


@dataclass
class Pieces:
    """Pieces of one size, sorted by hash: their items, and where in the item they start.

    ``known`` says which ends of a hash occur.
    """

    size: int
    known: np.ndarray
    hashes: np.ndarray
    items: np.ndarray
    offsets: np.ndarray


class ItemIndex:
    """The index of some benchmark items: ``search`` finds which rows hold which."""

    def __init__(self, ids: list[int], texts: list[str], percent: int = 80, recall: float = 0.985, seed: int = 1, most_walks: int = 1000):
        words, first = words_of(pa.array(texts, pa.string()))
        self._fill(ids, {i: words[a:b] for i, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)) if b > a}, percent)
        self.classes: list[SizeClass] = []
        self.parts = self._parts(percent)
        whole: set[int] = set()
        r = np.random.default_rng(seed)
        rest = sorted(range(len(self.parts)), key=lambda p: (self.parts[p].size, p))
        while rest:
            least = self.parts[rest[0]].size
            own = [p for p in rest if self.parts[p].size <= least * 5 // 4]
            rest = rest[len(own) :]
            if made := self._class(own, least, recall, r, most_walks):
                self.classes.append(made)
            else:
                whole |= {self.parts[p].item for p in own}
        self.pieces = self._cut(sorted(whole))
        self.letters = LetterIndex(ids, texts, 100 - (100 - percent) / 4)
        self.reach = max((len(w) + 4 * self.allowed[i] + 16 for i, w in self.words.items()), default=1)

    def _parts(self, percent: float) -> list[Part]:
        """Each item as one part, or as several of PART words and more."""
        out = []
        for i, w in self.words.items():
            many = max(1, len(w) // PART)
            edges = [j * len(w) // many for j in range(many + 1)]
            out += [Part(i, a, b - a, int((b - a) * (100 - percent) // 100)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return out

    def _own(self, p: int) -> np.ndarray:
        part = self.parts[p]
        return self.words[part.item][part.at : part.at + part.size]

    def _fill(self, ids: list[int], parts: dict[int, np.ndarray], percent: float) -> None:
        self.ids, self.words = ids, parts
        self.allowed = {i: int(len(w) * (100 - percent) // 100) for i, w in parts.items()}
        self.pairs = np.zeros(1 << PAIR_BITS, bool)
        for w in parts.values():
            self.pairs[pairs_of(w)] = True

    def _cut(self, own: list[int]) -> list[Pieces]:
        """Each item in one piece more than its allowed edits: a match holds one of them unedited."""
        by_size: dict[int, list[tuple[int, int, int]]] = {}
        for i in own:
            n, many = len(self.words[i]), min(self.allowed[i] + 1, len(self.words[i]))
            edges = [j * n // many for j in range(many + 1)]
            # Long pieces are known by their heads, so that few sizes are looked for.
            sizes = [max((s for s in HEADS if s <= b - a), default=b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            for size in set(sizes):
                found = runs_of(self.words[i], size)
                by_size.setdefault(size, []).extend((int(found[a]), i, a) for a, own in zip(edges[:-1], sizes, strict=True) if own == size)
        out = []
        for size, found in sorted(by_size.items()):
            found.sort()
            hashes, items, offsets = zip(*found, strict=True)
            known = np.zeros(1 << PAIR_BITS, bool)
            known[np.array(hashes, U64) & U64((1 << PAIR_BITS) - 1)] = True
            out.append(Pieces(size, known, np.array(hashes, U64), np.array(items), np.array(offsets)))
        return out

    def _class(self, own: list[int], least: int, recall: float, r: np.random.Generator, most_walks: int) -> SizeClass | None:
        """The walks of a class, or none if ``most_walks`` can't reach the recall."""
        sizes = [(self.parts[p].size, self.parts[p].allowed) for p in own]
        made = SizeClass(least, max(n + k for n, k in sizes), max(0, min(n - 1 - 2 * k for n, k in sizes)))
        reach = STEPS * least
        many = min(SAMPLED, reach)
        tries = self._edited(own, r)
        missed = np.ones(len(tries), bool)
        tried = np.concatenate([np.concatenate((w, np.zeros(reach + 1, U64))) for _, w in tries])
        tried_at = np.concatenate(([0], np.cumsum([len(w) + reach + 1 for _, w in tries[:-1]])))[:, None] + np.arange(5)
        padded = np.concatenate([np.concatenate((self._own(p), np.zeros(reach + 1, U64))) for p in own])
        at = np.concatenate(([0], np.cumsum([self.parts[p].size + reach + 1 for p in own[:-1]]))).astype(np.int64)
        ends = np.array([self.parts[p].size for p in own])
        indexed: set[int] = set()
        before = 1.0
        while missed.mean() > 1 - recall or len(indexed) < len(own):
            if len(made.steps) >= most_walks:
                return None
            if made.steps and len(made.steps) % 100 == 0:
                # What is missed longest is hardest to find, so the rate of late only falls.
                now = missed.mean()
                if now and now * (now / before) ** ((most_walks - len(made.steps)) / 100) > 1 - recall:
                    return None
                before = now
            # One step from each equal part of the walk.
            edges = np.linspace(0, reach, many + 1).astype(int)
            steps = np.array([r.integers(a, max(b, a + 1)) for a, b in zip(edges[:-1], edges[1:], strict=True)])
            salt = int(r.integers(1, 1 << 62))
            hashes, last = walk(padded, at, steps, salt)
            # A walk that left its part says nothing about it.
            inside = last - at < ends
            order = np.argsort(hashes[inside], kind="stable")
            made.steps.append(steps)
            made.salts.append(salt)
            made.hashes.append(hashes[inside][order])
            made.parts.append(np.array(own)[inside][order])
            mine = dict(zip(np.array(own)[inside].tolist(), hashes[inside].tolist(), strict=True))
            indexed |= mine.keys()
            met = walk(tried, tried_at.ravel(), steps, salt)[0].reshape(tried_at.shape)
            missed &= [p not in mine or mine[p] not in row for (p, _), row in zip(tries, met.tolist(), strict=True)]
        return made

    def _edited(self, own: list[int], r: np.random.Generator, tries: int = 240) -> list[tuple[int, np.ndarray]]:
        """Parts of a class with as many random edits as allowed, after two other words."""
        out = []
        for k in range(tries):
            p = own[k % len(own)]
            w = list(self._own(p))
            for _ in range(self.parts[p].allowed):
                kind, at = r.integers(3), int(r.integers(len(w)))
                new = U64(r.integers(1, 1 << 62))
                if kind == 0:
                    w[at] = new
                elif kind == 1:
                    w.insert(at, new)
                elif len(w) > 1:
                    del w[at]
            out.append((p, np.array([*r.integers(1, 1 << 62, 2), *w, *r.integers(1, 1 << 62, 4)], U64)))
        return out

    def search(self, words: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int]]:
        """``row, item, distance`` for each row and each item that it holds."""
        if not len(words) or not self.words:
            return []
        total = np.concatenate(([0], np.cumsum(self.pairs[pairs_of(words)]), [0]))
        total[-1] = total[-2]
        padded = np.concatenate((words, np.zeros(STEPS * max((c.least for c in self.classes), default=0) + 1, U64)))
        row_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
        row_end = first[1:][row_of]
        places = np.arange(len(words))
        met: dict[int, set[int]] = {}
        for c in self.classes:
            end = np.minimum(places + c.reach, row_end)
            at = np.flatnonzero(total[end - 1] - total[places] >= c.pairs)
            if not len(at):
                continue
            for steps, salt, hashes, parts in zip(c.steps, c.salts, c.hashes, c.parts, strict=True):
                found, _ = walk(padded, at, steps, salt)
                low = np.searchsorted(hashes, found)
                high = np.searchsorted(hashes, found, "right")
                for k in np.flatnonzero(high > low):
                    for p in parts[low[k] : high[k]]:
                        met.setdefault(int(p), set()).add(int(at[k]))
        out, far = [], [np.zeros((3, 0), np.int64)]
        for p, starts in met.items():
            part = self.parts[p]
            at = np.array(sorted(starts))
            d = self._distances(self._own(p), at - part.allowed - 4, row_of[at], part.size + 2 * part.allowed + 8, padded, first)
            holds = d <= part.allowed
            if part.size == len(self.words[part.item]):
                best: dict[int, int] = {}
                for row, x in zip(row_of[at[holds]].tolist(), d[holds].tolist(), strict=True):
                    best[row] = min(x, best.get(row, x))
                out += [(row, part.item, x) for row, x in best.items()]
            else:
                far.append(np.stack((np.full(int(holds.sum()), part.item), row_of[at[holds]], at[holds] - part.at)))
        far += self._met_by_pieces(words, row_of, row_end)
        return out + self._whole(*np.concatenate(far, axis=1), total, padded, first)

    def search_texts(self, texts: list[pa.Array]) -> list[tuple[int, int, int]]:
        """``row, item, distance`` of the rows of all ``texts`` in turn, by words or by characters.

        The distance is in words either way; by characters alone it is beyond the allowed edits.
        """
        parts, alike, rows, out = [], [], 0, []
        for t in texts:
            data, starts = common.text_bytes(t)
            if len(t) == 1 and len(data) > BYTES_AT_ONCE // 2:
                out += [(rows, i, d) for i, d in self.search_long(data)]
                data, starts = data[:0], np.zeros_like(starts)
            symbols = _symbols(data, starts)
            parts.append(_words(*symbols))
            alike += [(rows + row, i) for row, i, _ in self.letters.search(*_letters(*symbols))]
            rows += len(t)
        words = np.concatenate([w for w, _ in parts])
        first = np.concatenate(([0], np.cumsum(np.concatenate([np.diff(f) for _, f in parts])))).astype(np.int64)
        out += self.search(words, first)
        met = {(row, i) for row, i, _ in out}
        return out + [(row, i, int(least_distance(self.words[i], words[None, first[row] : first[row + 1]])[0])) for row, i in alike if (row, i) not in met]

    def search_long(self, data: np.ndarray) -> list[tuple[int, int]]:
        """``item, distance`` of one long text, stretch by stretch; each begins with the last one's end, as far as a match can reach."""
        best: dict[int, int] = {}
        alike: set[int] = set()

        def each() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            words = letters = np.zeros(0, U64)
            for values, kind in stretches(data, BYTES_AT_ONCE // 4):
                own = np.array([0, len(values)])
                words = np.concatenate((words[-self.reach :], _words(values, kind, own)[0]))
                letters = np.concatenate((letters[-self.letters.reach :], _letters(values, kind, own)[0]))
                yield words, letters

        for words, letters in each():
            for _, i, d in self.search(words, np.array([0, len(words)])):
                best[i] = min(d, best.get(i, d))
            alike |= {i for _, i, _ in self.letters.search(letters, np.array([0, len(letters)]))}
        if rest := alike - best.keys():
            for words, _ in each():
                for i in rest:
                    d = int(least_distance(self.words[i], words[None, :])[0])
                    best[i] = min(d, best.get(i, d))
        return list(best.items())

    def _met_by_pieces(self, words: np.ndarray, row_of: np.ndarray, row_end: np.ndarray) -> list[np.ndarray]:
        """Item, row and start of all places of all pieces of the items that are cut into pieces. Nothing is missed."""
        parts = []
        for p in self.pieces:
            found = runs_of(words, p.size)
            at = np.flatnonzero(p.known[found & U64((1 << PAIR_BITS) - 1)])
            at = at[at + p.size <= row_end[at]]
            low = np.searchsorted(p.hashes, found[at])
            many = np.searchsorted(p.hashes, found[at], "right") - low
            nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            which, place = np.repeat(low, many) + nth, np.repeat(at, many)
            parts.append(np.stack((p.items[which], row_of[place], place - p.offsets[which])))
        return parts

    def _whole(self, items: np.ndarray, rows: np.ndarray, starts: np.ndarray, total: np.ndarray, padded: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int]]:
        """``row, item, distance`` of the items that lie where they seem to start."""
        if not len(items):
            return []
        # Starts of 2k + 1 neighbouring words are confirmed together.
        span = 2 * np.array([self.allowed.get(i, 0) for i in range(len(self.ids))]) + 1
        starts = starts - (starts - first[rows]) % span[items]
        items, rows, starts = np.unique(np.stack((items, rows, starts)), axis=1)
        out = []
        edges = np.flatnonzero(np.diff(items, prepend=-1, append=-1))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            i, at, own = int(items[a]), starts[a:b], rows[a:b]
            n, k = len(self.words[i]), self.allowed[i]
            width = n + 4 * k + 8
            low = np.clip(at - k - 4, first[own], first[own + 1])
            high = np.clip(at - k - 4 + width, low + 1, np.maximum(low + 1, first[own + 1]))
            enough = total[high - 1] - total[low] >= n - 1 - 2 * k
            best: dict[int, int] = {}
            for row, d in zip(own[enough].tolist(), self._distances(self.words[i], at[enough] - k - 4, own[enough], width, padded, first).tolist(), strict=True):
                if d <= k:
                    best[row] = min(d, best.get(row, d))
            out += [(row, i, d) for row, d in best.items()]
        return out

    def _distances(self, item: np.ndarray, starts: np.ndarray, rows_of: np.ndarray, width: int, padded: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The least distance of the words ``item`` in ``width`` words from each start, of its row alone."""
        out = np.zeros(len(starts), np.int64)
        step = max(1, min(2048, 2_000_000 // width))
        for at in range(0, len(starts), step):
            some, rows = starts[at : at + step], rows_of[at : at + step]
            place = some[:, None] + np.arange(width)[None, :]
            inside = (place >= first[rows][:, None]) & (place < first[rows + 1][:, None])
            out[at : at + step] = least_distance(item, np.where(inside, padded[np.clip(place, 0, len(padded) - 1)], U64(0)))
        return out


class LetterIndex(ItemIndex):
    """The same over the characters of words, by pieces alone, for items of which any may be edited."""

    def __init__(self, ids: list[int], texts: list[str], percent: float):
        letters, first = letters_of(pa.array(texts, pa.string()))
        parts = {i: letters[a:b] for i, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True))}
        self._fill(ids, {i: w for i, w in parts.items() if len(w) * (100 - percent) >= 100}, percent)
        self.classes, self.parts = [], []
        self.pieces = self._cut(list(self.words))
        self.reach = max((len(w) + 4 * self.allowed[i] + 16 for i, w in self.words.items()), default=1)


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 80, recall: float = 0.985, slice_items: int = 20_000) -> DataFrame:
    """``doc_id, item_id, distance`` (word edits) for each document and each item that it holds.

    The distance is beyond the allowed share where a document holds an item by character edits alone.

    Only ``slice_items`` items are broadcast at a time (their number per slice is bounded in
    expectation by a hash of the item); a larger benchmark takes several passes over the
    documents. Null or wordless items and texts match nothing. Repeated documents and items give
    repeated rows; a null doc_id comes back as null.
    """
    rows = common.documents_only(docs, "doc_id", "text")
    parts = [_search(rows, index, False) for index in _indexes(docs, benchmark, percent, recall, slice_items)]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 80, recall: float = 0.985, slice_items: int = 20_000) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns; one pass a slice, no join.

    Null and wordless texts hold nothing and stay; repeated rows and null doc_ids are judged
    row by row.
    """
    if "text" in docs.columns:
        for index in _indexes(docs, benchmark, percent, recall, slice_items):
            docs = _search(docs, index, True)
    return docs


def _indexes(docs: DataFrame, benchmark: DataFrame, percent: int, recall: float, slice_items: int) -> Iterator[ItemIndex]:
    common.bounded_batches(docs.sparkSession)
    items = benchmark.select("item_id", "text").where("text is not null")
    slices = max(1, -(-items.count() // slice_items))
    for i in range(slices):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == i).orderBy("item_id", "text").collect()
        yield ItemIndex([r.item_id for r in own], [r.text for r in own], percent, recall)


def _search(rows: DataFrame, index: ItemIndex, clean: bool) -> DataFrame:
    """The matches of one index, or with ``clean`` the rows that have none."""
    shared = rows.sparkSession.sparkContext.broadcast(index)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for batch in batches:
            for piece in common.text_batches(batch):
                held.append(piece)
                many += piece.column("text").nbytes
                if many > BYTES_AT_ONCE:
                    yield from answer(held)
                    held, many = [], 0
        yield from answer(held)

    def answer(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        own = shared.value
        met = own.search_texts([h.column("text") for h in held])
        rows_met = np.array([r for r, _, _ in met], np.int64)
        if clean:
            stays = np.ones(sum(h.num_rows for h in held), bool)
            stays[rows_met] = False
            at = 0
            for piece in held:
                yield piece.filter(pa.array(stays[at : at + piece.num_rows]))
                at += piece.num_rows
        else:
            ids = pa.concat_arrays([h.column("doc_id") for h in held])
            found = [ids.take(pa.array(rows_met)), pa.array([own.ids[i] for _, i, _ in met], pa.int64()), pa.array([d for *_, d in met], pa.int32())]
            yield pa.RecordBatch.from_arrays(found, names=["doc_id", "item_id", "distance"])

    return rows.mapInArrow(search, rows.schema if clean else "doc_id long, item_id long, distance int")
