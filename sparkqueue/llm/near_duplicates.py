"""Near duplicates by bottom-k sketches of word shingles.

One hash function orders all shingles. A document's sketch holds its KEPT least hashes; inverted
lists of its LISTED least ones bring together documents that may be alike; the union of two
sketches estimates their similarity, and what passes is confirmed on the full sets.

No list is paired in full:

* Documents with equal sets are one class; only classes go on.
* Lists of up to SHORT classes give all their pairs, each pair once.
* A value in a longer list is hot. A pair of classes of which one has enough other values meets in
  a short list. Only classes with few other values (large groups of copies, or texts that are
  little more than a common passage) can meet in hot lists alone. Of those, each is compared with
  the list's least class.
* Where that leaves a list in several components, its classes are listed anew by their rarest
  shingles: two sets of the similarity asked for share one of the rarest fifth (and, of the smaller
  set, one of the rarest ninth) of their shingles, in any one order of all shingles. Common
  shingles come last in that order, so copies meet in lists of their own kind, and what groups have
  in common makes no pairs.
* Lists of common shingles that are still long, which are of texts that hold little else, are
  compared with a few random classes; what then lies outside of a list's largest component is
  compared with all of the list, block against block.
* Of the pairs that pass the estimate, first one per class is confirmed, then those that still lie
  between components: links within a component change nothing.

A link is missed only by chance: a pair of similarity 0.8 with 16 or more shingles that shares
fewer than two of the 12 or more values by which it would meet (below 3 in 10 million), or an
estimate over five standard errors off. A false link needs shingles' 64-bit hashes to collide; the
hash is keyed anew in every run, so no text can be written to collide.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkqueue.llm import common
from sparkqueue.llm.components import connected_components

KEPT, LISTED, SHORT = 64, 16, 32
#: A class with at least LISTED - OTHERS hot values among its LISTED may have links in hot lists alone.
OTHERS = 11
#: Of the KEPT least values of a union, so many are shared at least (0.8 * 64 less 5.4 standard errors).
SHARED = 34
#: Classes, and shingles, of a block.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
#: Of common shingles, so many of the commonest are known to all tasks (16 bytes each). Others count as rare, which only makes lists longer.
COMMON = 200_000
#: Random classes with which what is left of a long list is compared.
PIVOTS = 3

SKETCH = "doc_id long, tie long, n int, digest binary, sketch binary"


def row_sets(batch: pa.RecordBatch, words: int, key: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of the batch, its index and its set of shingle hashes, ascending."""
    done = 0
    for piece in common.text_batches(batch):
        data, starts = common.text_bytes(piece.column("text"))
        found, _, _, first = common.word_hashes(common.LOWER[data], starts, key=key)
        shingles, at = common.shingle_hashes(found, first, words)
        for i in range(piece.num_rows):
            yield done + i, np.unique(shingles[at[i] : at[i + 1]])
        done += piece.num_rows


def sketched(docs: DataFrame, words: int, key: int) -> DataFrame:
    """Each row's set size, digest of the full set (null if empty) and sketch."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for _, s in row_sets(batch, words, key)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("tie"),
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([s[:KEPT].tobytes() for s in sets], pa.binary()),
                ],
                names=["doc_id", "tie", "n", "digest", "sketch"],
            )

    return common.documents_only(docs, "doc_id", "text").withColumn("tie", F.xxhash64("text")).mapInArrow(sketch, SKETCH)


def listed_values(classes: DataFrame) -> DataFrame:
    """A row for each class and each of its least values: ``value, cls, n``."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = [np.frombuffer(s, "<i8")[:LISTED] for s in batch.column("sketch").to_pylist()]
            many = np.array([len(x) for x in low], np.int64)
            value = np.concatenate(low) if low else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(value), pa.array(np.repeat(batch.column("cls").to_numpy(), many)), pa.array(np.repeat(batch.column("n").to_numpy(), many))], names=["value", "cls", "n"]
            )

    return classes.select("cls", "n", "sketch").mapInArrow(spread, "value long, cls long, n int")


def shared_of_union(a: np.ndarray, b: np.ndarray, whole: bool) -> tuple[int, int]:
    """How many of the union's least values both sketches have, and how many were looked at."""
    both = np.sort(np.concatenate((a, b)))
    twice = np.flatnonzero(both[1:] == both[:-1])
    union = len(both) - len(twice)
    if whole or union <= KEPT:
        return len(twice), union
    # A value's place in the union is its place among all, less the doubles before it.
    return int(np.count_nonzero(twice - np.arange(len(twice)) < KEPT)), KEPT


def alike(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose sketches do not rule the similarity out."""
    side = classes.select("cls", "n", "sketch")
    a, b = (side.select(*(F.col(c).alias(f"{c}_{x}") for c in side.columns)) for x in "ab")
    joined = pairs.join(a, F.col("a") == F.col("cls_a")).join(b, F.col("b") == F.col("cls_b"))
    joined = joined.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            passed = []
            for n_a, n_b, s_a, s_b in zip(*(batch.column(c).to_pylist() for c in ("n_a", "n_b", "sketch_a", "sketch_b")), strict=True):
                whole = n_a <= KEPT and n_b <= KEPT
                shared, of = shared_of_union(np.frombuffer(s_a, "<u8"), np.frombuffer(s_b, "<u8"), whole)
                passed.append(100 * shared >= percent * of if whole else shared * KEPT >= (SHARED * percent // 80) * of)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(passed, pa.bool_()))

    return joined.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(keep, "a long, b long")


def full_sets(docs: DataFrame, classes: DataFrame, needed: DataFrame, words: int, key: int) -> DataFrame:
    """``cls, values`` (the full set) of the classes in ``needed``, from the texts of their first documents."""
    wanted = classes.join(needed, "cls", "left_semi").select("cls", F.col("cls").alias("doc_id"), "tie")
    texts = common.documents_only(docs, "doc_id", "text").withColumn("tie", F.xxhash64("text")).join(wanted, ["doc_id", "tie"]).select("cls", "tie", "text").dropDuplicates(["cls", "tie"])

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array([s.tobytes() for _, s in row_sets(batch, words, key)], pa.binary())], names=["cls", "values"])

    return texts.select("cls", "text").mapInArrow(collect, "cls long, values binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` that are similar enough on their full sets."""
    a, b = (sets.select(F.col("cls").alias(x), F.col("values").alias(f"values_{x}")) for x in "ab")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            passed = []
            for v_a, v_b in zip(batch.column("values_a").to_pylist(), batch.column("values_b").to_pylist(), strict=True):
                x, y = np.frombuffer(v_a, "<u8"), np.frombuffer(v_b, "<u8")
                shared = len(np.intersect1d(x, y, assume_unique=True))
                passed.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(passed, pa.bool_()))

    return pairs.join(a, "a").join(b, "b").select("a", "b", "values_a", "values_b").mapInArrow(keep, "a long, b long")


def links_in_block(cls: np.ndarray, component: np.ndarray, side: np.ndarray, values: list[bytes], percent: int) -> list[tuple[int, int]]:
    """Links between two blocks (``side`` 0 and 1; or within one, all 0) and different components.

    Of the links of one class with one component, a single one is given.
    """
    sets = [np.frombuffer(v, "<u8") for v in values]
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if side.any() else left
    sizes = np.array([len(s) for s in sets])
    codes = np.unique(np.concatenate([sets[i] for i in left]) if len(left) else np.zeros(0, np.uint64))
    codes = np.intersect1d(codes, np.concatenate([sets[i] for i in right]) if len(right) else codes)
    shared = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, len(codes), 8192):
        some = codes[at : at + 8192]

        def rows(of: np.ndarray, some: np.ndarray = some) -> np.ndarray:
            out = np.zeros((len(of), len(some)), np.float32)
            for k, i in enumerate(of):
                place = np.searchsorted(some, sets[i])
                place[place == len(some)] = 0
                out[k, place[some[place] == sets[i]]] = 1
            return out

        shared += rows(left) @ rows(right).T
    union = sizes[left][:, None] + sizes[right][None, :] - shared
    near = (100 * shared >= percent * union) & (component[left][:, None] != component[right][None, :])
    out = {}
    for i, j in np.argwhere(near):
        out.setdefault((cls[left[i]], component[right[j]]), (int(cls[left[i]]), int(cls[right[j]])))
    return list(out.values())


class Linked:
    """The links found so far, as stars: ``vertex, component``."""

    def __init__(self, classes: DataFrame, sets: DataFrame, percent: int):
        self.classes, self.sets, self.percent = classes, sets, percent
        self.components = common.written(classes.select(F.col("cls").alias("vertex"), F.col("cls").alias("component")).limit(0), "components")

    def placed(self, rows: DataFrame, column: str = "cls", name: str = "component") -> DataFrame:
        """The rows with the component of a class."""
        of = self.components.select(F.col("vertex").alias(column), F.col("component").alias(name))
        return rows.join(of, column, "left").withColumn(name, F.coalesce(name, column))

    def apart(self, pairs: DataFrame) -> DataFrame:
        """The pairs ``a, b`` of different components."""
        return self.placed(self.placed(pairs, "a", "x"), "b", "y").where("x != y").select("a", "b")

    def add(self, links: DataFrame) -> None:
        """Take links in; nothing is read again when there are none."""
        links = common.written(links, "links")
        if not links.isEmpty():
            stars = self.components.select(F.col("vertex").alias("a"), F.col("component").alias("b"))
            old, self.components = self.components, connected_components(links.union(stars))
            common.drop_written(old)
        common.drop_written(links)

    def confirm(self, pairs: DataFrame) -> None:
        """Take in those of the pairs (a table) that are links: first one for each class, then what still lies apart."""
        if pairs.isEmpty():
            return
        self.add(confirmed(self.apart(pairs).groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), self.sets, self.percent))
        self.add(confirmed(self.apart(pairs), self.sets, self.percent))

    def try_pairs(self, pairs: DataFrame) -> None:
        """As :func:`confirm`, of pairs (of any number and order) that the sketches don't rule out."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        passed = common.written(alike(self.apart(pairs), self.classes, self.percent), "pairs")
        self.confirm(passed)
        common.drop_written(passed)

    def open(self, members: DataFrame) -> DataFrame:
        """The members (``leader, cls``) of groups in several components, with their component."""
        placed = self.placed(members)
        several = placed.groupBy("leader").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least != most").select("leader")
        return common.written(placed.join(several, "leader").select("leader", "cls", "component"), "open")


def common_shingles(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The commonest of the shingles that more than SHORT of the sets hold, ascending, and in how many they are."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(batch.column("values").to_pylist()), "<i8"))], names=["value"])

    counted = sets.select("values").mapInArrow(spread, "value long").groupBy("value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SHORT)
    found = counted.orderBy(F.desc("n"), "value").limit(COMMON).toArrow()
    value, n = found.column("value").to_numpy().astype(np.int64).view(np.uint64), found.column("n").to_numpy().astype(np.int64)
    order = np.argsort(value)
    return value[order], n[order]


def rarest_first(values: np.ndarray, known: np.ndarray, times: np.ndarray) -> np.ndarray:
    """A set's shingles in the order that all sets share: by how common they are, then by hash."""
    at = np.minimum(np.searchsorted(known, values), max(0, len(known) - 1))
    return values[np.lexsort((values, np.where(known[at] == values, times[at], 0) if len(known) else np.zeros(len(values), np.int64)))]


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """``value, cls, component, n, at, small``: the shingles by which a set (with its component) of n meets others, and their place in the order.

    ``small`` ones are enough to meet sets that are no smaller.
    """
    shared = sets.sparkSession.sparkContext.broadcast(common_shingles(sets))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, times = shared.value
        for batch in batches:
            held = []
            for cls, component, v in zip(batch.column("cls").to_pylist(), batch.column("component").to_pylist(), batch.column("values"), strict=True):
                ordered = rarest_first(np.frombuffer(v.as_py(), "<u8"), known, times)
                n = len(ordered)
                many, few = n + 1 + (-percent * n // 100), n + 1 + (-2 * percent * n // (100 + percent))
                at = np.arange(many)
                held.append((ordered[:many].view(np.int64), np.full(many, cls), np.full(many, component), np.full(many, n, np.int32), at.astype(np.int32), at < few))
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], names=["value", "cls", "component", "n", "at", "small"])

    return sets.mapInArrow(spread, "value long, cls long, component long, n int, at int, small boolean")


def met_in_short_lists(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` of different components from lists of up to SHORT entries, the smaller set first, that may yet share enough."""
    a, b = (lists.select("value", *(F.col(c).alias(f"{c}_{x}") for c in ("cls", "n", "at", "small", "component"))) for x in "ab")
    met = a.where("small_a").join(b, "value").where(F.struct("n_a", "cls_a") < F.struct("n_b", "cls_b")).where("component_a != component_b").where(100 * F.col("n_a") >= percent * F.col("n_b"))
    shared = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    return met.where((100 + percent) * shared >= percent * (F.col("n_a") + F.col("n_b"))).select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b"))


def blocks_against_blocks(members: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links inside groups (``leader, cls, component``), block against block of bounded size.

    What is outside of a group's largest component meets all of the group; so a large component with
    some others beside it costs a pass.
    """
    sized = members.join(classes.select("cls", "n"), "cls")
    by_component = sized.groupBy("leader", "component").agg(F.count(F.lit(1)).alias("many"), F.sum("n").alias("n"))
    largest = F.max_by("component", F.struct("many", "component"))
    of_group = by_component.groupBy("leader").agg(largest.alias("main"), F.sum("many").alias("all"), F.sum("n").alias("all_n"), F.max("many").alias("most"), F.max_by("n", F.struct("many", "component")).alias("most_n"))

    def blocks(many: str, n: str) -> Column:
        return F.greatest(F.ceil(F.expr(many) / BLOCK), F.ceil(F.expr(n) / BLOCK_SHINGLES), F.lit(1)).cast("int")

    of_group = of_group.select("leader", "main", blocks("all", "all_n").alias("all_blocks"), blocks("all - most", "all_n - most_n").alias("other_blocks"))
    placed = sized.join(of_group, "leader").withColumn("at", F.xxhash64("cls"))

    def dealt_to(own: Column, facing: str, side: int) -> DataFrame:
        rows = placed.where("component != main") if side == 0 else placed
        met = F.explode(F.sequence(F.lit(0), F.col(facing) - 1)).alias("facing")
        rows = rows.select("leader", "cls", "component", own.cast("int").alias("own"), met)
        x, y = ("own", "facing") if side == 0 else ("facing", "own")
        return rows.select("leader", "cls", "component", F.col(x).alias("x"), F.col(y).alias("y"), F.lit(side).alias("side"))

    dealt = dealt_to(F.pmod("at", "other_blocks"), "all_blocks", 0).union(dealt_to(F.pmod("at", "all_blocks"), "other_blocks", 1))
    dealt = dealt.join(sets, "cls")

    def compare(table: pa.Table) -> pa.Table:
        cls, component, side = (table.column(c).to_numpy() for c in ("cls", "component", "side"))
        found = links_in_block(cls, component, side, table.column("values").to_pylist(), percent)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return dealt.groupBy("leader", "x", "y").applyInArrow(compare, "a long, b long")


def link_open_groups(linked: Linked, members: DataFrame) -> None:
    """Find the links inside groups (``leader, cls``) that lie in several components."""
    left = linked.open(members)
    if left.isEmpty():
        return
    own = common.written(linked.sets.join(left.select("cls").distinct(), "cls", "left_semi"), "open-sets")
    common.drop_written(left)
    listed = common.written(prefixes(linked.placed(own), linked.percent), "prefixes")
    sizes = listed.groupBy("value").agg(F.count(F.lit(1)).alias("size"), F.max("small").alias("any"), F.min("cls").alias("leader"), F.min("component").alias("least"), F.max("component").alias("most"))
    sizes = common.written(sizes.where("any and least != most"), "prefix-sizes")
    linked.try_pairs(met_in_short_lists(listed.join(sizes.where(F.col("size") <= SHORT).select("value"), "value", "left_semi"), linked.percent))
    long = common.written(listed.join(sizes.where(F.col("size") > SHORT).select("value", "leader"), "value").select("leader", "cls").distinct(), "long-lists")
    common.drop_written(listed, sizes)
    for turn in range(PIVOTS):
        left = linked.open(long)
        if left.isEmpty():
            common.drop_written(left)
            break
        pivot = left.groupBy("leader").agg(F.min_by(F.struct(F.col("cls").alias("a"), F.col("component").alias("own")), F.xxhash64("cls", F.lit(turn))).alias("pivot")).select("leader", "pivot.*")
        linked.try_pairs(left.join(pivot, "leader").where("component != own").select("a", F.col("cls").alias("b")))
        common.drop_written(left)
    left = linked.open(long)
    linked.add(blocks_against_blocks(left, linked.classes, own, linked.percent))
    common.drop_written(left, long, own)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each document.

    Words are lower-cased (A-Z) and parted by white space; a set holds the distinct runs of
    ``words`` of them, or the whole sequence if shorter. Documents with 100 * intersection >=
    ``percent`` * union are linked; ``component_id`` is the least doc_id reachable, ``kept`` is
    ``doc_id = component_id``. Null or wordless texts have an empty set and stand alone. A row
    with a null doc_id shares the component of an equal set with a doc_id; else its component is
    null and it is kept. Repeated rows all come back. Other columns are not read.
    """
    return _judged(docs, words, percent).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", "kept")


def without_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, with all its columns: that with the least doc_id.

    Rows that repeat in doc_id and text count as one. Other rules as in :func:`near_duplicates`.
    """
    kept = _judged(docs, words, percent).where("kept").groupBy("doc_id", "tie").agg(F.count(F.lit(1)).alias("times"))
    id_name, tie_name = common.free_names(docs, "kept_id", "kept_tie")
    kept = common.written(kept.select(F.col("doc_id").alias(id_name), F.col("tie").alias(tie_name), "times"), "kept")
    # Names that no column of the documents has; they are gone again at the end.
    own_tie = common.free_names(docs, "text_tie")[0]
    marked = docs.withColumn(own_tie, F.xxhash64("text") if "text" in docs.columns else F.xxhash64(F.lit(None).cast("string")))
    same_id = marked["doc_id"].eqNullSafe(kept[id_name]) if "doc_id" in docs.columns else F.col(id_name).isNull()
    out = marked.join(kept.drop("times"), same_id & (F.col(own_tie) == F.col(tie_name)), "left_semi")
    if not kept.where("times > 1").isEmpty():
        out = out.dropDuplicates([c for c in ("doc_id", own_tie) if c in out.columns])
    return out.drop(own_tie)


def _judged(docs: DataFrame, words: int, percent: int) -> DataFrame:
    common.bounded_batches(docs.sparkSession)
    key = secrets.randbits(63)
    rows = common.written(sketched(docs, words, key), "sketches")
    found = rows.where("n > 0 and doc_id is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "tie")).alias("first"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = common.written(found.select("digest", F.col("first.doc_id").alias("cls"), F.col("first.tie").alias("tie"), "n", "sketch"), "classes")

    values = common.written(listed_values(classes), "values")
    sizes = values.groupBy("value").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    lists = common.written(values.join(sizes, "value"), "lists")
    common.drop_written(values)

    short = lists.where(F.col("size") <= SHORT).select("value", "cls", "n")
    a, b = (short.select("value", F.col("cls").alias(x), F.col("n").alias(f"n_{x}")) for x in "ab")
    met = a.join(b, "value").where(F.col("a") < F.col("b")).where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    met = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("times"), F.min(F.least("n_a", "n_b")).alias("n")).where((F.col("times") > 1) | (F.col("n") < LISTED)).select("a", "b")
    short_pairs = common.written(alike(met, classes, percent), "short-pairs")

    hot = lists.where(F.col("size") > SHORT)
    enough = F.when(F.col("n") < LISTED, 100 * F.col("hot") >= percent * F.col("n")).otherwise(F.col("hot") >= LISTED - OTHERS)
    heavy = common.written(hot.groupBy("cls").agg(F.count(F.lit(1)).alias("hot"), F.first("n").alias("n")).where(enough).select("cls"), "heavy")
    hot = common.written(hot.select("value", "cls").join(heavy, "cls"), "hot")
    common.drop_written(lists, heavy)
    members = hot.join(hot.groupBy("value").agg(F.min("cls").alias("leader")), "value").select("leader", "cls").distinct()
    members = common.written(members, "members")
    common.drop_written(hot)
    hot_pairs = common.written(alike(members.where("leader != cls").select(F.col("leader").alias("a"), F.col("cls").alias("b")), classes, percent), "hot-pairs")

    ends = short_pairs.union(hot_pairs)
    needed = common.written(ends.select(F.col("a").alias("cls")).union(ends.select(F.col("b").alias("cls"))).union(members.select("cls")).distinct(), "needed")
    sets = common.written(full_sets(docs, classes, needed, words, key), "sets")
    common.drop_written(needed)

    linked = Linked(classes, sets, percent)
    linked.confirm(ends)
    common.drop_written(short_pairs, hot_pairs)
    link_open_groups(linked, members)
    common.drop_written(members, sets)

    final = classes.select("digest", "cls").join(linked.components.withColumnRenamed("vertex", "cls"), "cls", "left")
    final = common.written(final.select("digest", F.coalesce("component", "cls").alias("found")), "class-components")
    common.drop_written(classes, linked.components)
    component = F.coalesce("found", "doc_id")
    return rows.join(final, "digest", "left").select("doc_id", "tie", "n", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))
