"""SimHash near-duplicates at a Jaccard similarity, for the pipeline.

Documents link when their sets of five-word shingles have a similarity of ``LEAST`` or
more.  Documents with one and the same set are one class, so copies cost nothing.

Candidates.  First those of ``simhash``: classes whose fingerprints (over five-word shingles) are
found within two bits by Golay keys.  At a similarity of 0.8 two fingerprints differ in about ten of 64
bits, where no choice of Golay keys is both complete and selective, so minima complete them: classes
that agree in all ``ROWS`` minima of one of ``BANDS`` bands share a key.  A pair at
similarity 0.8 shares none with probability (1 - 0.8^5)^40, about 1e-7.

Verification.  Candidates are compared by their whole sets.  At first each class only meets the
pivot of each of its keys, the member that shares most keys with others, and linked classes are joined to
components.  Then, around a pivot whose keys' members still have several components, those outside the
largest one meet all members in blocks of ``CHUNK`` sets; a block returns links only, so no
list of pairs is ever made, and a class is sent once for a pivot, not once for a key.  So the components are those of
all links among candidates.  The work of the blocks is the product of a pivot's members and of those
outside the largest component.

Defined cases: null text is empty; texts without words are one class; texts shorter than a
shingle are one shingle; rows that repeat are kept; a null key never is the smallest; very long
texts are read whole; an empty table gives no rows; extra columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from ..shipping import ship
from .common import cut, lean, small_or_not, text_or_empty, without
from .components import components
from .simhash import SEED, majority, shingle_hashes
from .simhash import links as near_fingerprints

WORDS = 5
LEAST = 0.8
ROWS = 5
BANDS = 40
#: Sets in a block, and shingles in all of them.
CHUNK = 256
CHUNK_SHINGLES = 1 << 18
_BLOCK = 1 << 11
_RNG = np.random.default_rng(SEED)
_FACTOR = _RNG.integers(0, 1 << 63, (ROWS * BANDS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _RNG.integers(0, 1 << 63, (ROWS * BANDS, 1), dtype=np.uint64)


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of one whole text's shingles."""
    return np.unique(shingle_hashes(text, words))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key for each band, as signed longs."""
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), _BLOCK):
        np.minimum(least, ((hashes[at : at + _BLOCK] ^ _FLIP) * _FACTOR).min(1), out=least)
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(rows[b].tobytes(), b) for b in range(BANDS)], dtype=np.uint64).view(np.int64)


def _class(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int64), *parts])))


def signatures(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, class ``cls``, number of shingles ``n``, fingerprint ``fp`` and the keys ``bands``, one row for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, n, fps, bands = [], [], [], []
            for t in batch.column(1):
                every = shingle_hashes(t.as_py(), WORDS)
                h = np.unique(every)
                cls.append(_class(h))
                n.append(len(h))
                fps.append(majority(every))
                bands.append(band_keys(h) if len(h) else np.empty(0, np.int64))
            signed = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (cls, fps)]
            yield pa.RecordBatch.from_arrays([batch.column(0), signed[0], pa.array(n, pa.int64()), signed[1], _lists(bands)], names=[key, "cls", "n", "fp", "bands"])

    ship(docs.sparkSession)
    fields = [StructField(name, LongType()) for name in ("cls", "n", "fp")]
    schema = StructType([*docs.select(key).schema.fields, *fields, StructField("bands", ArrayType(LongType()))])
    return docs.select(key, text_or_empty(text).alias("__t")).mapInArrow(lean(run), schema)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            parts = [shingles(t.as_py()) for t in batch.column(0)[at : at + 256]]
            cls = np.array([_class(h) for h in parts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cls), _lists([h.view(np.int64) for h in parts])], names=["cls", "hashes"])


def sets_of(classes: DataFrame, docs: DataFrame, reps: DataFrame, key: str, text: str) -> DataFrame:
    """cls and its set ``hashes``; ``reps`` has a document's key for each class.

    Texts are only cut into shingles again for classes that share a key.
    """
    needed = reps.join(classes, "cls").select("least").distinct()
    keys = cut(needed)
    texts = docs.select(key, text_or_empty(text).alias("__t"))
    some = texts.join(small_or_not(keys, keys.count(), 64), F.col(key).eqNullSafe(F.col("least")), "left_semi")
    return some.select("__t").mapInArrow(lean(_sets), "cls long, hashes array<long>").dropDuplicates(["cls"]).join(classes, "cls", "left_semi")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` whose similarity is ``LEAST`` or more; few classes are an ``a``."""
    pivots = pairs.select(F.col("a").alias("cls")).distinct()
    one = cut(sets.join(pivots, "cls", "left_semi").select(F.col("cls").alias("a"), F.col("hashes").alias("ha")))
    size = one.agg(F.coalesce(F.sum(F.size("ha") * 8 + 100), F.lit(0))).first()[0]
    two = sets.select(F.col("cls").alias("b"), F.col("hashes").alias("hb"))
    both = pairs.join(two, "b").join(small_or_not(one, 1, size), "a").where(F.least(F.size("ha"), F.size("hb")) * 100 >= round(LEAST * 100) * F.greatest(F.size("ha"), F.size("hb")))
    common = F.size(F.array_intersect("ha", "hb"))
    # c / (a + b - c) >= LEAST in whole numbers, so that a similarity of just LEAST counts
    return both.where(common * 100 >= round(LEAST * 100) * (F.size("ha") + F.size("hb") - common)).select("a", "b")


def block_links(rest: list[tuple[int, int, np.ndarray]], members: list[tuple[int, int, np.ndarray]]) -> list[tuple[int, int]]:
    """Links between the (class, root, set) of ``rest`` and of ``members`` whose roots differ.

    Each set of ``rest`` looks its shingles up in one sorted list of all members' shingles.
    """
    sizes = np.array([len(h) for _, _, h in members])
    every, owner = np.concatenate([h for _, _, h in members]), np.repeat(np.arange(len(members)), sizes)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    roots, out = np.array([r for _, r, _ in members]), []
    for cls, root, h in rest:
        low, high = np.searchsorted(every, h, "left"), np.searchsorted(every, h, "right")
        many = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        common = np.bincount(owner[at], minlength=len(members))
        good = (common * 100 >= round(LEAST * 100) * (len(h) + sizes - common)) & (roots != root)
        out += [(cls, members[i][0]) for i in np.flatnonzero(good)]
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (pivot, rc, mc, side, cls, root, hashes) in the order of their blocks; one block at a time is held."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(6)]
            hashes = batch.column(6)
            for i, row in enumerate(zip(*columns)):
                yield row, hashes[i].values.to_numpy(zero_copy_only=False).copy()

    for _, block in groupby(rows(), key=lambda r: r[0][:3]):
        sides = ([], [])
        for (_, _, _, side, cls, root), h in block:
            sides[side].append((cls, root, h))
        if sides[0] and sides[1]:
            found = block_links(*sides)
            yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in found], pa.int64()) for i in range(2)], names=["a", "b"])


def across(of: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between the components that meet around one pivot; ``of``: pivot, cls, n, root."""
    parts = of.groupBy("pivot", "root").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    # kept, as a tie must not be settled in two ways
    top = F.max(F.struct("c", "w", "root"))
    mixed = parts.groupBy("pivot").agg(F.count("*").alias("roots"), F.sum("c").alias("c"), F.sum("w").alias("w"), top.alias("top")).where("roots > 1")

    def chunks(count: Column, weight: Column) -> Column:
        return F.greatest(F.ceil(count / CHUNK), F.ceil(weight / CHUNK_SHINGLES), F.lit(1)).cast("int")

    mixed = cut(mixed.select("pivot", F.col("top.root").alias("most"), chunks(F.col("c"), F.col("w")).alias("mcs"), chunks(F.col("c") - F.col("top.c"), F.col("w") - F.col("top.w")).alias("rcs")))
    left = of.join(small_or_not(mixed, mixed.count(), 64), "pivot").join(sets, "cls")
    mine = F.pmod(F.xxhash64("cls"), F.col("mcs")).cast("int")
    own = F.pmod(F.xxhash64(F.lit(1), "cls"), F.col("rcs")).cast("int")
    rest = left.where("root <> most").select("pivot", own.alias("rc"), F.explode(F.sequence(F.lit(0), F.col("mcs") - 1)).alias("mc"), F.lit(0).alias("side"), "cls", "root", "hashes")
    members = left.select("pivot", F.explode(F.sequence(F.lit(0), F.col("rcs") - 1)).alias("rc"), mine.alias("mc"), F.lit(1).alias("side"), "cls", "root", "hashes")
    block = ["pivot", "rc", "mc"]  # two chunks at most
    return rest.union(members).repartition(*block).sortWithinPartitions(*block).mapInArrow(lean(_blocks), "a long, b long")


def links(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Edges (a, b) between classes whose components are those of all links; ``found`` are the signatures."""
    reps = found.groupBy("cls").agg(F.min(key).alias("least"))
    classes = cut(found.select("cls", "n", "fp", "bands").dropDuplicates(["cls"]))
    # classes with near fingerprints, by Golay keys
    first = cut(classes.groupBy("fp").agg(F.min("cls").alias("least")))
    prints = small_or_not(first, first.count(), 48)
    same = classes.select("fp", "cls").join(prints, "fp").select(F.col("least").alias("a"), F.col("cls").alias("b"))
    edges = near_fingerprints(first).distinct()
    for end in ("a", "b"):
        edges = edges.join(prints.select(F.col("fp").alias(end), F.col("least").alias(f"{end}_cls")), end)
    close = same.union(edges.select("a_cls", "b_cls")).where("a <> b")
    # classes that share a key of minima
    keys = classes.select("cls", "n", F.explode("bands").alias("key"))
    sizes = cut(keys.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"))
    shared = keys.join(small_or_not(sizes, sizes.count(), 48), "key").withColumn("degree", F.sum("members").over(Window.partitionBy("cls")))  # a class has few keys
    shared = cut(shared.select("key", "cls", "n", "degree"))
    pivots = cut(shared.groupBy("key").agg(F.max(F.struct("degree", "cls"))["cls"].alias("pivot")))
    stars = cut(shared.join(small_or_not(pivots, pivots.count(), 48), "key").select("pivot", "cls", "n").distinct())
    pairs = cut(stars.select(F.col("pivot").alias("a"), F.col("cls").alias("b")).where("a <> b").union(close).distinct())
    needed = cut(pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct())
    sets = cut(sets_of(needed, docs, reps, key, text))
    near = cut(verified(pairs, sets))
    # what is still apart around one pivot
    roots = components(near)
    of = stars.join(small_or_not(roots, roots.count(), 32), stars["cls"] == roots["node"], "left").select("pivot", "cls", "n", F.coalesce("root", "cls").alias("root"))
    return near.union(across(cut(of), sets))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and ``component_id``, the smallest key that is reachable, for each row of ``docs``."""
    found = cut(signatures(docs, key, text))
    roots = components(links(docs, found, key, text))
    nodes = found.groupBy("cls").agg(F.min(key).alias("least"))
    of = cut(nodes.join(roots, nodes["cls"] == roots["node"], "left").select("cls", "least", F.coalesce("root", "cls").alias("root")))
    # a root or a class may hold a third of all rows, so these joins leave rows where they are as long as they can
    n = of.count()
    smallest = of.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut(of.join(small_or_not(smallest, n, 48), "root").select("cls", "component_id"))
    return found.select(key, "cls").join(small_or_not(named, n, 48), "cls").select(key, "component_id")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows whose key is not the smallest of their component; a null key stays."""
    found = near_duplicates(docs, key, text)
    return without(docs, found.where(F.col(key) != F.col("component_id")), key)
