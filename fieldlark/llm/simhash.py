"""Near-duplicate detection by SimHash fingerprints and Golay-code fuzzy keys.

Fingerprints of 64 bits link at two or fewer differing bits.  Only distinct
fingerprints are compared, so copies cost nothing.

Candidate keys.  The 64 bits are three segments of 22, 21 and 21 bits.  Two errors
over three segments leave one segment without an error, and the next segment has
two at most.  So for each segment a key joins its exact bits with a Golay codeword
near to the next segment: the codewords of the perfect (23, 12) code within four
bits of a word are one or six, and two words at distance two or less always share
one.  A fingerprint has about sixteen keys, and no link is missed.

Verification.  Fingerprints that share a key are compared in full within the
key's bucket if it has ``BUCKET`` members or fewer, and a spanning forest of the
links is kept, never all pairs.  Members of larger buckets go another exact
way, linear in their number: fingerprints link if and only if one value lies
within one bit of both, so each of them is grouped under the 65 values within one
bit; such a group has 65 members at most, all of which link to each other.

Defined cases: null text is empty and has fingerprint zero, like a text without
words, and links like any other; rows that repeat are kept; a null doc_id
never is the smallest; an empty table gives no rows; very long texts are read whole, in
blocks of shingles; extra columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..shipping import ship
from .common import cut, text_or_empty, without
from .components import components

SEED = 42
WORDS = 3
BUCKET = 256
#: (shift, bits) of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the binary Golay code of length 23 (fixed value): x^11+x^10+x^6+x^5+x^4+x^2+1.
GOLAY = 0b110001110101
_BLOCK = 1 << 16


def shingle_hashes(text: str, words: int = WORDS) -> np.ndarray:
    """XXH64 of each shingle of one whole text in its order, repeats included; empty without words."""
    tokens = text.encode("utf-8", "replace").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    size = min(words, len(tokens))
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return np.fromiter((digest(join(r), SEED) for r in zip(*(tokens[i:] for i in range(size)))), np.uint64, len(tokens) - size + 1)


def majority(hashes: np.ndarray) -> int:
    """The unsigned number whose bits are those set in over half of ``hashes``; zero for none."""
    count = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        part = np.ascontiguousarray(hashes[at : at + _BLOCK], "<u8")
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(count * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str, words: int = WORDS) -> int:
    """Unsigned fingerprint of one whole text."""
    return majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, keys: list[str], text: str = "text", words: int = WORDS) -> DataFrame:
    """keys and ``fp``, the fingerprint as a signed long, one row for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), words) for t in batch.column(batch.num_columns - 1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps.view(np.int64))], names=[*keys, "fp"])

    ship(docs.sparkSession)
    schema = StructType([*docs.select(*keys).schema.fields, StructField("fp", LongType())])
    return docs.select(*keys, text_or_empty(text).alias("__t")).mapInArrow(run, schema)


def _syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit polynomials by the generator."""
    rest = words.astype(np.int64)
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GOLAY << (bit - 11)), rest)
    return rest


@cache
def near_offsets() -> np.ndarray:
    """By syndrome, the up to six vectors of weight four or less that lead to a codeword; -1 fills."""
    vectors = np.array([sum(1 << b for b in c) for w in range(5) for c in combinations(range(23), w)], dtype=np.int64)
    table, used = np.full((1 << 11, 6), -1, np.int64), np.zeros(1 << 11, np.int64)
    for v, s in zip(vectors, _syndrome(vectors)):
        table[s, used[s]] = v
        used[s] += 1
    return table


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row number) pairs of unsigned 64-bit fingerprints."""
    keys, rows, table = [], [], near_offsets()
    for s in range(3):
        (shift, bits), (shift2, bits2) = SEGMENTS[s], SEGMENTS[(s + 1) % 3]
        exact = ((fps >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64)
        word = ((fps >> np.uint64(shift2)) & np.uint64((1 << bits2) - 1)).astype(np.int64)
        offset = table[_syndrome(word)]
        row, col = np.nonzero(offset >= 0)
        keys.append(s << 45 | exact[row] << 23 | (word[row] ^ offset[row, col]))
        rows.append(row)
    return np.concatenate(keys), np.concatenate(rows)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        keys, rows = fuzzy_keys(fps.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[rows])], names=["key", "fp"])


def forest(fps: np.ndarray, bits: int = 2) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among a few fingerprints."""
    links = np.argwhere(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= bits, 1))
    root, out = list(range(len(fps))), []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in links.tolist():
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = [], []
        for group in batch.column(0):
            fps = np.array(group.as_py(), dtype=np.int64)
            for i, j in forest(fps.view(np.uint64)):
                a.append(fps[i])
                b.append(fps[j])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def links(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` whose components are those of all links."""
    keys = distinct.select("fp").mapInArrow(_keys, "key long, fp long")
    sizes = keys.groupBy("key").agg(F.count("*").alias("n"))
    shared = keys.join(sizes.where("n > 1"), "key")
    few = shared.where(F.col("n") <= bucket).groupBy("key").agg(F.collect_list("fp").alias("fps"))
    near = few.select("fps").mapInArrow(_verify, "a long, b long")
    many = shared.where(F.col("n") > bucket).select("fp").distinct()
    flips = F.concat(F.array(F.lit(0).cast("long")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    around = many.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"))
    stars = around.groupBy("mid").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    return near.union(stars.select("a", F.explode("fps").alias("b")).where("a <> b"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """key, ``fp`` and ``component_id``, the smallest key that is reachable, for each row of ``docs``."""
    fps = cut(fingerprints(docs, [key], text, words))
    nodes = cut(fps.groupBy("fp").agg(F.min(key).alias("least")))
    roots = components(links(nodes))
    of = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    named = of.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select(key, "fp", "component_id")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows whose key is not the smallest of their component; a null key stays."""
    found = near_duplicates(docs, key, text)
    return without(docs, found.where(F.col(key) != F.col("component_id")), key)
