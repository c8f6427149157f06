"""Best-fit packing of token sequences by bulk-synchronous steps.

Documents become pieces of ``SIZE`` tokens at most; only the first piece of a long
document may be shorter.  Lengths and gaps are integers up to ``SIZE``, so the range
sort puts each into one of ``SIZE`` classes, whose counts are all that the steps need.

A step takes one class of pieces, from the longest down.  It sweeps to the successor
among the gap classes (the smallest gap that fits), pieces and gaps of the two classes
are matched by rank, the gaps shrink, and the sweep repeats until the class is used up
or new sequences must be opened.  The outcome is best-fit decreasing, exactly.

The sweeps themselves run on the driver: ``plan`` takes the counts of the classes and decides for ranges of
equal pieces at once.  What the driver holds is bounded by ``SIZE``, not by the corpus: counts by class, and
ranges of equal sequences.  The pieces stay distributed; a piece's rank in its class
comes from its rank in one of many salted groups and the counts of the groups before,
so a class that holds a third of all pieces is spread over all tasks.

Defined cases: null text is empty; an empty document is one piece, its end token;
documents that repeat are packed each; an empty table gives no rows; very long texts are encoded whole and cut into
pieces, of which the first may be shorter; pieces of one length are ranked by salt and then by their columns, and pieces equal in
all of them may change places; extra columns of the documents are not looked at, whatever their names.
"""

from __future__ import annotations

import base64
import bisect
import os
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .common import PLAIN, cut, lean, text_or_empty

SIZE = 1024
END = 2
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: The same vocabulary as ranks of byte strings.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Salted groups of a length class: so many, or one for every ``SALT_ROWS`` pieces if that is more.
SALTS = 64
SALT_ROWS = 1_000_000
_BLANK = re.compile(r"\s{64}")


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit integers.

    The ids are those of the tokenizers library.  Texts of Latin letters and common
    punctuation, without very long words and runs of white space, go through tiktoken, which
    gives the same ids from the same vocabulary at a third of the cost; all others, and
    those with a special token's string, go to the library.
    """

    def __init__(self, path: str = VOCABULARY, ranks: str = RANKS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = tuple(t.content for t in self.tok.get_added_tokens_decoder().values())
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if not PLAIN.fullmatch(text) or _BLANK.search(text) or max(map(len, text.split()), default=0) > 1000 or any(s in text for s in self.special):
            return self.whole(text)
        return np.asarray(self.fast.encode_to_numpy(text), "<u4").tobytes()


@cache
def encoder(path: str, ranks: str) -> Encoder:
    """One for each worker process, which serves many tasks."""
    return Encoder(path, ranks)


def cuts(total: int, size: int = SIZE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``total`` tokens."""
    first = total % size or size
    return [(0, min(first, total))] + [(at, size) for at in range(first, total, size)]


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY, ranks: str = RANKS, size: int = SIZE, end: int = END) -> DataFrame:
    """key, piece, start, length and ids_crc32 of every piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, tail = encoder(path, ranks), np.array([end], "<u4").tobytes()
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, t in enumerate(batch.column(1)):
                ids = enc.ids(t.as_py()) + tail
                for k, (s, n) in enumerate(cuts(len(ids) // 4, size)):
                    row.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(ids[4 * s : 4 * (s + n)]))
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "piece", "start", "length", "ids_crc32"])

    ship(docs.sparkSession)
    kind = docs.select(key).schema[0].dataType.simpleString()
    return docs.select(key, text_or_empty(text).alias("__t")).mapInArrow(lean(run), f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over classes: (length, from rank, to rank, first sequence, pieces a sequence, offset).

    Ranks from..to of a length fill sequences from the first on, so many each, from the offset on.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> ranges (first sequence, how many)
    order: list[int] = []  # gaps that occur, sorted
    out: list[tuple[int, int, int, int, int, int]] = []
    opened = 0

    def leave(gap: int, first: int, many: int) -> None:
        if gap and many:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(order, gap)
            gaps[gap].append((first, many))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(order, length)
            if at < len(order):
                gap = order[at]
                first, many = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    order.pop(at)
            else:
                gap, first, many = size, opened, -(-left // (size // length))
                opened += many
            each = gap // length
            full = min(many, left // each)
            used, rest = full * each, 0
            if full < many and left > used:
                rest = left - used
            taken = used + rest
            out.append((length, rank, rank + taken, first, each, size - gap))
            leave(gap - each * length, first, full)
            if rest:
                leave(gap - rest * length, first + full, 1)
            leave(gap, first + full + bool(rest), many - full - bool(rest))
            rank += taken
            left -= taken
    return out


def pack(parts: DataFrame, keys: list[str], size: int = SIZE, salts: int | None = None) -> DataFrame:
    """``parts`` with sequence_id and offset.  ``keys`` name the pieces; pieces equal in all columns may change places."""
    spark = parts.sparkSession
    parts = cut(parts)
    salts = salts or max(SALTS, parts.count() // SALT_ROWS)
    salted = parts.withColumn("__salt", F.pmod(F.xxhash64(*keys), F.lit(salts)))
    groups = cut(salted.groupBy("length", "__salt").agg(F.count("*").alias("__n")))
    counts = {r[0]: r[1] for r in groups.groupBy("length").agg(F.sum("__n")).collect()}  # ``size`` rows at most
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = groups.select("length", "__salt", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    own = Window.partitionBy("length", "__salt").orderBy(*parts.columns)
    ranked = salted.withColumn("__own", F.row_number().over(own)).join(offsets, ["length", "__salt"])
    ranked = ranked.withColumn("__rank", F.col("__before") + F.col("__own") - 1)
    steps = plan(counts, size)  # a few for each of ``size`` classes
    schema = "__len long, __from long, __to long, __first long, __each long, __at long"
    table = spark.createDataFrame(steps, schema)
    cond = [ranked["length"] == table["__len"], F.col("__rank") >= F.col("__from"), F.col("__rank") < F.col("__to")]
    joined = ranked.join(F.broadcast(table), cond)
    place = F.col("__rank") - F.col("__from")
    return joined.select(
        *(parts[c] for c in parts.columns),
        (F.col("__first") + F.floor(place / F.col("__each"))).cast("long").alias("sequence_id"),
        (F.col("__at") + (place % F.col("__each")) * ranked["length"]).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    return pack(pieces(docs, key, text, path), [key, "piece", "start", "ids_crc32"])
