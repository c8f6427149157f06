"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

Features of a text are the hashed n-grams of its tokens, each counted once:
words (1- and 2-grams), word shapes (1- to 3-grams) and the share of bigrams, and of
skip-bigrams, that repeat a word, in steps.  A score is the logistic function of a sparse dot product with
the weights, divided by the root of the number of features.

Training reads a bounded sample: ``max_rows`` labels at most, the first
by a hash of their id, with one text for each, and of them as many as have ``max_features`` features
together.  Texts of one id are reduced before they move, so a label whose id half of
all documents have sends one.  One task keeps the sample's features, so its memory is bounded by
these two parameters, whatever the size of the corpus.  The model is ``2**BITS``
floats; it reaches the scoring tasks as a broadcast of that fixed size.

Defined cases: null and empty texts have one constant feature and so get a score
like every other; labels that are null take no part; without labelled rows every
score is 0.5; repeated rows are scored each; an id with several labels is trained
on each of them, an id with several texts on the one with the least hash; words are read whole, whatever
their length; extra columns are not looked at, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..shipping import ship
from .common import cut, lean, small_or_not, text_or_empty

BITS = 18
MASK = np.uint32((1 << BITS) - 1)
MAX_ROWS = 6000
MAX_FEATURES = 12_000_000
#: Distinct words a worker remembers before it starts anew.
CACHE = 120_000
#: As many repeats as a short text has by chance do not count.
CHANCE = 2
#: Shares of words equal to the last, or the last but one; each that is reached is a feature.
REPEATS = (0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.5)
_WORDS = re.compile(r"\n|[^\s]+")


def _shape(word: str) -> int:
    """Hash of a word's shape: runs of capitals, letters, digits and the signs themselves."""
    out = []
    for c in word:
        k = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if not out or out[-1] != k:
            out.append(k)
    return zlib.crc32(("s:" + "".join(out)).encode("utf-8", "replace"))


class Features:
    """Turns texts into sorted, distinct feature indices; remembers hashes of words."""

    def __init__(self) -> None:
        self.words: dict[str, int] = {}  # two hashes in one number: of the word and of its shape

    def of(self, text: str) -> np.ndarray:
        tokens = _WORDS.findall(text)
        known = self.words
        for w in set(tokens).difference(known):
            known[w] = zlib.crc32(w.lower().encode("utf-8", "replace")) << 32 | _shape(w)
        if not tokens:
            return np.zeros(1, np.uint32)
        pairs = np.array([known[w] for w in tokens], dtype=np.uint64)
        if len(known) > CACHE:
            known.clear()
        w, s = (pairs >> np.uint64(32)).astype(np.uint32), pairs.astype(np.uint32)
        mix = np.uint32(0x9E3779B1)
        with np.errstate(over="ignore"):
            s2 = s[1:] * mix + s[:-1]
            got = [np.zeros(1, np.uint32), w, s, w[1:] * mix + w[:-1], s2, s2[1:] * mix + s[:-2]]
        for lag in (1, 2):
            if len(w) > lag:
                share = (np.count_nonzero(w[lag:] == w[:-lag]) - CHANCE) / len(w)
                level = int(np.searchsorted(REPEATS, share, "right"))
                got.append(np.arange(level, dtype=np.uint32) + np.uint32(7_777_777 * lag))
        all_ = np.concatenate(got)
        all_ ^= all_ >> np.uint32(15)
        seen = np.zeros(int(MASK) + 1, bool) if len(all_) > 20_000 else None
        if seen is None:
            return np.unique(all_ & MASK)
        seen[all_ & MASK] = True
        return np.flatnonzero(seen).astype(np.uint32)


def ftrl(rows: list[tuple[np.ndarray, int]], updates: int = 24_000, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5) -> np.ndarray:
    """Weights after FTRL-proximal updates, in the order given, over 4 to 30 epochs that make about ``updates``."""
    epochs = min(30, max(4, updates // len(rows)))
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(at: np.ndarray | slice) -> np.ndarray:
        zz = z[at]
        w = -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(zz) <= l1, 0.0, w)

    for _ in range(epochs):
        for idx, label in rows:
            scale = 1 / np.sqrt(len(idx))
            w = weights(idx)
            p = 1 / (1 + np.exp(-np.clip(w.sum() * scale, -30, 30)))
            g = (p - label) * scale
            sigma = (np.sqrt(n[idx] + g * g) - np.sqrt(n[idx])) / alpha
            z[idx] += g - sigma * w
            n[idx] += g * g
    return weights(slice(None)).astype(np.float32)


def _trainer(max_features: int):
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, total, make = [], 0, Features()
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1)):
                if total > max_features:
                    continue
                idx = make.of(text.as_py())
                total += len(idx)
                rows.append((idx, label.as_py()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([ftrl(rows).tobytes()], pa.binary())], names=["weights"])

    return train


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES) -> np.ndarray | None:
    """Weights of a model for ``label``; None without labelled rows.  ``labels`` must hold none of the rows held out."""
    chosen = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("__k"), F.col(label).cast("int").alias("__y")).orderBy(F.xxhash64("__k"), "__k", "__y").limit(max_rows)
    chosen = cut(chosen)
    ship(docs.sparkSession)
    texts = docs.select(F.col(key).alias("__d"), text_or_empty(text).alias("__t"))
    asked = chosen.select("__k").distinct()
    mine = texts.join(small_or_not(asked, max_rows, 64), F.col("__d") == F.col("__k"), "left_semi").withColumn("__h", F.xxhash64("__t"))
    # one text for each id: partial aggregation leaves one in each task; equal hashes go to the lesser text
    one = mine.groupBy("__d").agg(F.min(F.struct("__h", "__t"))["__t"].alias("__t"))
    rows = one.join(small_or_not(chosen, max_rows, 64), F.col("__d") == F.col("__k"))
    ordered = rows.repartition(1).sortWithinPartitions(F.xxhash64("__k"), "__k", "__y")
    got = ordered.select("__t", "__y").mapInArrow(lean(_trainer(max_features)), "weights binary").collect()
    return np.frombuffer(bytes(got[0][0]), np.float32) if got else None


def score(docs: DataFrame, weights: np.ndarray | None, text: str = "text", keep: list[str] | None = None, out: str = "score") -> DataFrame:
    """Columns ``keep`` and ``out``, the score, one row for each row of ``docs``."""
    keep = keep if keep is not None else docs.columns
    sent = keep if text in keep else [*keep, text]
    at = sent.index(text)
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights if weights is not None else np.zeros(1 << BITS, np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, make = shared.value.astype(np.float64), Features()
        for batch in batches:
            total = np.empty(batch.num_rows)
            for i, t in enumerate(batch.column(at)):
                idx = make.of(t.as_py() or "")
                total[i] = w[idx].sum() / np.sqrt(len(idx))
            scores = pa.array(1 / (1 + np.exp(-np.clip(total, -30, 30))), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], scores], names=[*keep, out])

    schema = StructType([*docs.select(*keep).schema.fields, StructField(out, DoubleType())])
    return docs.select(*sent).mapInArrow(lean(run), schema)


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))
