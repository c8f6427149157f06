"""Token counts by two tiers of lookup on the map side.

The library drops white space, so the count of a text is the sum of the counts
of its pieces between white space.  A piece is looked up first in a compact
table of frequent pieces, broadcast to all workers, then in the worker's own
cache; only what both miss is encoded, in batches.  Pieces are never shuffled.

The table comes from the first ``SAMPLE`` rows of the first partition and holds ``TABLE``
pieces at most: it is a cache whose content cannot change a result.

Texts that the shortcut might treat unlike the library (special tokens' strings,
characters outside the Latin blocks and common punctuation, control characters
that only one side takes for white space) are encoded whole by the library.

Defined cases: null text is empty; an empty text has 0 bytes and 0 tokens; rows
that repeat are counted each; extra columns are not looked at.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import PLAIN, text_or_empty

SAMPLE = 4000
TABLE = 150_000
#: Pieces a worker remembers before it starts anew.
CACHE = 700_000
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _special(tok) -> tuple[str, ...]:
    return tuple(t.content for t in tok.get_added_tokens_decoder().values())


@cache
def _worker(path: str) -> tuple:
    """The library and the cache of one worker process, which serves many tasks."""
    tok = _library(path)
    return tok, _special(tok), {}


def frequent(docs: DataFrame, text: str, path: str, sample: int = SAMPLE, table: int = TABLE) -> dict[str, int]:
    """Lengths of the most frequent pieces of the first partition's first rows; only as many partitions run as it takes to find a row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        rows = 0
        for batch in batches:
            for t in batch.column(0):
                rows += 1
                if rows <= sample and PLAIN.fullmatch(v := t.as_py()):
                    seen.update(v.split())
        if rows:
            top = [p for p, n in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:table] if len(p) < 64]
            sizes = [len(e.ids) for e in _worker(path)[0].encode_batch_fast(top, add_special_tokens=False)] if top else []
            yield pa.RecordBatch.from_arrays([pa.array([top], pa.list_(pa.string())), pa.array([sizes], pa.list_(pa.int32()))], names=["piece", "n"])

    found = docs.select(text_or_empty(text).alias("t")).mapInArrow(count, "piece array<string>, n array<int>").head(1)
    return dict(zip(found[0][0], found[0][1])) if found else {}


def count_tokens(docs: DataFrame, keys: list[str], text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """keys, n_bytes and n_tokens, one row for each row of ``docs``."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(frequent(docs, text, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, (tok, special, own) = shared.value, _worker(path)
        for batch in batches:
            column, counts = batch.column(batch.num_columns - 1), []
            for t in column:
                v = t.as_py()
                if not PLAIN.fullmatch(v) or ("<|" in v and any(s in v for s in special)):
                    counts.append(len(tok.encode(v, add_special_tokens=False).ids))
                    continue
                pieces = v.split()
                if len(own) > CACHE:
                    own.clear()
                new = [p for p in set(pieces) if p not in own]
                missed = [p for p in new if p not in first]
                own.update((p, first[p]) for p in new if p in first)
                if missed:
                    own.update(zip(missed, (len(e.ids) for e in tok.encode_batch_fast(missed, add_special_tokens=False))))
                counts.append(sum(map(own.__getitem__, pieces)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], names=[*keys, "n_bytes", "n_tokens"])

    from pyspark.sql.types import LongType, StructField, StructType

    given = docs.select(*keys, F.octet_length(text_or_empty(text)).cast("long").alias("n_bytes"))
    schema = StructType([*given.schema.fields, StructField("n_tokens", LongType())])
    return docs.select(*keys, F.octet_length(text_or_empty(text)).cast("long").alias("n_bytes"), text_or_empty(text).alias("__t")).mapInArrow(run, schema)
