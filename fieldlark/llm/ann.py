"""Nearest neighbours by additive quantisation.

A vector is the sum of one codeword from each of ``BOOKS`` codebooks, which all have the
full dimension.  Codebooks start as k-means of the residuals of a bounded sample and are
then refined together by least squares; codes come from a beam search.  The index
holds codes and the norm of each sum.  Queries come in blocks of bounded size: tables of
inner products are looked up by code for every vector, each task returns one list for each query with its
best ``RERANK``, and the best of all lists are ranked exactly, in double
precision, on the original vectors.

Equal vectors are one class with its smallest ids, as many as a result can hold, so a
third of all rows in one vector neither crowds out others nor loads one task.

The codes of all vectors are scanned for each block of queries: random vectors of many dimensions have
no cells to prune by, and a pass over the codes, 28 bytes a vector, keeps all executors busy whatever the
number of blocks.  Only the sample (``SAMPLE`` vectors at most) and one block of queries at a time
(``BLOCK``) reach the driver; every vector is indexed.  A block's result is written to the
shared folder, so neither the plan nor the lineage grows with the queries.

Defined cases: vectors that are null, empty, zero, or hold a null, a NaN or an infinity take
no part, nor do those whose dimension is not the commonest of the sample; a null id
takes no part; equal distances go to the smaller id; a row that repeats counts once, as a query and as a
candidate; an id on several vectors is a query and a candidate for each of them, but never
a candidate for a query of its own id; a table without queries, or an empty one, gives no rows;
extra columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .common import cut, new_folder

BOOKS = 24
WORDS = 256
SAMPLE = 8192
BEAM = 4
RERANK = 256
BLOCK = 2048
#: Groups of tasks whose lists are merged first.
MERGES = 64
TOP = 10


def usable(vec: Column) -> Column:
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(vec) > 0) & fine & F.exists(vec, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _assign(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    half = 0.5 * (words * words).sum(1)
    return np.concatenate([np.argmax(x[i : i + 4096] @ words.T - half, 1) for i in range(0, len(x), 4096)])


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes by beam search: after each codebook the ``beam`` sums nearest to the vector live on."""
    n, (m, k, d) = len(x), books.shape
    codes, rest = np.zeros((n, 1, 0), np.uint8), x[:, None, :].astype(np.float32)
    for book in books:
        norms = (book * book).sum(1)
        b = rest.shape[1]
        error = (rest * rest).sum(2)[:, :, None] - 2 * (rest.reshape(-1, d) @ book.T).reshape(n, b, -1) + norms
        error = error.reshape(n, -1)
        keep = min(beam, error.shape[1])
        best = np.argpartition(error, keep - 1, 1)[:, :keep]
        parent, word = best // len(book), best % len(book)
        rows = np.arange(n)[:, None]
        rest = rest[rows, parent] - book[word]
        codes = np.concatenate([codes[rows, parent], word[:, :, None].astype(np.uint8)], 2)
    return codes[np.arange(n), np.argmin((rest * rest).sum(2), 1)]


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(book[codes[:, i]] for i, book in enumerate(books))


def train(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 6, solves: int = 2, sweeps: int = 3, seed: int = 7) -> np.ndarray:
    """Codebooks of shape (books, words, dimension)."""
    rng, x = np.random.default_rng(seed), x.astype(np.float32)
    k, rest, out = min(words, len(x)), x.copy(), []
    for _ in range(books):
        c = rest[rng.choice(len(rest), k, replace=False)].copy()
        for _ in range(rounds):
            a = _assign(rest, c)
            n = np.bincount(a, minlength=k)
            total = np.zeros_like(c)
            np.add.at(total, a, rest)
            c[n > 0] = total[n > 0] / n[n > 0, None]
        rest = rest - c[_assign(rest, c)]
        out.append(c)
    found = np.stack(out)
    for _ in range(solves):
        codes = np.concatenate([encode(x[i : i + 2048], found) for i in range(0, len(x), 2048)]).astype(np.int64)
        rest = x - decode(codes, found)
        for _ in range(sweeps):  # Gauss-Seidel on the joint least squares problem, a codebook at a time
            for i in range(books):
                part = codes[:, i]
                n = np.bincount(part, minlength=k)[:, None]
                total = np.zeros_like(found[i])
                np.add.at(total, part, rest)
                step = total / np.maximum(n, 1)
                rest -= step[part]
                found[i] += step
    return found


def classes(vectors: DataFrame, key: str, vec: str, top: int) -> DataFrame:
    """Class id (``cid``, its smallest key, and ``nth``, which tells vectors of one smallest key apart), vec, and the ``top + 1`` smallest keys of each distinct vector."""
    rows = vectors.select(F.col(key).cast("long").alias("__key"), F.col(vec).alias("__vec")).where(F.col("__key").isNotNull() & usable(F.col("__vec"))).distinct()
    rank = F.row_number().over(Window.partitionBy("__vec").orderBy("__key"))
    few = rows.withColumn("__r", rank).where(F.col("__r") <= top + 1)
    each = few.groupBy("__vec").agg(F.array_sort(F.collect_list("__key")).alias("ids")).select(F.col("ids")[0].alias("cid"), F.col("__vec").alias("vec"), "ids")
    return each.withColumn("nth", F.row_number().over(Window.partitionBy("cid").orderBy("vec")).cast("int"))


def _encoder(books):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = books.value
        for batch in batches:
            codes, norms = [], []
            for i in range(0, batch.num_rows, 2048):
                part = encode(_matrix(batch.column(1).slice(i, 2048)), c)
                y = decode(part, c).astype(np.float64)
                codes += [r.tobytes() for r in part]
                norms.append((y * y).sum(1))
            norm = np.concatenate(norms) if norms else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(codes, pa.binary()), pa.array(norm.astype(np.float32), pa.float32())], names=["cid", "nth", "codes", "norm"])

    return run


def _searcher(books, block, rerank: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, q = books.value, block.value.astype(np.float32)
        tables = np.stack([q @ b.T for b in c], 1)  # queries, books, words
        best = np.full((len(q), rerank), np.inf, np.float32)
        ids, nths = np.zeros((len(q), rerank), np.int64), np.zeros((len(q), rerank), np.int32)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                cid, nth = (part.column(i).to_numpy(zero_copy_only=False) for i in range(2))
                code = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(len(cid), -1)
                norm = part.column(3).to_numpy(zero_copy_only=False)
                for lo in range(0, len(q), 256):
                    t = tables[lo : lo + 256]
                    s = np.broadcast_to(norm, (len(t), len(cid))).copy()
                    for m in range(code.shape[1]):
                        s -= 2 * t[:, m, :][:, code[:, m]]
                    every = np.concatenate([best[lo : lo + 256], s], 1)
                    take = np.argpartition(every, rerank - 1, 1)[:, :rerank]
                    rows = np.arange(len(t))[:, None]
                    for kept, new in ((ids, cid), (nths, nth)):
                        kept[lo : lo + 256] = np.concatenate([kept[lo : lo + 256], np.broadcast_to(new, (len(t), len(cid)))], 1)[rows, take]
                    best[lo : lo + 256] = every[rows, take]
        fine = np.isfinite(best)
        offsets = np.concatenate([[0], np.cumsum(fine.sum(1))]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(best[fine]), pa.array(ids[fine]), pa.array(nths[fine])], names=["approx", "cid", "nth"]))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(q), dtype=np.int32)), lists], names=["q", "best"])

    return run


def search(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vec: str = "embedding", top: int = TOP, rerank: int = RERANK, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """query_id, rank, ``key`` and score (Euclidean distance) of the ``top`` nearest found for each query but itself."""
    spark = vectors.sparkSession
    ship(spark)
    out_schema = f"query_id long, rank int, {key} long, score double"
    every = cut(classes(vectors, key, vec, top))
    taken = every.select("vec", F.xxhash64("vec").alias("h")).orderBy("h").limit(sample).toPandas()["vec"]
    asked = queries.select(F.col(key).cast("long").alias("id"), F.col(vec).alias("vec")).where(F.col("id").isNotNull() & usable(F.col("vec"))).distinct()
    if not len(taken):
        return spark.createDataFrame([], out_schema)
    dim = int(np.bincount([len(v) for v in taken]).argmax())
    every, asked = every.where(F.size("vec") == dim), cut(asked.where(F.size("vec") == dim))
    books = spark.sparkContext.broadcast(train(np.stack([np.asarray(v, np.float32) for v in taken if len(v) == dim])))
    codes = cut(every.select("cid", F.col("vec").cast("array<float>").alias("vec"), "nth").mapInArrow(_encoder(books), "cid long, nth int, codes binary, norm float"))
    stream, folder, blocks = asked.toLocalIterator(), new_folder(spark, "ann"), 0
    while rows := list(islice(stream, block)):
        ids, q = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64)
        shared = spark.sparkContext.broadcast(q)
        near = codes.mapInArrow(_searcher(books, shared, rerank), "q int, best array<struct<approx:float,cid:long,nth:int>>")
        # a list from each task; merged in two steps, so that no merge meets all tasks' lists
        merged = F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, rerank).alias("best")
        some = near.groupBy("q", F.pmod(F.spark_partition_id(), F.lit(MERGES)).alias("m")).agg(merged)
        chosen = some.groupBy("q").agg(merged).select("q", F.inline("best")).select("q", "cid", "nth")
        # BLOCK times RERANK rows of three numbers: bounded by parameters
        pairs = every.join(F.broadcast(chosen), ["cid", "nth"]).select("q", "ids", F.col("vec").cast("array<double>").alias("vec"))
        _exact(pairs, spark.sparkContext.broadcast((ids, q)), top).withColumn("block", F.lit(blocks)).write.parquet(f"{folder}/{blocks}")
        shared.unpersist()
        blocks += 1
    if not blocks:
        return spark.createDataFrame([], out_schema)
    found = spark.read.option("recursiveFileLookup", "true").schema("query_id long, q int, id long, score double, block int").parquet(folder)
    order = Window.partitionBy("block", "q").orderBy("score", "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score")


def _exact(pairs: DataFrame, queries, top: int) -> DataFrame:
    """query_id, q (the query's number in its block), id and exact score of the best, ids of a class expanded and the query's own left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = queries.value
        for batch in batches:
            q = batch.column(0).to_numpy(zero_copy_only=False)
            score = np.zeros(0)
            if len(q):
                score = np.sqrt(((vectors[q] - _matrix(batch.column(2))) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), batch.column(0), batch.column(1), pa.array(score, pa.float64())], names=["query_id", "q", "ids", "score"])

    scored = pairs.mapInArrow(run, "query_id long, q int, ids array<long>, score double")
    rows = scored.select("query_id", "q", F.explode("ids").alias("id"), "score").where("id <> query_id")
    best = Window.partitionBy("q").orderBy("score", "id")
    return rows.withColumn("r", F.row_number().over(best)).where(F.col("r") <= top).drop("r")
