"""The corpus pipeline: five stages over whole documents, each reading what the one before it wrote.

quality        drops the documents that the classifier rejects
near_dedup     keeps the document with the smallest id of each near-duplicate component: SimHash with Golay keys, and
               minima beyond two bits, verified at a Jaccard similarity of 0.8 on five-word shingles
decontaminate  drops the documents that hold a benchmark item
secrets        replaces each secret by its kind in brackets
packing        packs the token sequences; its rows are the pipeline's result

A stage keeps null ids and repeated rows unless it rejects them by their text.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlark.llm import blob_ledger, decontamination, jaccard, packing, quality
from fieldlark.llm.common import free_name, new_folder, read, shared_folder


#: Settings of the session: the folder of a ledger of secrets to go on with (a new one otherwise), and the id of a run to go on with.
LEDGER, RUN = "spark.corpus.ledger", "spark.corpus.run"


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").where(~quality.held_out())
    weights = quality.fit(docs, labels)
    score = free_name(docs, "__score")
    return quality.score(docs, weights, keep=docs.columns, out=score).where(F.col(score) >= 0.5).drop(score)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ledger = blob_ledger.run(docs, spark.conf.get(LEDGER, None) or new_folder(spark, "ledger"))
    return blob_ledger.redact(docs, ledger=ledger)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("quality", keep_good), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("secrets", secrets), ("packing", pack)]
#: Fingerprints, training and tokenization are not SQL; the tests compare with brute force.
ORACLE_SQL = None


def _done(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str, run_id: str | None = None) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read again.

    A run with a ``run_id`` (or the setting ``RUN``) takes up where an earlier one with the same id over the
    same directory broke off: stages whose table is complete are not run again.  Without one every run is new.
    A stage's table is removed as soon as the next but one is complete.
    """
    run_id = run_id or spark.conf.get(RUN, None)
    name = f"pipeline-{hashlib.sha256(f'{run_id}:{sf_dir}'.encode()).hexdigest()[:16]}" if run_id else None
    base = f"{shared_folder(spark).rstrip('/')}/{name}" if name else new_folder(spark, "pipeline")
    tables = [f"{base}/{i}-{stage}" for i, (stage, _) in enumerate(STAGES)]
    last = max((i for i, table in enumerate(tables) if _done(spark, table)), default=-1)
    docs = spark.read.parquet(tables[last]) if last >= 0 else read(spark, sf_dir, "documents")
    for i in range(last + 1, len(STAGES)):
        STAGES[i][1](spark, docs, sf_dir).write.mode("overwrite").parquet(tables[i])
        docs = spark.read.parquet(tables[i])
        if i >= 2:
            _remove(spark, tables[i - 2])
    return docs
