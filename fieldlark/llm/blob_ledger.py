"""Secret scans over an incremental ledger of content-addressed blobs.

Every version of every path is addressed by the SHA-256 of its text.  Equal
versions are one blob.  A ledger row (blob_id, rule, version, spans) says that
a rule of that version has seen a blob; a run scans only the pairs of blob and
rule version that the ledger lacks, and joins the findings, old and new, back
to all paths.

``run`` is one increment: it scans what a stored ledger lacks and appends to it.  The ledger is a Parquet
folder in shared storage; an increment that fails leaves it as it was, and the next one
scans what is still unseen.

Shuffles: the ids come first; the text of an unseen blob moves once, copies are merged before
that shuffle, and texts of seen blobs stay where they are as long as the counted ids of the unseen
can be broadcast.  The last join moves the narrow table of paths, whose
hot keys adaptive execution can split.

Defined cases: null text is the empty text; an empty table gives no rows; rows
that repeat are kept, each with its findings; extra columns of the input are not
looked at, whatever their names; very long texts are scanned whole in linear time; a private
key without its last line reaches to the end of the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .common import BROADCAST_BYTES, cut, free_name, lean, small_or_not, span_digest, text_or_empty

SPANS = "array<struct<kind:string,start:long,end:long>>"
LEDGER = f"blob_id string, rule string, version int, spans {SPANS}"


@dataclass(frozen=True)
class Rule:
    """``pattern``'s leftmost matches that do not overlap; those whose ``group`` is shorter than ``least`` are dropped."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    version: int = 1
    needs: str = ""


_LABEL = "(?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----"
#: The first three are the base kinds; the order is the order of kinds at equal starts.
RULES = (
    Rule("assign", r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]{16,}", needs="AKIA"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("pem", rf"-----BEGIN {_LABEL}(?:[\s\S]*?-----END {_LABEL}|[\s\S]*)", needs="PRIVATE KEY"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", needs="gh"),
)
BASE = ("assign", "access", "hex")


def find(text: str, rule: Rule) -> list[tuple[int, int]]:
    """Spans of one rule in one text, in code points, ends exclusive."""
    if rule.needs and rule.needs not in text:
        return []
    return [m.span() for m in re.finditer(rule.pattern, text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def _scanner(rules: tuple[Rule, ...]):
    order = {r.kind: i for i, r in enumerate(rules)}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, kinds = (batch.column(i) for i in range(3))
            found = []
            for text, pending in zip(texts, kinds.to_pylist()):
                value = text.as_py()
                spans = [(s, order[k], e) for k in pending for s, e in find(value, rules[order[k]])]
                found.append([{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in sorted(spans)])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([ids, kinds, pa.array(found, kind)], names=["blob_id", "pending", "spans"])

    return scan


def paths_of(versions: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """The path table: keys and blob_id, one row for each version."""
    return versions.select(*keys, F.sha2(text_or_empty(text), 256).alias("blob_id"))


def scan_unseen(versions: DataFrame, text: str = "text", ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New scans: blob_id, pending (the rules run), spans.  Blobs that every rule version has seen do not come up."""
    ship(versions.sparkSession)
    every = F.array(*(F.lit(r.kind) for r in rules))
    blobs = versions.select(F.sha2(text_or_empty(text), 256).alias("blob_id"), text_or_empty(text).alias("blob"))
    if ledger is None:
        blobs = blobs.dropDuplicates(["blob_id"]).withColumn("pending", every)
    else:
        current = F.array(*(F.lit(f"{r.kind}@{r.version}") for r in rules))
        seen = F.concat_ws("@", "rule", F.col("version").cast("string"))
        done = ledger.where(F.array_contains(current, seen)).groupBy("blob_id").agg(F.collect_set("rule").alias("done"))
        left = F.array_except(every, F.coalesce("done", F.array().cast("array<string>")))
        unseen = cut(blobs.select("blob_id").distinct().join(done, "blob_id", "left").select("blob_id", left.alias("pending")).where(F.size("pending") > 0))
        if unseen.count() * 300 <= BROADCAST_BYTES:
            blobs = blobs.join(F.broadcast(unseen), "blob_id").dropDuplicates(["blob_id"])
        else:  # copies are merged before the shuffle, and the join needs no other
            blobs = blobs.dropDuplicates(["blob_id"]).join(unseen, "blob_id")
    return blobs.select("blob_id", "blob", "pending").mapInArrow(lean(_scanner(rules)), f"blob_id string, pending array<string>, spans {SPANS}")


def ledger_rows(scans: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that ``scans`` adds to the ledger; append them after the run's findings are safe."""
    version = F.create_map(*(x for r in rules for x in (F.lit(r.kind), F.lit(r.version))))
    one = scans.select("blob_id", F.explode("pending").alias("rule"), "spans")
    return one.select("blob_id", "rule", version[F.col("rule")].alias("version"), F.filter("spans", lambda s: s["kind"] == F.col("rule")).alias("spans"))


def findings(scans: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob_id and all its spans by start and then kind; only blobs with spans."""
    new = scans.where(F.size("spans") > 0).select("blob_id", "spans")
    return new if ledger is None else _merged(new.union(_current(ledger, rules)), rules)


def seen_findings(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The same from a ledger alone."""
    return _merged(_current(ledger, rules), rules)


def _current(ledger: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    versions = F.array(*(F.lit(f"{r.kind}@{r.version}") for r in rules))
    return ledger.where((F.size("spans") > 0) & F.array_contains(versions, F.concat_ws("@", "rule", F.col("version").cast("string")))).select("blob_id", "spans")


def _merged(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    both = rows.groupBy("blob_id").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))
    rank = F.create_map(*(x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))))
    keyed = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("r"), s["kind"].alias("kind"), s["end"].alias("end")))
    back = F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return both.select("blob_id", back.alias("spans"))


def scan_paths(versions: DataFrame, keys: list[str], text: str = "text", ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """keys, blob_id, spans (an empty array where nothing was found), a row for each row of ``versions``."""
    found = findings(scan_unseen(versions, text, ledger, rules), ledger, rules)
    joined = paths_of(versions, keys, text).join(found, "blob_id", "left")
    return joined.select(*keys, "blob_id", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger kept in ``folder``; an empty one where there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(LEDGER).parquet(folder) if there else spark.createDataFrame([], LEDGER)


def run(versions: DataFrame, folder: str, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One increment: scans the pairs of blob and rule version that the ledger in ``folder`` lacks, appends them and returns the ledger."""
    spark = versions.sparkSession
    ledger_rows(scan_unseen(versions, text, stored(spark, folder), rules), rules).write.mode("append").parquet(folder)
    return stored(spark, folder)


def from_ledger(versions: DataFrame, keys: list[str], ledger: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """keys, blob_id, spans of every version, all of whose blobs the ledger has."""
    found = seen_findings(ledger, rules)
    joined = paths_of(versions, keys, text).join(found, "blob_id", "left")
    return joined.select(*keys, "blob_id", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def digest(found: DataFrame, keys: list[str], base: tuple[str, ...] = BASE) -> DataFrame:
    """Counts, digest of the base spans and all spans as text."""
    spans = F.col("spans")
    of_base = F.filter(spans, lambda s: s["kind"].isin(*base))
    return found.select(
        *keys, *(count_kind(spans, k).alias(f"n_{k}") for k in base),
        F.sha2(span_digest(of_base), 256).alias("base_sha256"), span_digest(spans).alias("spans"), "blob_id",
    )


def redact(docs: DataFrame, text: str = "text", ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with each secret replaced by ``[kind]``; overlapping spans become one, named after the first.

    Columns stay as they are, but for ``text`` and, if there is one, ``n_chars``.  A null text stays null.
    A ``ledger`` must have all blobs of ``docs`` (see ``run``); without one all are scanned.
    """
    every = findings(scan_unseen(docs, text, None, rules), None, rules) if ledger is None else seen_findings(ledger, rules)
    blob, spans = free_name(docs, "__blob"), free_name(docs, "__spans")
    found = cut(every.select(F.col("blob_id").alias(blob), F.col("spans").alias(spans)))
    size = found.agg(F.coalesce(F.sum(F.size(spans) * 64 + 100), F.lit(0))).first()[0]
    keyed = docs.withColumn(blob, F.sha2(text_or_empty(text), 256))
    joined = keyed.join(small_or_not(found, 1, size), blob, "left")  # texts are only shuffled when the findings are too many to broadcast
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        kept = F.substring(F.col(text), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        new = F.struct(F.concat(acc["out"], kept, F.lit("["), s["kind"], F.lit("]")).alias("out"), s["end"].alias("at"))
        longer = F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))
        return F.when(s["start"] >= acc["at"], new).otherwise(longer)

    clean = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(F.col(text), (acc["at"] + 1).cast("int"), F.lit(2147483647))))
    out = joined.withColumn(text, F.when(F.col(spans).isNotNull() & F.col(text).isNotNull(), clean).otherwise(F.col(text)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(spans).isNotNull(), F.char_length(text).cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
