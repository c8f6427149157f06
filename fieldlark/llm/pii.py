"""Personal data: patterns propose spans, checksums confirm them, context words adjust a score.

Native: regular expressions and array expressions only, no shuffle at all.  The
quantifiers are possessive where a run can be long, so that time is linear and no
match needs a deep stack.

Kinds: email, ip, card (Luhn) and phone, and iban (mod 97), which the method adds.
A span's place comes from the lengths of the texts between matches.

Defined cases: null text is empty; empty texts have no spans; rows that repeat are
kept; very long texts are searched whole; extra columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import span_digest, text_or_empty

BASE = ("email", "ip", "card", "phone")
#: Context words that raise a score (fixed values).
CONTEXT = {
    "email": "e-?mail|mail|contact|write|kontakt|correo|courriel|@", "ip": r"\bip\b|address|host|server|adresse",
    "card": "card|credit|visa|payment|karte|tarjeta|carte", "phone": "phone|tel|call|mobile|fax|anruf|llam", "iban": "iban|bank|account|konto|cuenta|compte",
}
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.5, "iban": 0.9}
NEAR = 40
_LOCAL = "[A-Za-z0-9._%+-]"
#: A run of local characters can only match from its start or from where the last match ended.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9_])",
}
_SPAN = "struct<kind:string,start:long,end:long,value:string>"


def spans_of(text: Column, kind: str) -> Column:
    """All matches of one pattern as structs, ends exclusive, in code points."""
    pattern = F.lit(PATTERNS[kind])
    both = F.arrays_zip(F.split(text, PATTERNS[kind], -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.char_length(x["gap"])
        e = s + F.char_length(x["hit"])
        one = F.struct(F.lit(kind).alias("kind"), s.alias("start"), e.alias("end"), x["hit"].alias("value"))
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    return F.aggregate(F.filter(both, lambda x: x["hit"].isNotNull()), start, step, lambda acc: acc["out"])


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    places = F.sequence(F.lit(1), F.length(number))
    each = F.transform(places, lambda i: (F.substring(number, (F.length(number) - i + 1), F.lit(1)).cast("int") * (F.lit(2) - i % 2)).cast("int"))
    total = F.aggregate(each, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d))
    return total % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an account number has remainder 1 by 97."""
    compact = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(compact, F.lit(5), F.length(compact)), F.substring(compact, 1, 4))

    def step(acc: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c >= 65, (acc * 100 + c - 55) % 97).otherwise((acc * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def _confirmed(kind: str):
    def ok(s: Column) -> Column:
        v = s["value"]
        if kind == "ip":
            return F.forall(F.split(v, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^(?:|[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
        if kind == "card":
            return F.length(digits(v)).between(14, 19) & luhn(digits(v))
        if kind == "phone":
            return F.length(digits(v)).between(10, 15)
        return mod97(v) if kind == "iban" else F.lit(True)

    return ok


def find(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys and ``found``: array of kind, start, end, value and score by start, then kind."""
    none = F.array().cast(f"array<{_SPAN}>")
    t = F.col("__t")
    has = {"email": F.contains(t, F.lit("@")), "phone": F.contains(t, F.lit("+")), "ip": F.col("__d"), "card": F.lit(True), "iban": F.col("__d")}
    base = docs.select(*keys, text_or_empty(text).alias("__t")).withColumn("__d", t.rlike("[0-9][0-9.]"))
    sure = {"ip": t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), "card": t.rlike(PATTERNS["card"]), "iban": t.rlike("[A-Z]{2}[0-9]{2}"), "email": F.lit(True), "phone": F.lit(True)}
    each = [F.when(has[k] & sure[k], F.filter(spans_of(t, k), _confirmed(k))).otherwise(none).alias(f"__{k}") for k in PATTERNS]
    got = base.select(*keys, "__t", *each)

    def scored(i: int, kind: str) -> Column:
        def one(s: Column) -> Column:
            before = F.substring(t, F.greatest(s["start"] - NEAR + 1, F.lit(1)).cast("int"), F.least(s["start"], F.lit(NEAR)).cast("int"))
            near = F.lower(before).rlike(CONTEXT[kind])
            score = F.lit(PRIOR[kind]) + F.when(near, F.lit((1 - PRIOR[kind]) / 2)).otherwise(F.lit(0.0))
            return F.struct(s["start"].alias("start"), F.lit(i).alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value"), score.alias("score"))

        return F.transform(f"__{kind}", one)

    every = F.array_sort(F.concat(*(scored(i, k) for i, k in enumerate(PATTERNS))))
    plain = F.transform(every, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), s["score"].alias("score")))
    empty = F.array().cast("array<struct<kind:string,start:long,end:long,value:string,score:double>>")
    some = F.lit(False)
    for k in PATTERNS:
        some = some | (F.size(f"__{k}") > 0)
    return got.select(*keys, F.when(some, plain).otherwise(empty).alias("found"))


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def digest(found: DataFrame, keys: list[str]) -> DataFrame:
    spans = F.col("found")
    counts = [_count(spans, k).alias(f"n_{k}") for k in BASE]
    of_base = F.filter(spans, lambda s: s["kind"].isin(*BASE))
    scores = F.array_join(F.transform(spans, lambda s: F.format_number(s["score"], 2)), ",")
    return found.select(*keys, *counts, F.sha2(span_digest(of_base), 256).alias("base_sha256"), span_digest(spans).alias("spans"), scores.alias("scores"))
