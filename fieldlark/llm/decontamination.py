"""Benchmark decontamination by template windows.

Numbers, names and units are replaced by typed placeholders; windows of ``WINDOW``
tokens over whole texts are hashed and hash-joined with the windows of the
benchmark, then compared token by token.  An alignment counts when the fillers of its
slots are consistent: a filler of the item always stands for the same filler
in the document (``CONSISTENT`` of them at least).  A pair of document and item counts when the
matched windows of such alignments cover ``COVER`` of the item's, or ``RUN`` of them share one.  So an item is found when it is
copied, and also when its names and numbers were changed throughout.

Windows of items and of documents have two forms, with names as placeholders and, where that
differs, with names as plain words, so that copies in lower case, in capitals and in title case
are found as well.  Windows with fewer than ``LITERAL`` plain tokens would fit anything
by their placeholders; they have a third form, all tokens raw, and so match only with the same
numbers and units.  Items shorter than a window are one window of their own length; items under
``LITERAL`` tokens, such as a sentence in a script without spaces, are found by their raw tokens.

Two steps.  The first scans all documents and moves no text: the hashes of a text's windows come from
the hashes of its tokens, combined pair by pair (1, 2, 4, 8 tokens), and one explode of longs meets the
distinct hashes of the index, which are broadcast when their counted size stays within the bound and
shuffled beyond, with nothing but a document's key, a place and a hash.  The second reads the matched
documents again, compares tokens and collects the slots.  A document's matches are gathered before they
meet its text, so no array of tokens is ever shuffled and no window carries one.

Native: expressions, a generator and hash joins.

Defined cases: null text is empty; empty texts match nothing; documents that repeat
with one id are one document; documents without an id are told apart by their texts, and
``drop_contaminated`` keeps them; items without an id or a text take no part; an empty benchmark or
an empty corpus gives no rows; very long texts are read whole; extra columns are not looked at,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, cut, small_or_not, text_or_empty, without

WINDOW = 8
LITERAL = 4
COVER = 0.5
#: Windows in a row on one alignment that count whatever the item's length: 13 tokens.
RUN = 6
CONSISTENT = 0.8
#: Forms of a window: names are placeholders, names are plain words, all tokens are raw.
TYPED, PLAIN, RAW = 0, 1, 2
#: Columns of the result beside the document's id.
PAIRS = {"item_id": "long", "n_windows": "long", "coverage": "double", "n_slots": "long", "slots_consistent": "double"}
#: Units (fixed values).
UNITS = "km|m|cm|mm|kg|g|mg|l|ml|s|min|h|hours?|minutes?|seconds?|days?|weeks?|years?|miles?|feet|ft|inch(?:es)?|lbs?|pounds?|dollars?|euros?|cents?|percent|degrees?|mph|kmh|meters?|metres?|liters?|litres?|grams?|kilograms?"
_M = "\x01"
_NUMBER = r"\p{N}++(?:[.,]\p{N}++)*+"
_NAME = r"\p{Lu}(?<=[^.!?\s\x01][ ]\p{Lu})\p{L}++"
#: A unit follows its number after one blank.
_UNIT = rf"(\x01d\p{{N}}++(?:[.,]\p{{N}}++)*+[ ])((?i:{UNITS})(?![\p{{L}}\p{{N}}]))"
_TYPED = r"(\x01[dnu])(?:[\p{L}\p{N}]|[.,](?=\p{N}))++"
_BETWEEN = r"[^\p{L}\p{N}\x01]+"
#: The same, but for a point or comma within a number.
_BETWEEN_NUMBERS = r"(?:(?!(?<=\p{N})[.,](?=\p{N}))[^\p{L}\p{N}\x01])++"


def with_tokens(df: DataFrame, text: str) -> DataFrame:
    """``df`` with arrays of canonical tokens ``w`` and, place for place, of the raw ones ``r``; ``v`` and ``s`` are both with names as plain words.  ``r`` is null if equal to ``w``, ``v`` and ``s`` if no token is a name.  ``m`` counts the marks.

    Each step is a projection of its own, so that no pattern runs twice.  Most texts have no
    number and many no placeholder at all; these skip the patterns and the second split.
    """
    x, marks = F.col("__x"), F.col("m")
    free = F.when(text_or_empty(text).rlike("[\x01\x02]"), F.translate(text_or_empty(text), _M + "\x02", "  ")).otherwise(text_or_empty(text))
    rows = df.withColumn("__x", free)
    marked = F.regexp_replace(F.regexp_replace(x, _NUMBER, _M + "d$0"), _UNIT, "$1" + _M + "u$2")
    rows = rows.withColumn("__x", F.when(x.rlike(r"\p{N}"), marked).otherwise(x))
    rows = rows.withColumn("__x", F.lower(F.regexp_replace(x, _NAME, _M + "n$0")))
    rows = rows.withColumn("m", F.when(F.contains(x, F.lit(_M)), F.octet_length(x) - F.octet_length(F.replace(x, F.lit(_M)))).otherwise(0))
    split = F.when(marks > 0, F.split(F.regexp_replace(x, _TYPED, "$1"), _BETWEEN_NUMBERS, -1)).otherwise(F.split(x, _BETWEEN, -1))
    raw = F.when(marks > 0, F.array_remove(F.split(x, _BETWEEN_NUMBERS, -1), ""))
    rows = rows.withColumn("w", F.array_remove(split, "")).withColumn("r", raw)
    plain = F.zip_with("w", "r", lambda w, r: F.when(w == _M + "n", _unnamed(r)).when(w.startswith(_M + "n"), F.regexp_replace(_unnamed(r), _TYPED, "$1")).otherwise(w))
    some = F.contains(x, F.lit(_M + "n"))
    return rows.withColumn("v", F.when(some, plain)).withColumn("s", F.when(some, F.transform("r", _unnamed))).drop("__x")


def _unnamed(token: Column) -> Column:
    """A raw token without the mark of a name, which can only stand at its start."""
    return F.when(token.startswith(_M + "n"), F.substr(token, F.lit(3))).otherwise(token)


def _hashed(words: DataFrame, sizes: list[int]) -> DataFrame:
    """``words`` with columns ``__h<form>_<size>``: for each place the hash of the window that starts there.

    Hashes of 1, 2, 4 and 8 tokens are each made of two hashes of half the length.  The last places, where
    no whole window starts, hold hashes of less, which the comparison of tokens throws out.
    """
    def pair(a: Column, b: Column, by: int) -> Column:
        return F.zip_with(a, F.slice(b, by + 1, F.size(b)), lambda x, y: F.xxhash64(x, y))

    steps = [n for n in (1, 2, 4, 8) if n <= max(sizes)]
    # a window of raw tokens only counts when it has so many placeholders
    raw = F.when(F.col("m") > min(sizes) - LITERAL, F.coalesce("s", "r", "w"))
    for form, tokens in ((TYPED, F.col("w")), (PLAIN, F.col("v")), (RAW, raw)):
        words = words.withColumn(f"__b{form}_1", F.transform(tokens, lambda t: F.xxhash64(t)))
        for n in steps[1:]:
            words = words.withColumn(f"__b{form}_{n}", pair(F.col(f"__b{form}_{n // 2}"), F.col(f"__b{form}_{n // 2}"), n // 2))
        for size in sizes:
            at, whole = 0, None
            for n in reversed(steps):
                if size - at >= n:
                    part = F.col(f"__b{form}_{n}")
                    whole, at = part if whole is None else pair(whole, part, at), at + n
            words = words.withColumn(f"__h{form}_{size}", whole)
    return words


def index(benchmark: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, size, ip (place), iw and ir (tokens as compared, and raw), h (hash) of every window, and ``of``, how many the item has."""
    items = benchmark.select(F.col(key).alias("item_id"), F.col(text).alias("__text")).where(F.col("item_id").isNotNull())
    words = with_tokens(items, "__text").withColumn("size", F.least(F.size("w"), F.lit(WINDOW))).where("size > 0")
    words = cut(words.select("item_id", "w", "v", "r", "s", "m", "size"))
    sizes = sorted(r[0] for r in words.select("size").distinct().collect())  # eight numbers at most
    out = None
    for size in sizes:
        some = _hashed(words.where(F.col("size") == size), [size])
        for form in (TYPED, PLAIN, RAW):
            hashes = F.slice(F.col(f"__h{form}_{size}"), 1, F.size("w") - size + 1)
            rows = some.select("*", F.posexplode(hashes).alias("ip", "h")).withColumn("ip", F.col("ip") + 1).withColumn("f", F.lit(form))
            rows = rows.select("item_id", "size", "f", "ip", "h", _window("ip", "size").alias("iw"), _own("ip", "size").alias("ir"), F.slice(F.coalesce("v", "w"), F.col("ip"), F.col("size")).alias("__u"), (F.size("w") - size + 1).alias("of"))
            literal = F.size(F.filter("iw", lambda t: ~t.startswith(_M))) >= LITERAL
            rows = rows.where(literal if form != RAW else F.size(F.filter("__u", lambda t: ~t.startswith(_M))) < LITERAL)
            out = rows if out is None else out.union(rows)
    if out is None:
        schema = "item_id long, size int, ip int, h long, iw array<string>, ir array<string>, of int"
        return benchmark.sparkSession.createDataFrame([], schema)
    of = words.groupBy("item_id").agg(F.max(F.size("w") - F.col("size") + 1).alias("of"))
    return out.drop("__u", "of", "f").dropDuplicates(["item_id", "ip", "iw"]).join(of, "item_id")


def _window(place: str, size: str) -> Column:
    """The tokens of a window as its form compares them; without a lambda, which would copy a text's arrays for each window."""
    at, n = F.col(place), F.col(size)
    return F.when(F.col("f") == TYPED, F.slice("w", at, n)).when(F.col("f") == PLAIN, F.slice("v", at, n)).otherwise(_own(place, size))


def _own(place: str, size: str) -> Column:
    """The raw tokens of a window; a name has its mark only in the form that makes it a slot."""
    at, n = F.col(place), F.col(size)
    return F.when(F.col("f") == TYPED, F.slice(F.coalesce("r", "w"), at, n)).otherwise(F.slice(F.coalesce("s", "r", "w"), at, n))


def places(docs: DataFrame, items: DataFrame, sizes: list[int], key: str, text: str) -> DataFrame:
    """doc_id, t (hash of the text), p (place), f (form), h: where a document has a window whose hash is in the index."""
    wanted = items.select("h").distinct()
    texts = docs.select(F.col(key).alias("doc_id"), F.xxhash64(text_or_empty(text)).alias("t"), text_or_empty(text).alias("__text"))
    words = _hashed(with_tokens(texts, "__text").select("doc_id", "t", "w", "v", "r", "s", "m"), sizes)
    none = F.array().cast("array<long>")
    lists = [(F.col(f"__h{form}_{size}"), form) for size in sizes for form in (TYPED, PLAIN, RAW)]
    there = F.array_compact(F.array(*(F.when(hashes.isNotNull(), form) for hashes, form in lists)))
    joined = F.concat(*(F.coalesce(hashes, none) for hashes, _ in lists))  # each list is as long as the text
    # a projection of its own, or all arrays would go with each row of the generator; the outer form, as the
    # other has a filter that would be pushed below all steps and repeat them
    every = words.select("doc_id", "t", there.alias("__forms"), F.size("w").alias("n"), joined.alias("__all"))
    every = every.select("doc_id", "t", "__forms", "n", F.posexplode_outer("__all").alias("at", "h"))
    every = every.select("doc_id", "t", (F.col("at") % F.col("n") + 1).alias("p"), F.element_at("__forms", F.floor(F.col("at") / F.col("n")).cast("int") + 1).alias("f"), "h")
    return every.join(small_or_not(wanted, wanted.count(), 64), "h", "left_semi").distinct()


def hits(docs: DataFrame, items: DataFrame, sizes: list[int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Matched windows: doc_id, t, item_id, of, ip, p and the slots' fillers (item's, document's)."""
    found = cut(places(docs, items, sizes, key, text))
    size = items.agg(F.coalesce(F.sum(F.octet_length(F.array_join("iw", " ")) + F.octet_length(F.array_join("ir", " ")) + 500), F.lit(0))).first()[0]
    pairs = found.join(small_or_not(items, 1, size), "h").withColumn("who", F.when(F.col("doc_id").isNull(), F.col("t")))
    # equal hashes bound the equal windows from above, so what falls short of both thresholds is not read again
    likely = pairs.groupBy("doc_id", "who", "item_id", "of").agg(F.size(F.collect_set("ip")).alias("n")).where((F.col("n") >= COVER * F.col("of")) | (F.col("n") >= RUN))
    likely = likely.select(F.col("doc_id").alias("__d"), F.col("who").alias("__w"), F.col("item_id").alias("__i"))
    pairs = pairs.join(likely, F.col("doc_id").eqNullSafe(F.col("__d")) & F.col("who").eqNullSafe(F.col("__w")) & (F.col("item_id") == F.col("__i")), "left_semi")
    one = F.struct("p", "size", "f", "item_id", "of", "ip", "iw", "ir")
    of_doc = cut(pairs.groupBy("doc_id", "t").agg(F.collect_list(one).alias("__pairs")))  # as many as the text has matched windows
    of_doc = of_doc.withColumnsRenamed({"doc_id": "__d", "t": "__t"})
    rows, many = of_doc.agg(F.count("*"), F.coalesce(F.sum(F.size("__pairs") * 600 + 100), F.lit(0))).first()
    texts = docs.select(F.col(key).alias("doc_id"), F.xxhash64(text_or_empty(text)).alias("t"), text_or_empty(text).alias("__text"))
    same_text = F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("t") == F.col("__t"))
    if many > BROADCAST_BYTES:  # their keys at least may be few enough
        texts = texts.join(small_or_not(of_doc.select("__d", "__t"), rows, 64), same_text, "left_semi")
    both = texts.join(small_or_not(of_doc, 1, many), same_text)
    words = with_tokens(both.select("doc_id", "t", "__text", "__pairs"), "__text")
    rows = words.select("doc_id", "t", "w", "v", "r", "s", F.explode("__pairs").alias("__one")).select("doc_id", "t", "w", "v", "r", "s", "__one.*")
    same = rows.where(_window("p", "size") == F.col("iw"))
    pair = F.zip_with("ir", _own("p", "size"), lambda a, b: F.struct(a.alias("item"), b.alias("doc")))
    return same.select("doc_id", "t", "item_id", "of", "ip", "p", F.filter(pair, lambda s: s["doc"].startswith(_M)).alias("slots"))


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, item_id, n_windows, coverage, n_slots, slots_consistent (a share) of the pairs that count."""
    items = cut(index(benchmark, text=text))
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())  # eight numbers at most
    if not sizes:
        return docs.limit(0).select(F.col(key).alias("doc_id"), *(F.lit(None).cast(kind).alias(name) for name, kind in PAIRS.items()))
    got = hits(docs, items, sizes, key, text)
    each = got.groupBy("doc_id", "t", "item_id", "of", (F.col("p") - F.col("ip")).alias("shift")).agg(
        F.collect_set("ip").alias("ips"), F.array_distinct(F.flatten(F.collect_list("slots"))).alias("slots"))
    # one alignment has as many windows as the item has at most
    fillers = F.size(F.array_distinct(F.transform("slots", lambda s: s["item"])))
    steady = F.size(F.filter(F.array_distinct(F.transform("slots", lambda s: s["item"])), lambda x: F.size(F.filter("slots", lambda s: s["item"] == x)) == 1))
    each = each.select("doc_id", F.when(F.col("doc_id").isNull(), F.col("t")).alias("t"), "item_id", "of", "ips", F.size("ips").alias("run"), fillers.alias("n"), steady.alias("ok"))
    # each alignment is judged by itself: an inconsistent one takes nothing from a copy elsewhere in the document
    each = each.where((F.col("n") == 0) | (F.col("ok") >= CONSISTENT * F.col("n")))
    pairs = each.groupBy("doc_id", "t", "item_id", "of").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("ips")))).alias("n_windows"), F.max("run").alias("run"), F.sum("n").alias("n_slots"), F.sum("ok").alias("ok"))
    joined = pairs.withColumn("coverage", F.least(F.col("n_windows") / F.col("of"), F.lit(1.0)))
    share = F.when(F.col("n_slots") > 0, F.col("ok") / F.col("n_slots")).otherwise(F.lit(1.0))
    out = joined.withColumn("slots_consistent", share).where((F.col("coverage") >= COVER) | (F.col("run") >= RUN))
    return out.select("doc_id", "item_id", F.col("n_windows").cast("long").alias("n_windows"), "coverage", "n_slots", "slots_consistent")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without contaminated ones; a null key stays."""
    return without(docs, contaminated(docs, benchmark, key, text).select(F.col("doc_id").alias(key)), key)
