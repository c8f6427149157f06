"""Replies of models: JSON repair, first JSON object and validation."""

from __future__ import annotations

import json
import re
import unicodedata
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

REPLY = "struct<answer_text:string,reason:string,evidence:array<string>>"
UNREADABLE = "json decode error - rerun later"
#: Replies used when nothing valid came (fixed values).
FALLBACK = ("unknown", "page_error")
#: Quotes that become plain ones (fixed values).
_QUOTES = str.maketrans({c: '"' for c in "“”„‟"} | {c: "'" for c in "‘’‚‛"})
#: Strings, closed or open to the end of the text, and braces.
_TOKENS = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\\?\Z)|[{}]', re.DOTALL)
_BAD_UNICODE = re.compile(r"\\u(?![0-9a-fA-F]{4})")
_BAD_ESCAPE = re.compile(r'\\(?!["\\/bfnrtu])')


def _load(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return None


def repair(text: str) -> object:
    """The JSON value of a reply, mended in steps, each tried only when those before fail."""
    steps = (
        lambda t: t,
        lambda t: re.sub(r"^```[a-zA-Z]*\s*|\s*```$", "", t.strip()),
        lambda t: _BAD_UNICODE.sub(r"\\\\u", re.sub(r"[\x00-\x1f]", " ", unicodedata.normalize("NFC", t).translate(_QUOTES))),
        lambda t: _BAD_ESCAPE.sub(r"\\\\", t),
    )
    now = text
    for step in steps:
        now = step(now)
        value = _load(now)
        if value is not None:
            return value
    return {"answer_text": UNREADABLE, "reason": UNREADABLE, "evidence": [text]}


@F.pandas_udf(StringType())
def repaired_json(text: pd.Series) -> pd.Series:
    """Canonical JSON of each reply: keys sorted; the repair is no regular language."""
    return text.map(lambda t: json.dumps(repair(t), sort_keys=True, ensure_ascii=False), na_action="ignore")


def first_object(text: str) -> str | None:
    """The first balanced ``{...}``: a quoted string is one token, so that only braces outside of strings count."""
    begin = text.find("{")
    braces = [m for m in _TOKENS.finditer(text, begin) if m[0] in "{}"] if begin >= 0 else []
    depths = accumulate(1 if m[0] == "{" else -1 for m in braces)
    return next((text[begin : m.end()] for m, depth in zip(braces, depths) if depth == 0), None)


@F.pandas_udf(StringType())
def first_json_object(text: pd.Series) -> pd.Series:
    return text.map(first_object, na_action="ignore")


def is_valid_reply(text: Column) -> Column:
    """Exactly the three keys, two of them texts and one a list."""
    keys = F.array_sort(F.json_object_keys(text))
    kinds = F.from_json(text, "answer_text string, reason string, evidence array<string>")
    raw = F.regexp_extract(text, r'"answer_text"\s*:\s*(.)', 1)
    raw2 = F.regexp_extract(text, r'"reason"\s*:\s*(.)', 1)
    named = keys == F.array(F.lit("answer_text"), F.lit("evidence"), F.lit("reason"))
    return F.coalesce(named & (raw == '"') & (raw2 == '"') & kinds["evidence"].isNotNull(), F.lit(False))


def parsed_reply(text: Column) -> Column:
    """The reply's struct, or the fallback where it isn't valid."""
    empty = F.array().cast("array<string>")
    fallback = F.struct(F.lit(FALLBACK[0]).alias("answer_text"), F.lit(FALLBACK[1]).alias("reason"), empty.alias("evidence"))
    return F.when(is_valid_reply(text), F.from_json(text, REPLY)).otherwise(fallback)
