"""Text functions as column expressions."""

from __future__ import annotations

import html
import string
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Texts of pages that are no content (fixed values).
ERROR_PATTERNS = (
    "you need to enable javascript", "please enable javascript", "403 forbidden", "401 unauthorized", "404 not found", "too many requests", "service unavailable",
    "bad gateway", "gateway timeout", "captcha", "are you a robot", "bot detection", "bot detected", "cloudflare", "akamai", "imperva",
    "click here if you are not redirected", "internal server error", "we've detected unusual activity from your network.",
)
#: Phrases of a soft block (fixed values).
SOFT_BLOCKS = ("temporarily unavailable", "just a moment", "verify you are a human", "are you a human", "access denied", "rate limit", "unusual traffic")
MIN_CONTENT = 40
#: Patterns of the plain-text stage, in order of use (fixed values).
BLOCK_TAGS = r"(?i)</?(?:p|div|br|li|h[1-6]|tr|th|td)\b[^>]*>"
ANY_TAG = r"(?s)<[^>]+>"
BLANKS = r"[ \t\f\x0B]+"
BLANK_LINES = r"\n\s*\n+"


def _has_any(text: Column, phrases: tuple[str, ...]) -> Column:
    """Whether a text holds one of the phrases; the text is evaluated once, not once for each phrase."""

    def any_of(t: Column) -> Column:
        out = F.contains(t, F.lit(phrases[0]))
        for p in phrases[1:]:
            out = out | F.contains(t, F.lit(p))
        return out

    return F.exists(F.array(text), any_of)


def one_line(text: Column) -> Column:
    """Lower case, runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def short_key(value: Column) -> Column:
    """First eight hex digits of the SHA-256 of a JSON text."""
    return F.substring(F.sha2(value, 256), 1, 8)


def cache_key(value: Column) -> Column:
    return F.md5(value)


def is_error_text(text: Column) -> Column:
    """True for blank texts, known error texts and texts under 40 characters; otherwise null, which is unknown."""
    shape = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(text.isNull() | (shape == ""), True).when(_has_any(F.lower(text), ERROR_PATTERNS), True).when(F.length(shape) < MIN_CONTENT, True)


def soft_block(title: Column, body: Column) -> Column:
    return _has_any(F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(body, F.lit("")))), SOFT_BLOCKS)


def strip_markup(page: Column) -> Column:
    """Page source to text, but for entities: scripts go, blocks break lines, tags and runs of blanks become a space."""
    t = page
    for tag in ("script", "style", "noscript"):
        t = F.regexp_replace(t, rf"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    return F.regexp_replace(F.regexp_replace(t, BLOCK_TAGS, "\n"), ANY_TAG, " ")


def tidy_space(text: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(text, BLANKS, " "), BLANK_LINES, "\n\n")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


@F.pandas_udf(StringType())
def unescape_entities(text: pd.Series) -> pd.Series:
    """All named and numeric entities; no built-in knows them."""
    return text.map(html.unescape, na_action="ignore")


def html_to_text(page: Column, entities: bool = True) -> Column:
    """Plain text of a page.  Pages without ``&`` skip the entity function's work within it."""
    t = strip_markup(page)
    return tidy_space(unescape_entities(t) if entities else t)


#: A paragraph is content when it has so many characters, under half of them in links.
PARAGRAPH = 40


def article_markup(page: Column) -> Column:
    """The inside of a page's first ``article`` element, or else of its first ``main``; empty without one."""
    inside = [F.nullif(F.regexp_extract(page, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1), F.lit("")) for tag in ("article", "main")]
    return F.coalesce(*inside, F.lit(""))


def paragraph_markup(page: Column) -> Column:
    """The page's paragraphs that are long enough and no lists of links, each a block; empty without one."""
    bare = page
    for tag in ("script", "style", "noscript"):
        bare = F.regexp_replace(bare, rf"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    parts = F.regexp_extract_all(bare, F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1))

    def dense(p: Column) -> Column:
        every = F.length(F.regexp_replace(p, ANY_TAG, ""))
        loose = F.length(F.regexp_replace(F.regexp_replace(p, r"(?is)<a\b[^>]*>.*?</a>", ""), ANY_TAG, ""))
        return (every >= PARAGRAPH) & (loose * 2 > every)

    return F.coalesce(F.array_join(F.transform(F.filter(parts, dense), lambda p: F.concat(F.lit("<p>"), p, F.lit("</p>"))), "\n"), F.lit(""))


def extract_text(page: Column, entities: bool = True) -> Column:
    """A page's main text, the first of three that isn't empty: its article, its dense paragraphs, all of it."""
    stages = [F.nullif(tidy_space(strip_markup(m)), F.lit("")) for m in (article_markup(page), paragraph_markup(page))]
    found = F.coalesce(*stages, tidy_space(strip_markup(page)))
    return tidy_space(unescape_entities(found)) if entities else found


def html_text_simple(page: Column) -> Column:
    """Scripts and styles dropped, tags a space, white space collapsed."""
    t = page
    for tag in ("script", "style"):
        t = F.regexp_replace(t, rf"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, ANY_TAG, " "), r"\s+", " "))


def ascii_only(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x00-\x7F]", "")


def valid_utf8(data: Column) -> Column:
    return F.make_valid_utf8(data)


def printable(text: Column) -> Column:
    """Without control and format characters and separators, but with spaces, line breaks and tabs."""
    return F.regexp_replace(text, r"[\p{C}\p{Z}&&[^ \n\r\t]]", "")


def no_punctuation(text: Column) -> Column:
    return F.translate(text, string.punctuation, "")


def valid_words(text: Column) -> Column:
    """Words that are ASCII letters once all punctuation is gone, joined by spaces."""
    words = F.split(F.trim(F.regexp_replace(no_punctuation(text), r"\s+", " ")), " ")
    return F.array_join(F.filter(words, lambda w: w.rlike("^[A-Za-z]+$")), " ")


def nl2br(text: Column) -> Column:
    return F.regexp_replace(text, "\n", "<br>\n")


def quoted_if_needed(text: Column) -> Column:
    return F.when(F.contains(text, F.lit(",")), F.concat(F.lit('"'), text, F.lit('"'))).otherwise(text)


def scrub_key(text: Column) -> Column:
    t = F.replace(text, F.lit(" "), F.lit(""))
    t = F.regexp_replace(t, r"[,.();\\/]", "_")
    return F.regexp_replace(F.regexp_replace(t, "_+", "_"), "_nan", "")


def safe_filename(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r'[\\/:*?"<>|]', "_"), F.lit("."))


def phrase_of(keywords: Column) -> Column:
    """Last word of the first quoted phrase, in lower case; empty without one."""
    return F.element_at(F.split(F.lower(F.trim(F.regexp_extract(keywords, '"([^"]+)"', 1))), " "), -1)


def is_relevant(text: Column, keywords: Column) -> Column:
    return F.contains(one_line(text), phrase_of(keywords))


def joined_evidence(items: Column) -> Column:
    """Items on one line each, joined by an ellipsis."""
    return F.array_join(F.transform(items, lambda e: F.trim(F.translate(e, "\n\r", "  "))), " ... ")


def template_of(question: Column, species: Column) -> Column:
    return F.replace(question, species, F.lit("[species]"))


def words_with_space(text: Column) -> Column:
    """The text's words, each with the white space before it."""
    return F.regexp_extract_all(text, F.lit(r"\s*+\S++"), F.lit(0))


def first_tokens(text: Column, limit: int, tokenizer: Callable[[str], list[str]] | None = None) -> Column:
    """The first ``limit`` tokens: words with the white space before them by default, or those of a tokenizer given.

    A text with no more tokens than that stays as it is.
    """
    if tokenizer is None:
        words = words_with_space(text)
        return F.when(F.size(words) > limit, F.array_join(F.slice(words, 1, limit), "")).otherwise(text)

    @F.pandas_udf(StringType())
    def head(s: pd.Series) -> pd.Series:
        return s.map(lambda t: "".join(tokenizer(t)[:limit]), na_action="ignore")

    return head(text)


def count_tokens(text: Column, tokenizer: Callable[[str], list[str]] | None = None) -> Column:
    """Number of tokens: words by default, or those of a tokenizer given; null for a null text."""
    if tokenizer is None:
        return F.when(text.isNotNull(), F.size(words_with_space(text)).cast("long"))

    @F.pandas_udf("long")
    def count(s: pd.Series) -> pd.Series:
        return s.map(lambda t: len(tokenizer(t)), na_action="ignore").astype("Int64")

    return count(text)


def count_message_tokens(messages: Column) -> Column:
    """Tokens of all contents of an array of (role, content)."""
    return F.aggregate(messages, F.lit(0).cast("long"), lambda n, m: n + F.coalesce(count_tokens(m["content"]), F.lit(0)))


def is_error_like(text: Column) -> Column:
    """True for no text, a blank one and texts of failures: ``Error:`` in front, a traceback or a HTTP status of 4xx or 5xx within."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    failed = t.startswith("Error:") | F.contains(t, F.lit("Traceback")) | F.contains(t, F.lit("HTTP 4")) | F.contains(t, F.lit("HTTP 5"))
    return F.coalesce((t == "") | failed, F.lit(True))


def chunks(text: Column, size: int) -> Column:
    """Array of the text's parts of ``size`` characters; empty for an empty text."""
    n = F.ceil(F.length(text) / F.lit(size)).cast("int")
    parts = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, (i - 1) * size + 1, F.lit(size)))
    return F.when(n > 0, parts).otherwise(F.array().cast("array<string>"))


def is_number(text: Column) -> Column:
    return text.try_cast("double").isNotNull()
