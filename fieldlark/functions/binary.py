"""Text of binary documents: a cascade of readers, each tried where those before give none."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import printable, valid_words

#: A reader takes the bytes and the most pages it may read, and gives a text or raises.
Reader = Callable[[bytes, int], str]
MAX_PAGES = 50
#: Texts in place of a document's (fixed values).
TOO_LONG, EMPTY, UNREADABLE = "[[PDF_SKIPPED_TOO_LONG:{}]]", "[[PDF_EMPTY_TEXT]]", "[[PDF_PARSE_ERROR]]"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def word_text(data: bytes, _: int = MAX_PAGES) -> str:
    """The paragraphs of a Word document, a line each, without empty ones."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    lines = ("".join(t.text or "" for t in p.iter(f"{_WORD}t")) for p in root.iter(f"{_WORD}p"))
    return "\n".join(line for line in lines if line)


def read_first(data: bytes, readers: list[Reader], max_pages: int = MAX_PAGES) -> str:
    """What the first reader that succeeds finds; else the bytes as UTF-8, without what is none."""
    for reader in readers:
        try:
            text = reader(data, max_pages)
        except Exception:  # noqa: BLE001, S112  any failure of a reader passes the document on
            continue
        if text.strip():
            return text
    return data.decode("utf-8", "ignore")


def document_text(data: Column, readers: list[Reader] | None = None, max_pages: int = MAX_PAGES) -> Column:
    """The valid words of binary documents; a reader of other formats, such as PDF, is given by the caller."""
    every = [*(readers or []), word_text]

    @F.pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda b: read_first(bytes(b), every, max_pages), na_action="ignore")

    return valid_words(printable(run(data)))


def paged_reader(pages: Callable[[bytes], list[str]]) -> Reader:
    """A reader over a function that gives a document's pages: long and empty documents give a text that says so, as do those it fails on."""

    def read(data: bytes, max_pages: int) -> str:
        try:
            found = pages(data)
        except Exception:  # noqa: BLE001
            return UNREADABLE
        if len(found) > max_pages:
            return TOO_LONG.format(len(found))
        return "\n\n".join(p.strip() for p in found if p.strip()) or EMPTY

    return read
