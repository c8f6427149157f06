"""External services behind injected callables; the defaults work offline.

A provider maps columns to a column, so it can be a built-in expression or a Pandas function.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AnswerProvider = Callable[[Column, Column], Column]
SearchProvider = Callable[[str], Iterable[dict]]


def keyword_answer(question: Column, context: Column) -> Column:
    """Offline rule: yes or no where the context says so plainly, else UNKNOWN."""
    text = F.lower(context)
    return F.when(text.rlike(r"\bnot\b|\bno\b"), "no").when(text.rlike(r"\byes\b|\bcan\b|\bis a\b"), "yes").otherwise("UNKNOWN")


@dataclass(frozen=True)
class PagedSearch:
    """Pages through a search service until enough results, or an empty page, came."""

    fetch: Callable[[str, int], list[dict]]
    page: int = 10

    def __call__(self, query: str, wanted: int = 10) -> list[dict]:
        out: list[dict] = []
        while len(out) < wanted:
            got = self.fetch(query, len(out) + 1)
            if not got:
                break
            out += got
        return out[:wanted]


def search_links(questions: DataFrame, search: SearchProvider) -> DataFrame:
    """(question_id, url, title) of a search for each question's keywords; a failing search gives no rows."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for q, k in zip(part["question_id"], part["keyword_phrase"]):
                try:
                    rows += [(q, r["url"], r.get("title")) for r in search(k)]
                except OSError:
                    continue
            yield pd.DataFrame(rows, columns=["question_id", "url", "title"])

    return questions.select("question_id", "keyword_phrase").mapInPandas(run, "question_id long, url string, title string")


def fetch_pages(links: DataFrame, fetch: Callable[[str], str], longest: int = 2000) -> DataFrame:
    """(id, url, html, fetch_error) of the links (id, url): the page, or why there is none."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for i, url in zip(part["id"], part["url"]):
                try:
                    rows.append((i, url, fetch(url), None))
                except OSError as e:
                    rows.append((i, url, None, f"{type(e).__name__}: {e}"[:longest]))
            yield pd.DataFrame(rows, columns=["id", "url", "html", "fetch_error"])

    return links.select("id", "url").mapInPandas(run, "id long, url string, html string, fetch_error string")


def with_retries(call: Callable[[str], Iterable[dict]], tries: int = 5, longest: float = 8.0, sleep: Callable[[float], None] = time.sleep) -> SearchProvider:
    """``call`` again after failures of the network, with waits that double up to ``longest`` and some jitter."""

    def run(query: str) -> Iterable[dict]:
        for attempt in range(tries):
            try:
                return call(query)
            except OSError:
                if attempt == tries - 1:
                    raise
                sleep(min(2.0**attempt, longest) + random.uniform(0, 0.5))
        return []

    return run
