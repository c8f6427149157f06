"""Stages of the question-answering corpus: expansion, work lists, ingest, answers and reports."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls
from ..functions.windows import windows_column
from ..sources.tables import Store
from .joins import bounded

#: Placeholders of question templates (fixed values).
PLACEHOLDERS = ("predator_list", "pest_list", "full_species_list")
_PLACEHOLDER = r"\[(" + "|".join(PLACEHOLDERS) + r")\]"
#: Reasons of answers (fixed values).
REASONS = ("supported", "not_enough_information", "blank_page", "content_unrelated", "conflicting_evidence", "non_english", "page_error", "model_uncertain")
NO_LINKS = ("none", "no links found in search", "n/a")
UNREAD = "COULD NOT READ"


def expand_templates(lines: DataFrame, lists: Mapping[str, DataFrame]) -> DataFrame:
    """species, keyword_phrase, question of each template line (column ``value``) and each choice of names.

    A line is ``keywords | question``.  Each placeholder that occurs multiplies by its list
    (column ``name``) through an equi-join on the placeholder's name, so lines only meet
    the lists that they use.
    """
    parts = F.split(F.trim("value"), r" \| ", 2)
    rows = lines.where(~F.trim("value").startswith("#")).where(F.size(parts) == 2).select(F.trim(parts[0]).alias("keyword_phrase"), F.trim(parts[1]).alias("question"))
    used = F.array_distinct(F.regexp_extract_all(F.concat_ws("\x01", "keyword_phrase", "question"), F.lit(_PLACEHOLDER), F.lit(1)))
    rows = rows.withColumn("used", used).where(F.size("used") > 0).withColumn("species", F.array().cast("array<string>"))
    names = None
    for p, names_of in lists.items():
        one = names_of.select(F.lit(p).alias("list"), F.col("name"))
        names = one if names is None else names.union(one)
    for i in range(len(PLACEHOLDERS)):
        here = F.element_at("used", F.lit(i + 1))
        left = rows.where(F.size("used") > i).withColumn("list", here)
        token = F.concat(F.lit("["), F.col("list"), F.lit("]"))
        more = left.join(names, "list").select(
            F.replace("keyword_phrase", token, F.col("name")).alias("keyword_phrase"), F.replace("question", token, F.col("name")).alias("question"),
            "used", F.concat("species", F.array("name")).alias("species"),
        )
        rows = more.unionByName(rows.where(F.size("used") <= i))
    return rows.select(F.array_join("species", " & ").alias("species"), "keyword_phrase", "question")


def expanded_line(df: DataFrame) -> DataFrame:
    return df.select(F.concat_ws(":", "species", "keyword_phrase", "question").alias("value"))


def parse_expanded(lines: DataFrame) -> DataFrame:
    """species, keyword_phrase and question; names may hold colons, the keywords start with a quoted phrase."""
    pattern = r'^(.*?):("[^"]*"[^:]*):(.*)$'
    quoted = F.col("value").rlike(pattern)
    plain = F.split("value", ":", 3)

    def part(i: int) -> Column:
        return F.trim(F.when(quoted, F.regexp_extract("value", pattern, i)).otherwise(F.get(plain, F.lit(i - 1))))

    return lines.where(F.trim("value") != "").select(part(1).alias("species"), part(2).alias("keyword_phrase"), part(3).alias("question"))


def species_questions(species: DataFrame, scopes: DataFrame) -> DataFrame:
    """Every species with every scoped question; each row meets each by definition, and the scopes are a hand-written list."""
    return species.crossJoin(bounded(scopes, scopes.count(), 1000)).withColumn("question_formatted", F.replace("question_body", F.lit("[species]"), F.col("species")))


def fix_lines(lines: DataFrame, corrections: DataFrame) -> DataFrame:
    """Lines (column ``value``) with names trimmed and corrected; comments and blank lines pass through."""
    name = F.trim("value")
    fixes = corrections.select(F.col("original").alias("__name"), "corrected").dropDuplicates(["__name"])
    joined = lines.join(fixes, name == F.col("__name"), "left")
    return joined.select(F.when((name == "") | name.startswith("#"), F.col("value")).otherwise(F.coalesce("corrected", name)).alias("value"))


def fix_spelling(names: DataFrame, corrections: DataFrame) -> DataFrame:
    """``name`` with its correction if there is one."""
    fixes = corrections.select(F.col("original").alias("name"), "corrected").dropDuplicates(["name"])
    return names.join(fixes, "name", "left").select("name", F.coalesce("corrected", "name").alias("fixed"))


def pending_questions(store: Store) -> DataFrame:
    return store.questions.join(store.question_links.select(F.col("question_id").alias("id")), "id", "left_anti").select("id", "keyword_phrase")


def unscraped_links(store: Store) -> DataFrame:
    have = store.content.where("text is not null").select(F.col("id").alias("content_id"))
    return store.links.where("fetch_error is null").join(have, "content_id", "left_anti").select("id", "url")


def unanswered(store: Store) -> DataFrame:
    """Pairs of question and link with content that isn't known to be invalid, and no answer."""
    fine = store.content.where(F.coalesce(F.col("is_valid") != 0, F.lit(True))).select(F.col("id").alias("content_id"))
    links = store.links.join(fine, "content_id", "left_semi").select(F.col("id").alias("link_id"))
    pairs = store.question_links.join(links, "link_id", "left_semi")
    return pairs.join(store.answers.select("question_id", "link_id"), ["question_id", "link_id"], "left_anti").select(F.col("id").alias("question_link_id"), "question_id", "link_id")


def missing_answers(store: Store) -> DataFrame:
    """Pairs with valid content and no answer, with their question and URL."""
    valid = store.content.where("is_valid = 1").select(F.col("id").alias("content_id"))
    links = store.links.join(valid, "content_id", "left_semi").select(F.col("id").alias("link_id"), "url")
    pairs = store.question_links.join(store.answers.select(F.col("question_link_id").alias("id")), "id", "left_anti")
    questions = store.questions.select(F.col("id").alias("question_id"), F.col("text").alias("question"))
    return pairs.join(links, "link_id").join(questions, "question_id").select("question_id", "question", "link_id", "url")


def unlinked_species_questions(store: Store) -> DataFrame:
    """Species and questions without any link."""
    pairs = store.species_questions.join(store.question_links.select("question_id"), "question_id", "left_anti")
    species = store.species.select(F.col("id").alias("species_id"), F.col("name").alias("species_name"))
    questions = store.questions.select(F.col("id").alias("question_id"), F.col("text").alias("question"))
    return pairs.join(species, "species_id").join(questions, "question_id").select("species_id", "species_name", "question_id", "question")


def grouped_report(pairs: DataFrame) -> DataFrame:
    """A line for each species with its questions in order."""
    return pairs.groupBy("species_name").agg(F.array_sort(F.collect_list("question")).alias("questions"))


def snippet(context: Column, name: Column, around: int = 40) -> Column:
    """``around`` characters to both sides of the first place of ``name``, else the context's start."""
    at = F.instr(F.lower(context), F.lower(name)) - 1
    start, end = F.greatest(at - around, F.lit(0)), F.least(at + around, F.length(context))
    body = F.regexp_replace(F.substring(context, start + 1, end - start), r"^\s+|\s+$", "")
    cut = F.concat(F.when(start > 0, "... ").otherwise(""), body, F.when(end < F.length(context), " ...").otherwise(""))
    return F.when(at >= 0, cut).otherwise(F.substring(context, 1, 2 * around))


def report(store: Store) -> DataFrame:
    """Answers with species, template, URL and context, and the pairs for which no link was found."""
    species = store.species.select(F.col("id").alias("species_id"), F.col("name").alias("species"))
    questions = store.questions.select(F.col("id").alias("question_id"), F.col("text").alias("question_text"))
    asked = store.species_questions.join(species, "species_id").join(questions, "question_id")
    links = store.links.select(F.col("id").alias("link_id"), "url")
    answers = store.answers
    evidence = T.joined_evidence(F.col("evidence")) if "evidence" in answers.columns else F.lit("")
    answered = answers.withColumn("evidence_text", evidence).join(store.question_links.select(F.col("id").alias("question_link_id")), "question_link_id", "left_semi")
    rows = answered.join(asked, "question_id").join(links, "link_id")
    template = T.template_of(F.col("question_text"), F.col("species"))
    some = rows.select(
        "species", template.alias("question"), F.col("answer_text").alias("answer"), "reason", F.col("evidence_text").alias("evidence"), "url",
        urls.host(F.col("url")).alias("host"), snippet(F.col("context"), F.col("species")).alias("context_example"), F.col("id").alias("answer_id"), "question_id",
    )
    none = asked.join(store.question_links.select("question_id"), "question_id", "left_anti")
    null = F.lit(None).cast("string")
    empty = none.select(
        "species", template.alias("question"), F.lit(NO_LINKS[0]).alias("answer"), F.lit(NO_LINKS[1]).alias("reason"), F.lit(NO_LINKS[2]).alias("evidence"),
        null.alias("url"), null.alias("host"), null.alias("context_example"), F.lit(None).cast("long").alias("answer_id"), "question_id",
    )
    return some.unionByName(empty)


def new_contents(scraped: DataFrame, content: DataFrame | None = None) -> DataFrame:
    """Rows (content_hash, text) to insert: one for each hash that isn't there yet."""
    hashed = scraped.select(T.content_hash(F.col("text")).alias("content_hash"), "text").dropDuplicates(["content_hash"])
    return hashed if content is None else hashed.join(content.select("content_hash"), "content_hash", "left_anti")


def upsert_links(links: DataFrame, scraped: DataFrame) -> DataFrame:
    """url and content_id after the scrape: the last result of a URL (by seq) replaces what was there."""
    new = scraped.groupBy("url").agg(F.max_by("content_id", "seq").alias("new_content"))
    return links.select("url", "content_id").join(new, "url", "full_outer").select("url", F.coalesce("new_content", "content_id").alias("content_id"))


def new_question_links(results: DataFrame, links: DataFrame, question_links: DataFrame) -> DataFrame:
    """Pairs (question_id, url) that aren't linked yet; repeats within the results count once."""
    known = question_links.join(links.select(F.col("id").alias("link_id"), "url"), "link_id").select("question_id", "url")
    return results.select("question_id", "url").distinct().join(known, ["question_id", "url"], "left_anti")


def dry_run(expanded: DataFrame, species: DataFrame, questions: DataFrame, mapping: DataFrame) -> DataFrame:
    """Counts of the species, questions and pairs that an insert would create."""
    names = expanded.select(F.col("species").alias("name")).distinct().join(species.select("name"), "name", "left_anti")
    texts = expanded.select(F.col("question").alias("text")).distinct().join(questions.select("text"), "text", "left_anti")
    named = mapping.join(species.select(F.col("id").alias("species_id"), F.col("name").alias("species")), "species_id").join(
        questions.select(F.col("id").alias("question_id"), F.col("text").alias("question")), "question_id")
    pairs = expanded.select("species", "question").distinct().join(named.select("species", "question"), ["species", "question"], "left_anti")
    counts = [d.agg(F.count("*").alias(n)) for d, n in ((names, "new_species"), (texts, "new_questions"), (pairs, "new_pairs"))]
    return counts[0].crossJoin(counts[1]).crossJoin(counts[2])  # three single rows


def get_or_create(have: DataFrame, wanted: DataFrame, key: str, update: str | None = None) -> DataFrame:
    """``have`` with new keys appended (ids count on from the largest, in the order of the keys) and ``update`` replaced where it is given.

    New keys are numbered by their first two characters apart, and these few groups by how many keys come before.
    """
    columns = have.columns
    wanted = wanted.dropDuplicates([key])
    top = have.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    fresh = wanted.join(have.select(key), key, "left_anti").crossJoin(F.broadcast(top)).withColumn("__head", F.substring(F.col(key).cast("string"), 1, 2))
    heads = fresh.groupBy("__head").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__head").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("__head", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__head").orderBy(key))
    fresh = fresh.withColumn("__own", own).join(heads, "__head").withColumn("id", F.col("__own") + F.col("__before") + F.col("top"))
    if update:
        changed = wanted.select(key, F.col(update).alias("__new"))
        have = have.join(changed, key, "left").withColumn(update, F.coalesce("__new", update)).drop("__new")
    return have.select(*columns).unionByName(fresh.select(*columns))


def set_validity(content: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Validity from a table of verdicts (id, verdict); what is no number is unknown, known validity stays."""
    v = verdicts.select("id", F.col("verdict").try_cast("int").alias("__v"))
    return content.join(v, "id", "left").withColumn("is_valid", F.coalesce("is_valid", "__v")).drop("__v")


def heuristic_validity(content: DataFrame) -> DataFrame:
    """0 where the text is recognised as an error page, else null."""
    return content.withColumn("is_valid", F.when(T.is_error_text(F.col("text")), F.lit(0)))


def answer_rows(pairs: DataFrame, buffer: int = 1500, answer: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Rows to answer: pairs (question_link_id, question, keyword_phrase, text) to one row for each window.

    A pair whose text lacks the phrase gets a row that says so.  ``answer`` is the provider:
    it maps the columns question and context to the reply; the default leaves it null.
    """
    norm = T.one_line(F.col("text"))
    phrase = T.phrase_of(F.col("keyword_phrase"))
    base = pairs.withColumn("norm", norm).withColumn("phrase", phrase)
    fits = F.contains("norm", F.col("phrase"))
    off = base.where(~fits).select("question_link_id", F.lit("not relevant context").alias("answer_text"), F.concat("phrase", F.lit(" not found in the context")).alias("reason"), F.col("norm").alias("context"))
    windows = base.where(fits).withColumn("context", F.explode(windows_column(F.col("norm"), F.col("phrase"), buffer)))
    reply = answer(F.col("question"), F.col("context")) if answer else F.lit(None).cast("string")
    return off.unionByName(windows.select("question_link_id", reply.alias("answer_text"), F.lit(None).cast("string").alias("reason"), "context"))


def answer_scope(questions: DataFrame, results: DataFrame, pages: DataFrame) -> DataFrame:
    """A row for each search result of each question with its page's first 500 characters."""
    joined = questions.join(results, "question_formatted").join(pages.select("link", "content"), "link", "left")
    return joined.withColumn("scrubbed_webpage_content", F.coalesce(F.substring("content", 1, 500), F.lit(UNREAD))).drop("content")


def scrub_page(page: Column, cap: int = 8000) -> Column:
    return F.substring(T.html_text_simple(page), 1, cap)


def paired(df: DataFrame, keys: list[str], answers: str, results: str) -> DataFrame:
    """keys and the answers with the results at their places, of two array columns."""
    zipped = F.arrays_zip(F.col(answers).alias("answer"), F.col(results).alias("result"))
    return df.select(*keys, F.inline(zipped).alias("answer", "result"))


def first_seen(lines: DataFrame, place: str, value: str) -> DataFrame:
    """``lines`` without repeats: of equal values the row with the least place stays.  Order by ``place`` to read them."""
    first = lines.groupBy(value).agg(F.min(place).alias(place))
    return lines.join(first, [value, place], "left_semi").dropDuplicates([value])


def pending_classification(store: Store) -> DataFrame:
    """Contents whose validity isn't known: id and text."""
    return store.content.where("is_valid is null").select("id", "text")


def in_random_order(df: DataFrame, seed: int | None = None) -> DataFrame:
    """Rows in a random order, for a look at the data."""
    return df.orderBy(F.rand(seed))


def one_question(context: Column, question: Column, answer: Callable[[Column, Column], Column], buffer: int = 1500) -> Column:
    """The provider's answer to one question about one context."""
    return answer(question, F.substring(T.one_line(context), 1, 2 * buffer))


def ingest_metrics(pages: DataFrame, text: str = "text") -> DataFrame:
    """Numbers of pages with content and without: blank ones and those that begin with ``Error:`` are not ok."""
    bad = F.col(text).isNull() | (F.trim(text) == "") | F.col(text).startswith("Error:")
    return pages.agg(F.count_if(~bad).alias("ok"), F.count_if(bad).alias("err"))


def insert_outcome(have: DataFrame, wanted: DataFrame, key: str, value: str) -> DataFrame:
    """How many wanted rows are new, change a value, or change nothing."""
    old = have.select(F.col(key), F.col(value).alias("__old"), F.lit(True).alias("__there"))
    both = wanted.dropDuplicates([key]).join(old, key, "left")
    there, same = F.col("__there").isNotNull(), F.col(value).eqNullSafe(F.col("__old"))
    return both.agg(F.count_if(~there).alias("inserted"), F.count_if(there & ~same).alias("updated"), F.count_if(there & same).alias("skipped"))
