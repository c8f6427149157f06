"""The catalogue: each operator as a query over the raw tables, with reference SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import replies, urls
from .functions import text as T
from .functions.windows import merge_intervals, windows_column
from .operators import catalog, filters, mutate, ranking, results, traits
from .plans import raster
from .plans.expr import Transform, parse
from .plans.spec import STUDY_ID, QuerySpec
from .sources import datasets, files
from .sources.tables import Store, inline

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a function of a store under its name, with its reference SQL."""

    def add(f: Callable[[Store], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(Store(spark, sf_dir))
        if sql:
            ORACLES[key] = inline(sql)
        return f

    return add


# -- the observation service -------------------------------------------------------------

_IDS = "SELECT s.id_key, s.study_id, s.year FROM v_sample s JOIN v_study st ON st.id_key = s.study_id JOIN v_point p ON p.id_key = s.point_id"
_SITES = "SELECT study_id FROM v_sample GROUP BY study_id HAVING count(DISTINCT point_id) >= {}"
_YEARS = "SELECT study_id FROM v_sample GROUP BY study_id HAVING count(DISTINCT year) >= {}"
_OBS = "SELECT study_id FROM (SELECT study_id, year, count(id_key) AS n FROM v_sample GROUP BY study_id, year) t GROUP BY study_id HAVING min(n) >= {}"
_SEGMENT = "st.id_key IN (SELECT study_id FROM v_covariate_value WHERE covariate_defn_id = 1 AND value IN ('BUILDING', 'MACHINERY'))"
_STATUS = "s.id_key IN (SELECT sample_id FROM v_covariate_value WHERE covariate_defn_id = 3 AND value IN ('F'))"
_PLACE = "p.id_key IN (SELECT gp.point_id FROM v_geo_point gp JOIN v_geolocation g ON g.id_key = gp.geolocation_id WHERE g.geolocation_name = '{}')"
_COUNTS = "SELECT count(*) AS sample_count, count(DISTINCT study_id) AS study_count FROM ({}) x"

SEGMENT = ("Segment", ("BUILDING", "MACHINERY"))
STATUS = ("Status", ("F",))
FLAGSHIP = QuerySpec(covariates=(SEGMENT,), min_years=3, years="1995-1997, 1999")


def _select(spec: QuerySpec) -> Callable[[Store], DataFrame]:
    return lambda store: filters.apply_spec(store, spec).select("id_key", "study_id", "year")


for _name, _spec, _where in (
    ("filter_covariate_study", QuerySpec(covariates=(SEGMENT,)), _SEGMENT),
    ("filter_covariate_sample", QuerySpec(covariates=(STATUS,)), _STATUS),
    ("filter_covariate_and", QuerySpec(covariates=(SEGMENT, STATUS)), f"{_SEGMENT} AND {_STATUS}"),
    ("filter_unknown_covariate", QuerySpec(covariates=(("Nothing", ("x",)), STATUS)), _STATUS),
    ("filter_study_id", QuerySpec(covariates=((STUDY_ID, ("Customer#000000001", "Customer#000000007", "Customer#1", "Customer#7")),)), "st.name IN ('Customer#000000001', 'Customer#000000007', 'Customer#1', 'Customer#7')"),
    ("filter_numeric", QuerySpec(comparisons=(("Month", ">", 9.0),)), "s.id_key IN (SELECT sample_id FROM v_covariate_value WHERE covariate_defn_id = 5 AND TRY_CAST(value AS DOUBLE) > 9)"),
    ("filter_center_box", QuerySpec(center_point="(-40.5, 20)", center_buffer="120"), "p.latitude BETWEEN -40.5 - 30 AND -40.5 + 30 AND p.longitude BETWEEN 20 - 30 AND 20 + 30"),
    ("filter_corner_box", QuerySpec(upper_left="(0, -100)", lower_right="(-80, 100)"), "p.latitude BETWEEN -80 AND 0 AND p.longitude BETWEEN -100 AND 100"),
    ("filter_country", QuerySpec(country="NATION_3"), _PLACE.format("NATION_3")),
    ("filter_continent", QuerySpec(continent="ASIA"), _PLACE.format("ASIA")),
    ("filter_year_set", QuerySpec(years="1995, 1997-1998 2000"), "s.year IN (1995, 1997, 1998, 2000)"),
    ("min_sites", QuerySpec(min_sites=12), f"s.study_id IN ({_SITES.format(12)})"),
    ("min_years", QuerySpec(min_years=7), f"s.study_id IN ({_YEARS.format(7)})"),
    ("min_obs_per_year", QuerySpec(min_obs_per_year=2), f"s.study_id IN ({_OBS.format(2)})"),
    ("filter_combined", QuerySpec(covariates=(SEGMENT, STATUS), upper_left="80 -170", lower_right="-80 170", min_sites=3, min_years=3, min_obs_per_year=1, years="1995-1999"),
     f"{_SEGMENT} AND {_STATUS} AND p.latitude BETWEEN -80 AND 80 AND p.longitude BETWEEN -170 AND 170 AND s.study_id IN ({_SITES.format(3)}) AND s.study_id IN ({_YEARS.format(3)}) AND s.study_id IN ({_OBS.format(1)}) AND s.year BETWEEN 1995 AND 1999"),
):
    query(f"{_IDS} WHERE {_where}", _name)(_select(_spec))


@query(_COUNTS.format(f"{_IDS} WHERE {_SEGMENT} AND s.study_id IN ({_YEARS.format(3)}) AND s.year IN (1995, 1996, 1997, 1999)"))
def count_samples_studies(store: Store) -> DataFrame:
    return filters.count_samples_studies(filters.apply_spec(store, FLAGSHIP))


_PAGE_SPEC = QuerySpec(covariates=(STATUS,))
_NAMES = ("Status", "Priority", "Month")
_WIDE = "SELECT sample_id, " + ", ".join(f"max(CASE WHEN d.name = '{n}' THEN v.value END) AS \"{n}\"" for n in _NAMES) + " FROM v_covariate_value v JOIN v_covariate_defn d ON d.id_key = v.covariate_defn_id WHERE sample_id IS NOT NULL GROUP BY sample_id"
_FACT = "SELECT s.id_key, st.name AS study, s.study_id, s.observation, p.latitude, p.longitude, s.year FROM v_sample s JOIN v_study st ON st.id_key = s.study_id JOIN v_point p ON p.id_key = s.point_id"


@query(f"""WITH f AS ({_FACT} WHERE {_STATUS}), pg AS (SELECT * FROM f ORDER BY id_key LIMIT 100 OFFSET 200), w AS ({_WIDE})
SELECT 200 + row_number() OVER (ORDER BY pg.id_key) AS row_number, pg.id_key, pg.study, pg.observation, pg.latitude, pg.longitude, pg.year, w."Status", w."Priority", w."Month"
FROM pg LEFT JOIN w ON w.sample_id = pg.id_key""")
def page_samples(store: Store) -> DataFrame:
    return results.page_samples(store, filters.apply_spec(store, _PAGE_SPEC), 200, 100, _NAMES)


@query(f"""WITH f AS ({_FACT} WHERE {_STATUS}), pg AS (SELECT *, 200 + row_number() OVER (ORDER BY id_key) AS rn FROM (SELECT * FROM f ORDER BY id_key LIMIT 100 OFFSET 200) x),
g AS (SELECT study_id, study AS study_name, min(rn) AS first_row FROM pg GROUP BY study_id, study)
SELECT row_number() OVER (ORDER BY first_row) AS row_number, study_id, study_name, first_row FROM g""")
def page_studies(store: Store) -> DataFrame:
    return results.page_studies(filters.apply_spec(store, _PAGE_SPEC), 200, 100)


@query(f"SELECT count(*) AS total, 300 < count(*) AS has_more FROM ({_IDS} WHERE {_STATUS}) x")
def has_more(store: Store) -> DataFrame:
    return results.has_more(filters.apply_spec(store, _PAGE_SPEC), 200, 100)


@query(f"""WITH f AS ({_FACT} WHERE {_STATUS}), w AS ({_WIDE})
SELECT f.id_key, f.study, f.observation, f.latitude, f.longitude, f.year, coalesce(w."Status", 'None') AS "Status", coalesce(w."Priority", 'None') AS "Priority", coalesce(w."Month", 'None') AS "Month"
FROM f LEFT JOIN w ON w.sample_id = f.id_key""")
def export_samples_wide(store: Store) -> DataFrame:
    return results.export_samples(store, filters.apply_spec(store, _PAGE_SPEC), _NAMES)


@query(f"""WITH f AS (SELECT DISTINCT study_id, study FROM ({_FACT} WHERE {_STATUS}) x),
w AS (SELECT study_id, max(CASE WHEN covariate_defn_id = 1 THEN value END) AS "Segment", max(CASE WHEN covariate_defn_id = 2 THEN value END) AS "Acctbal" FROM v_covariate_value WHERE study_id IS NOT NULL GROUP BY study_id)
SELECT f.study_id, f.study, coalesce(w."Segment", '') AS "Segment", coalesce(w."Acctbal", '') AS "Acctbal" FROM f LEFT JOIN w ON w.study_id = f.study_id""")
def export_studies_wide(store: Store) -> DataFrame:
    return results.export_studies(store, filters.apply_spec(store, _PAGE_SPEC), ("Segment", "Acctbal"))


@query(f"SELECT DISTINCT d.name, d.display_order FROM v_covariate_defn d JOIN v_covariate_value v ON v.covariate_defn_id = d.id_key WHERE v.sample_id IN (SELECT id_key FROM ({_IDS} WHERE {_STATUS}) x)")
def export_columns(store: Store) -> DataFrame:
    return results.covariate_names(store, results.SAMPLE_LEVEL, filters.apply_spec(store, _PAGE_SPEC))


@query("SELECT DISTINCT d.name, d.display_order FROM v_covariate_defn d JOIN v_covariate_value v ON v.covariate_defn_id = d.id_key WHERE v.study_id IS NOT NULL")
def all_study_columns(store: Store) -> DataFrame:
    return results.covariate_names(store, results.STUDY_LEVEL)


@query("""SELECT name, string_agg(value, ',' ORDER BY value) AS joined FROM (SELECT DISTINCT d.name, v.value FROM v_covariate_defn d JOIN v_covariate_value v ON v.covariate_defn_id = d.id_key
WHERE d.queryable AND d.search_by_unique) x GROUP BY name""")
def searchable_values(store: Store) -> DataFrame:
    return catalog.searchable_values(store).select("name", F.array_join("values", ",").alias("joined"))


@query("SELECT name, CASE covariate_type WHEN 0 THEN 'STRING' WHEN 1 THEN 'FLOAT' ELSE 'INTEGER' END AS type_name FROM v_covariate_defn WHERE queryable AND NOT search_by_unique")
def continuous_covariates(store: Store) -> DataFrame:
    return catalog.continuous_covariates(store)


@query("SELECT *, row_number() OVER (ORDER BY covariate_association, display_order, lower(name)) AS position FROM v_covariate_defn")
def covariate_listing(store: Store) -> DataFrame:
    return catalog.covariate_listing(store)


@query("SELECT DISTINCT geolocation_name FROM v_geolocation WHERE geolocation_type = 'COUNTRY'")
def distinct_countries(store: Store) -> DataFrame:
    return catalog.places(store, "COUNTRY")


@query("SELECT DISTINCT geolocation_name FROM v_geolocation WHERE geolocation_type = 'CONTINENT'")
def distinct_continents(store: Store) -> DataFrame:
    return catalog.places(store, "CONTINENT")


@query("SELECT DISTINCT name FROM v_study")
def distinct_studies(store: Store) -> DataFrame:
    return catalog.study_names(store)


@query("SELECT count(*) AS n FROM v_sample")
def sample_count(store: Store) -> DataFrame:
    return store.sample.agg(F.count("*").alias("n"))


@query("SELECT study_id, string_agg(DISTINCT CAST(year AS VARCHAR), ',' ORDER BY CAST(year AS VARCHAR)) AS joined FROM v_sample GROUP BY study_id")
def group_concat_distinct(store: Store) -> DataFrame:
    return catalog.group_concat_distinct(store.sample.select("study_id", F.col("year").cast("string").alias("year")), "study_id", "year")


@query("""SELECT DISTINCT d.name, CASE WHEN TRY_CAST(v.value AS DOUBLE) IS NOT NULL THEN 'true' ELSE lower(v.value) END AS value FROM v_covariate_value v JOIN v_covariate_defn d ON d.id_key = v.covariate_defn_id
WHERE v.value IS NOT NULL AND lower(v.value) <> 'null'""")
def unique_value_summary(store: Store) -> DataFrame:
    return catalog.unique_value_summary(store)


@query("""SELECT name, display_order FROM v_covariate_defn d WHERE NOT hidden AND (covariate_association = 1 OR show_in_point_table)
AND (always_display OR id_key IN (SELECT covariate_defn_id FROM v_covariate_value WHERE sample_id IS NOT NULL AND value IS NOT NULL AND lower(value) <> 'null'))""")
def display_columns(store: Store) -> DataFrame:
    return catalog.display_columns(store, results.SAMPLE_LEVEL)


@query("SELECT id_key, CASE WHEN id_key = 2 THEN 'Balance' ELSE name END AS name, editable_name, CASE WHEN id_key = 2 THEN 9.5 ELSE display_order END AS display_order, description, queryable, always_display, hidden OR id_key = 4 AS hidden, show_in_point_table, search_by_unique, covariate_type, covariate_association FROM v_covariate_defn")
def covariate_update(store: Store) -> DataFrame:
    changes = store.spark.createDataFrame([(2, "Balance", 9.5, None), (4, None, None, True)], "id_key int, name string, display_order double, hidden boolean")
    return catalog.update_covariates(store.covariate_defn, changes)


# -- the question-answering corpus -------------------------------------------------------

_LINES = (
    '"[full_species_list]" can fly | Can [full_species_list] fly?', '"[pest_list]" pest | Is [pest_list] a pest?', "# comment", "",
    '"[predator_list]" eats "[pest_list]" | Does [predator_list] eat [pest_list]?', "no template",
)


def _names(store: Store) -> dict[str, DataFrame]:
    s = store.species
    return {"full_species_list": s.select("name"), "pest_list": s.where("id % 5 = 0").select("name"), "predator_list": s.where("id % 5 = 1").select("name")}


@query("""SELECT name AS species, '"' || name || '" can fly' AS keyword_phrase, 'Can ' || name || ' fly?' AS question FROM v_species
UNION ALL SELECT name, '"' || name || '" pest', 'Is ' || name || ' a pest?' FROM v_species WHERE id % 5 = 0
UNION ALL SELECT a.name || ' & ' || b.name, '"' || a.name || '" eats "' || b.name || '"', 'Does ' || a.name || ' eat ' || b.name || '?' FROM v_species a, v_species b WHERE a.id % 5 = 1 AND b.id % 5 = 0""")
def template_expand(store: Store) -> DataFrame:
    return traits.expand_templates(store.spark.createDataFrame([(x,) for x in _LINES], "value string"), _names(store))


@query("""WITH s AS (SELECT * FROM (VALUES ('pest', 'Is [species] a pest?'), ('flight', 'Can [species] fly?')) AS t(question_scope, question_body))
SELECT name AS species, question_scope, question_body, replace(question_body, '[species]', name) AS question_formatted FROM v_species CROSS JOIN s""")
def species_cross_questions(store: Store) -> DataFrame:
    lines = store.spark.createDataFrame([("pest: Is [species] a pest?",), ("flight: Can [species] fly?",)], "value string")
    return traits.species_questions(store.species.select(F.col("name").alias("species")), files.scoped_questions(lines))


@query("WITH c AS (SELECT * FROM (VALUES ('NATION_1', 'Nation One'), ('NATION_2', 'Nation Two')) AS t(original, corrected)) SELECT name, coalesce(corrected, name) AS fixed FROM v_species LEFT JOIN c ON original = name")
def spelling_fix(store: Store) -> DataFrame:
    lines = store.spark.createDataFrame([("NATION_1:Nation One",), ("NATION_2,Nation Two",)], "value string")
    return traits.fix_spelling(store.species.select("name"), files.corrections_of(lines))


@query("SELECT name AS species, keyword_phrase, text AS question FROM v_questions q JOIN v_species_questions sq ON sq.question_id = q.id JOIN v_species s ON s.id = sq.species_id")
def parse_expanded_lines(store: Store) -> DataFrame:
    q = store.questions.select(F.col("id").alias("question_id"), "keyword_phrase", F.col("text").alias("question"))
    s = store.species.select(F.col("id").alias("species_id"), F.col("name").alias("species"))
    return traits.parse_expanded(traits.expanded_line(q.join(store.species_questions, "question_id").join(s, "species_id")))


@query("SELECT id, keyword_phrase FROM v_questions q WHERE NOT EXISTS (SELECT 1 FROM v_question_links l WHERE l.question_id = q.id)")
def pending_questions(store: Store) -> DataFrame:
    return traits.pending_questions(store)


@query("SELECT l.id, l.url FROM v_links l LEFT JOIN v_content c ON c.id = l.content_id WHERE l.fetch_error IS NULL AND c.text IS NULL")
def unscraped_links(store: Store) -> DataFrame:
    return traits.unscraped_links(store)


@query("""SELECT ql.id AS question_link_id, ql.question_id, ql.link_id FROM v_question_links ql JOIN v_links l ON l.id = ql.link_id JOIN v_content c ON c.id = l.content_id
LEFT JOIN v_answers a ON a.question_id = ql.question_id AND a.link_id = ql.link_id WHERE (c.is_valid IS NULL OR c.is_valid <> 0) AND a.id IS NULL""")
def unanswered_pairs(store: Store) -> DataFrame:
    return traits.unanswered(store)


@query("""SELECT ql.question_id, q.text AS question, ql.link_id, l.url FROM v_question_links ql JOIN v_questions q ON q.id = ql.question_id JOIN v_links l ON l.id = ql.link_id JOIN v_content c ON c.id = l.content_id
LEFT JOIN v_answers a ON a.question_link_id = ql.id WHERE c.is_valid = 1 AND a.id IS NULL""")
def missing_answers(store: Store) -> DataFrame:
    return traits.missing_answers(store)


_UNLINKED = """SELECT s.id AS species_id, s.name AS species_name, q.id AS question_id, q.text AS question FROM v_species s JOIN v_species_questions sq ON sq.species_id = s.id JOIN v_questions q ON q.id = sq.question_id
LEFT JOIN v_question_links ql ON ql.question_id = q.id WHERE ql.id IS NULL"""


@query(_UNLINKED)
def species_questions_without_links(store: Store) -> DataFrame:
    return traits.unlinked_species_questions(store)


@query(f"SELECT species_name, string_agg(question, '; ' ORDER BY question) AS questions FROM ({_UNLINKED}) x GROUP BY species_name")
def unlinked_grouped(store: Store) -> DataFrame:
    return traits.grouped_report(traits.unlinked_species_questions(store)).select("species_name", F.array_join("questions", "; ").alias("questions"))


@query("""WITH asked AS (SELECT s.name AS species, q.id AS question_id, q.text AS question_text FROM v_species s JOIN v_species_questions sq ON sq.species_id = s.id JOIN v_questions q ON q.id = sq.question_id),
r AS (SELECT asked.*, a.id AS answer_id, a.answer_text, a.reason, l.url, a.context, strpos(lower(a.context), lower(species)) - 1 AS pos_, length(a.context) AS n
 FROM asked JOIN v_answers a ON a.question_id = asked.question_id JOIN v_question_links ql ON ql.id = a.question_link_id JOIN v_links l ON l.id = a.link_id),
c AS (SELECT *, greatest(pos_ - 40, 0) AS b, least(pos_ + 40, n) AS e FROM r)
SELECT species, replace(question_text, species, '[species]') AS question, answer_text AS answer, reason, '' AS evidence, url, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS host,
 CASE WHEN pos_ >= 0 THEN CASE WHEN b > 0 THEN '... ' ELSE '' END || regexp_replace(substr(context, b + 1, e - b), '^\\s+|\\s+$', '', 'g') || CASE WHEN e < n THEN ' ...' ELSE '' END ELSE substr(context, 1, 80) END AS context_example, answer_id, question_id FROM c
UNION ALL SELECT species, replace(question_text, species, '[species]'), 'none', 'no links found in search', 'n/a', NULL, NULL, NULL, NULL, question_id FROM asked WHERE question_id NOT IN (SELECT question_id FROM v_question_links)""")
def qna_report(store: Store) -> DataFrame:
    return traits.report(store)


@query("SELECT DISTINCT sha256(text) AS content_hash, text FROM documents")
def content_dedup(store: Store) -> DataFrame:
    return traits.new_contents(store.raw("documents"))


@query("""SELECT l.url, coalesce(n.c, l.content_id) AS content_id FROM v_links l LEFT JOIN (SELECT url, max_by(id + 7, id) AS c FROM v_links WHERE id % 3 = 0 GROUP BY url) n ON n.url = l.url""")
def link_upsert(store: Store) -> DataFrame:
    scraped = store.links.where("id % 3 = 0").select("url", (F.col("id") + 7).alias("content_id"), F.col("id").alias("seq"))
    return traits.upsert_links(store.links, scraped)


@query("""WITH r AS (SELECT DISTINCT doc_id % 100 AS question_id, 'https://' || source || '.example.org/' || doc_id AS url FROM documents),
k AS (SELECT ql.question_id, l.url FROM v_question_links ql JOIN v_links l ON l.id = ql.link_id)
SELECT r.question_id, r.url FROM r WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.question_id = r.question_id AND k.url = r.url)""")
def link_dedup_insert(store: Store) -> DataFrame:
    found = store.raw("documents").select((F.col("doc_id") % 100).alias("question_id"), F.concat(F.lit("https://"), "source", F.lit(".example.org/"), F.col("doc_id").cast("string")).alias("url"))
    return traits.new_question_links(found.union(found), store.links, store.question_links)


@query("""WITH e AS (SELECT name AS species, 'Can ' || name || ' fly?' AS question FROM v_species UNION ALL SELECT name || '!', 'Does ' || name || ' swim?' FROM v_species)
SELECT (SELECT count(DISTINCT species) FROM e WHERE species NOT IN (SELECT name FROM v_species)) AS new_species, (SELECT count(DISTINCT question) FROM e WHERE question NOT IN (SELECT text FROM v_questions)) AS new_questions,
(SELECT count(*) FROM (SELECT DISTINCT species, question FROM e EXCEPT SELECT s.name, q.text FROM v_species_questions sq JOIN v_species s ON s.id = sq.species_id JOIN v_questions q ON q.id = sq.question_id) x) AS new_pairs""")
def insert_dry_run(store: Store) -> DataFrame:
    n = F.col("name")
    old = store.species.select(n.alias("species"), F.concat(F.lit("Can "), n, F.lit(" fly?")).alias("question"))
    new = store.species.select(F.concat(n, F.lit("!")).alias("species"), F.concat(F.lit("Does "), n, F.lit(" swim?")).alias("question"))
    return traits.dry_run(old.union(new), store.species, store.questions, store.species_questions)


@query("""SELECT id, name FROM v_species UNION ALL SELECT (SELECT max(id) FROM v_species) + row_number() OVER (ORDER BY name), name FROM (SELECT 'Aphis' AS name UNION ALL SELECT 'Bombus') x""")
def get_or_create_species(store: Store) -> DataFrame:
    wanted = store.spark.createDataFrame([("Bombus",), ("Aphis",), ("Aphis",), ("NATION_1",)], "name string")
    return traits.get_or_create(store.species, wanted, "name")


_GONE = "SELECT sq.question_id FROM v_species_questions sq JOIN v_species s ON s.id = sq.species_id WHERE s.name IN ('NATION_1', 'NATION_22')"


def _purge(store: Store):
    return mutate.purge(store, store.spark.createDataFrame([("NATION_1",), ("NATION_22",)], "name string"))


@query(f"""SELECT 'answers' AS table_name, count(*) AS deleted FROM v_answers WHERE question_id IN ({_GONE}) UNION ALL SELECT 'question_links', count(*) FROM v_question_links WHERE question_id IN ({_GONE})
UNION ALL SELECT 'species_questions', count(*) FROM ({_GONE}) x UNION ALL SELECT 'species', count(*) FROM v_species WHERE name IN ('NATION_1', 'NATION_22')
UNION ALL SELECT 'questions', count(*) FROM v_questions WHERE id NOT IN (SELECT sq.question_id FROM v_species_questions sq JOIN v_species s ON s.id = sq.species_id WHERE s.name NOT IN ('NATION_1', 'NATION_22'))
 AND id NOT IN (SELECT question_id FROM v_question_links WHERE question_id NOT IN ({_GONE}))""")
def purge_counts(store: Store) -> DataFrame:
    return _purge(store)[1]


@query(f"SELECT id, question_id, link_id FROM v_question_links WHERE question_id NOT IN ({_GONE})")
def purge_survivors(store: Store) -> DataFrame:
    return _purge(store)[0]["question_links"].select("id", "question_id", "link_id")


@query("SELECT s.name, count(sq.question_id) AS questions FROM v_species s LEFT JOIN v_species_questions sq ON sq.species_id = s.id WHERE s.name IN ('NATION_1', 'NATION_22') GROUP BY s.name")
def purge_preview(store: Store) -> DataFrame:
    return mutate.preview(store, store.spark.createDataFrame([("NATION_1",), ("NATION_22",)], "name string"))


@query("SELECT id, url, content_id, CASE WHEN id % 5 = 0 THEN substr(repeat('error ', 500), 1, 2000) ELSE fetch_error END AS fetch_error FROM v_links")
def fetch_error_update(store: Store) -> DataFrame:
    errors = store.links.where("id % 5 = 0").select("id", F.lit("error " * 500).alias("error"))
    return mutate.set_fetch_error(store.links, errors).select("id", "url", "content_id", "fetch_error")


@query("SELECT c.id, CASE WHEN c.is_valid IS NOT NULL THEN c.is_valid WHEN c.id % 3 = 0 THEN NULL ELSE CAST(c.id % 2 AS INT) END AS is_valid FROM v_content c")
def validity_update(store: Store) -> DataFrame:
    verdicts = store.content.select("id", F.when(F.col("id") % 3 == 0, "error").otherwise((F.col("id") % 2).cast("string")).alias("verdict"))
    return traits.set_validity(store.content, verdicts).select("id", "is_valid")


#: Written out once more, so that the reference SQL does not depend on the code's list (fixed values).
_ERROR_LIST = (
    "you need to enable javascript", "please enable javascript", "403 forbidden", "401 unauthorized", "404 not found", "too many requests", "service unavailable",
    "bad gateway", "gateway timeout", "captcha", "are you a robot", "bot detection", "bot detected", "cloudflare", "akamai", "imperva",
    "click here if you are not redirected", "internal server error", "we''ve detected unusual activity from your network.",
)
_ERRORS = " OR ".join(f"contains(lower(text), '{p}')" for p in _ERROR_LIST)
_FLAT = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


@query(f"SELECT doc_id, CASE WHEN text IS NULL OR {_FLAT} = '' THEN true WHEN {_ERRORS} THEN true WHEN length({_FLAT}) < 40 THEN true END AS is_error FROM documents")
def validity_heuristic(store: Store) -> DataFrame:
    return store.raw("documents").select("doc_id", T.is_error_text(F.col("text")).alias("is_error"))


_SOFT = " OR ".join(f"contains(lower(url || chr(10) || html), '{p}')" for p in T.SOFT_BLOCKS)


@query(f"SELECT page_id, {_SOFT} AS blocked FROM pages")
def soft_block(store: Store) -> DataFrame:
    return store.raw("pages").select("page_id", T.soft_block(F.col("url"), F.col("html")).alias("blocked"))


_PDF_URLS = "SELECT page_id, url || CASE page_id % 5 WHEN 0 THEN '/a.PDF' WHEN 1 THEN '/download/x?format=pdf' WHEN 2 THEN '/pdf/view' ELSE '' END AS url FROM pages"


@query(f"""SELECT page_id, ends_with(lower(url), '.pdf') OR ((contains(lower(url), '/pdf') OR contains(lower(url), 'download')) AND contains(lower(url), 'pdf')) OR page_id % 7 = 0 AS looks_pdf,
ends_with(lower(url), '.pdf') OR contains(lower(url), 'contenttype=pdf') OR contains(lower(url), 'format=pdf') AS probable_pdf FROM ({_PDF_URLS}) x""")
def pdf_url(store: Store) -> DataFrame:
    k = F.col("page_id") % 5
    url = F.concat("url", F.when(k == 0, "/a.PDF").when(k == 1, "/download/x?format=pdf").when(k == 2, "/pdf/view").otherwise(""))
    kind = F.when(F.col("page_id") % 7 == 0, "Application/PDF; charset=x")
    return store.raw("pages").select("page_id", urls.is_pdf_response(kind, url).alias("looks_pdf"), urls.is_probable_pdf(url).alias("probable_pdf"))


def _strip_sql(tags: tuple[str, ...]) -> str:
    t = "html"
    for tag in tags:
        t = rf"regexp_replace({t}, '(?is)<{tag}[^>]*>.*?</{tag}>', ' ', 'g')"
    return t


_BLOCKS = rf"regexp_replace(regexp_replace({_strip_sql(('script', 'style', 'noscript'))}, '(?i)</?(?:p|div|br|li|h[1-6]|tr|th|td)\b[^>]*>', chr(10), 'g'), '(?s)<[^>]+>', ' ', 'g')"


@query(rf"SELECT page_id, regexp_replace(regexp_replace(regexp_replace({_BLOCKS}, '[ \t\f\v]+', ' ', 'g'), '\n\s*\n+', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM pages")
def html_to_text(store: Store) -> DataFrame:
    return store.raw("pages").select("page_id", T.html_to_text(F.col("html"), entities=False).alias("text"))


_ENTITIES = f"regexp_replace(replace(replace(replace({_BLOCKS}, '&copy;', chr(169)), '&middot;', chr(183)), '&quot;', chr(34)), '&amp;?', '&', 'g')"


@query(rf"SELECT page_id, regexp_replace(regexp_replace(regexp_replace({_ENTITIES}, '[ \t\f\v]+', ' ', 'g'), '\n\s*\n+', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM pages")
def html_to_text_entities(store: Store) -> DataFrame:
    return store.raw("pages").select("page_id", T.html_to_text(F.col("html")).alias("text"))


@query(rf"SELECT page_id, substr(trim(regexp_replace(regexp_replace({_strip_sql(('script', 'style'))}, '(?s)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), 1, 8000) AS text FROM pages")
def html_text_v1(store: Store) -> DataFrame:
    return store.raw("pages").select("page_id", traits.scrub_page(F.col("html")).alias("text"))


@query(r"""SELECT page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS host, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS origin,
regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || regexp_extract(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '^(.*/)', 1) AS parent FROM pages""")
def url_parts(store: Store) -> DataFrame:
    u = F.col("url")
    return store.raw("pages").select("page_id", urls.host(u).alias("host"), urls.origin(u).alias("origin"), urls.parent(u).alias("parent"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(url, '[^A-Za-z0-9.:-]', '_', 'g') || CASE page_id % 3 WHEN 0 THEN ' of 5% é' ELSE '' END, '[_ ]+', ' ', 'g')) AS title FROM pages")
def publication_title(store: Store) -> DataFrame:
    """Titles made of the pages' URLs; a third have escapes, and a percent sign that is none."""
    more = F.when(F.col("page_id") % 3 == 0, "%20of+5%_%C3%A9").otherwise("")
    slug = F.concat(F.lit("https://x.org/publication/"), F.col("page_id").cast("string"), F.lit("_"), F.regexp_replace("url", "[^A-Za-z0-9.:-]", "_"), more, F.lit("__(1999)?a=1"))
    return store.raw("pages").select("page_id", urls.publication_title(slug).alias("title"))


@query(r"SELECT doc_id, regexp_replace(text, '[^\x00-\x7F]', '', 'g') AS clean FROM documents")
def ascii_sanitize(store: Store) -> DataFrame:
    return store.raw("documents").select("doc_id", T.ascii_only(F.col("text")).alias("clean"))


_PUNCT = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"


@query(rf"""SELECT doc_id, coalesce(array_to_string(list_filter(string_split(trim(regexp_replace(translate(text, '{_PUNCT}', ''), '\s+', ' ', 'g')), ' '), lambda w: regexp_full_match(w, '[A-Za-z]+')), ' '), '') AS words FROM documents""")
def valid_words(store: Store) -> DataFrame:
    return store.raw("documents").select("doc_id", T.valid_words(F.col("text")).alias("words"))


@query(f"SELECT doc_id, translate(lower(source), '{_PUNCT}', '') AS bare, replace(source, 's', '[species]') AS template, md5(source) AS cache_key, substr(sha256(source), 1, 8) AS short_key FROM documents")
def small_text_functions(store: Store) -> DataFrame:
    s = F.col("source")
    return store.raw("documents").select("doc_id", T.no_punctuation(F.lower(s)).alias("bare"), F.replace(s, F.lit("s"), F.lit("[species]")).alias("template"), T.cache_key(s).alias("cache_key"), T.short_key(s).alias("short_key"))


@query(r"""SELECT ql.id, contains(trim(regexp_replace(lower(d.text), '\s+', ' ', 'g')), string_split(lower('x ' || regexp_replace(substr(d.text, 1, 3), '["\s]', 'e', 'g') || CASE WHEN ql.id % 3 = 0 THEN 'q' ELSE '' END || 'e'), ' ')[-1]) AS relevant
FROM v_question_links ql JOIN documents d ON d.doc_id = ql.link_id""")
def relevance(store: Store) -> DataFrame:
    """Every link against a phrase made of its text's first letters; a third have a letter more."""
    d = store.raw("documents").select(F.col("doc_id").alias("link_id"), "text")
    head = F.regexp_replace(F.substring("text", 1, 3), r'["\s]', "e")
    more = F.when(F.col("id") % 3 == 0, "q").otherwise("")
    return store.question_links.join(d, "link_id").select("id", T.is_relevant(F.col("text"), F.concat(F.lit('"x '), head, more, F.lit('e" pest'))).alias("relevant"))


_NORM = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"
#: Letters that the word boundaries of the other engine do not know, as ones that it knows and lower case lacks.
_KNOWN = "translate({}, 'éèñßêçíöüóä', 'ABCDEFGHIJK')"


def _windows_sql(texts: str, phrase: str, buffer: int, key: str) -> str:
    """(key, i, context) of the windows of ``phrase`` in the column norm of ``texts``, by positions of blanks."""
    return f"""t AS (SELECT {key}, norm, {_KNOWN.format("norm")} AS m, {_KNOWN.format(phrase)} AS phrase FROM {texts}),
g AS (SELECT {key}, norm, length(norm) AS n, string_split_regex(m, '\\b' || regexp_escape(phrase) || '\\b') AS gaps, length(phrase) AS k FROM t WHERE phrase <> ''),
h AS (SELECT {key}, norm, n, unnest(range(1, len(gaps))) AS i, list_transform(gaps, lambda x: length(x)) AS gaps, k FROM g),
p AS (SELECT {key}, norm, n, i, list_sum(gaps[1:i]) + (i - 1) * k AS s, list_sum(gaps[1:i]) + i * k AS e FROM h),
w AS (SELECT {key}, norm, n, i, greatest(s - {buffer}, 0) AS s, least(e + {buffer}, n) AS e FROM p),
c AS (SELECT {key}, norm, n, i, CASE WHEN strpos(reverse(substr(norm, 1, (s + 1)::BIGINT)), ' ') = 0 THEN 0 ELSE s + 1 - strpos(reverse(substr(norm, 1, (s + 1)::BIGINT)), ' ') END AS s,
 CASE WHEN e >= n THEN n WHEN strpos(substr(norm, e::BIGINT), ' ') = 0 THEN n ELSE e + strpos(substr(norm, e::BIGINT), ' ') - 1 END AS e FROM w),
f AS (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY {key} ORDER BY i) <= 100 THEN 0 ELSE 1 END AS new_ FROM c),
isl AS (SELECT *, sum(new_) OVER (PARTITION BY {key} ORDER BY i) AS island FROM f),
mrg AS (SELECT {key}, island, any_value(norm) AS norm, any_value(n) AS n, min(s) AS s, max(e) AS e FROM isl GROUP BY {key}, island),
windows AS (SELECT {key}, island, CASE WHEN s > 0 THEN '... ' ELSE '' END || trim(substr(norm, (s + 1)::BIGINT, (e - s)::BIGINT)) || CASE WHEN e < n THEN ' ...' ELSE '' END AS context FROM mrg)"""


_FIRST_WORD = _windows_sql(f"(SELECT doc_id, {_NORM} AS norm FROM documents)", "string_split(norm, ' ')[1]", 200, "doc_id")


@query(f"WITH {_FIRST_WORD} SELECT doc_id, context FROM windows")
def context_windows(store: Store) -> DataFrame:
    d = store.raw("documents").select("doc_id", T.one_line(F.col("text")).alias("norm"))
    # the outer form: the other has a filter that would find all windows once more
    return d.select("doc_id", F.explode_outer(windows_column(F.col("norm"), F.element_at(F.split("norm", " "), 1), 200)).alias("context")).where("context is not null")


@query(f"WITH {_FIRST_WORD} SELECT doc_id, context FROM windows WHERE island = 1")
def context_windows_limited(store: Store) -> DataFrame:
    d = store.raw("documents").select("doc_id", T.one_line(F.col("text")).alias("norm"))
    return d.select("doc_id", F.explode(windows_column(F.col("norm"), F.element_at(F.split("norm", " "), 1), 200, limit=1)).alias("context"))


@query("""WITH s AS (SELECT user_id, event_id % 5000 AS "start", event_id % 5000 + 200 AS "end" FROM events),
m AS (SELECT *, CASE WHEN "start" - max("end") OVER (PARTITION BY user_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 100 THEN 0 ELSE 1 END AS f FROM s),
g AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT user_id, min("start") AS "start", max("end") AS "end" FROM g GROUP BY user_id, k""")
def context_windows_sql(store: Store) -> DataFrame:
    at = F.col("event_id") % 5000
    return merge_intervals(store.raw("events").select("user_id", at.alias("start"), (at + 200).alias("end")), "user_id")


@query("""WITH r AS (SELECT doc_id, text, strpos(lower(text), 'the') - 1 AS pos_, length(text) AS n FROM documents), c AS (SELECT *, greatest(pos_ - 40, 0) AS b, least(pos_ + 40, n) AS e FROM r)
SELECT doc_id, CASE WHEN pos_ >= 0 THEN CASE WHEN b > 0 THEN '... ' ELSE '' END || regexp_replace(substr(text, b + 1, e - b), '^\\s+|\\s+$', '', 'g') || CASE WHEN e < n THEN ' ...' ELSE '' END ELSE substr(text, 1, 80) END AS example FROM c""")
def context_preview(store: Store) -> DataFrame:
    return store.raw("documents").select("doc_id", traits.snippet(F.col("text"), F.lit("the")).alias("example"))


@query("""SELECT event_id, CASE WHEN event_id % 4 < 3 THEN props ELSE '{"answer_text": "json decode error - rerun later", "evidence": [' || to_json(props || '}') || '], "reason": "json decode error - rerun later"}' END AS repaired,
CASE WHEN event_id % 4 = 2 THEN replace(props, '"', '”') ELSE props END AS first_object FROM events""")
def json_repair(store: Store) -> DataFrame:
    k = F.col("event_id") % 4
    broken = F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(k == 2, F.replace("props", F.lit('"'), F.lit("”"))).otherwise(F.concat("props", F.lit("}")))
    return store.raw("events").select("event_id", replies.repaired_json(broken).alias("repaired"), replies.first_json_object(F.concat(F.lit("see "), broken)).alias("first_object"))


@query("""SELECT event_id, event_id % 3 = 0 AS valid, CASE WHEN event_id % 3 = 0 THEN 'yes' ELSE 'unknown' END AS answer_text FROM events""")
def answer_schema_check(store: Store) -> DataFrame:
    k = F.col("event_id") % 3
    reply = F.when(k == 0, '{"answer_text": "yes", "reason": "supported", "evidence": ["a"]}').when(k == 1, F.col("props")).otherwise('{"answer_text": 1, "reason": "x", "evidence": []}')
    return store.raw("events").select("event_id", replies.is_valid_reply(reply).alias("valid"), replies.parsed_reply(reply)["answer_text"].alias("answer_text"))


@query(f"""WITH pairs AS (SELECT ql.id AS question_link_id, CASE WHEN ql.link_id % 2 = 0 THEN 'the' ELSE 'zzz' END AS phrase, {_NORM.replace("text", "d.text")} AS norm
 FROM v_question_links ql JOIN v_questions q ON q.id = ql.question_id JOIN documents d ON d.doc_id = ql.link_id),
{_windows_sql("(SELECT question_link_id, norm, phrase AS ph FROM pairs WHERE contains(norm, phrase))", "ph", 100, "question_link_id")}
SELECT question_link_id, CAST(NULL AS VARCHAR) AS answer_text, CAST(NULL AS VARCHAR) AS reason, context FROM windows
UNION ALL SELECT question_link_id, 'not relevant context', phrase || ' not found in the context', norm FROM pairs WHERE NOT contains(norm, phrase)""")
def answer_rows(store: Store) -> DataFrame:
    d = store.raw("documents").select(F.col("doc_id").alias("link_id"), "text")
    q = store.questions.select(F.col("id").alias("question_id"), F.col("text").alias("question"))
    pairs = store.question_links.withColumnRenamed("id", "question_link_id").join(q, "question_id").join(d, "link_id")
    return traits.answer_rows(pairs.withColumn("keyword_phrase", F.when(F.col("link_id") % 2 == 0, '"in the"').otherwise('"zzz"')), 100)


_VOTES = "SELECT user_id, CASE event_id % 5 WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'FAILED' WHEN 2 THEN event_type || ', Other!' ELSE upper(event_type) END AS answer FROM events"


def _votes(store: Store) -> DataFrame:
    k = F.col("event_id") % 5
    return store.raw("events").select("user_id", F.when(k == 0, "UNKNOWN").when(k == 1, "FAILED").when(k == 2, F.concat("event_type", F.lit(", Other!"))).otherwise(F.upper("event_type")).alias("answer"))


_CONSOLIDATED = f"""SELECT user_id, coalesce(string_agg(DISTINCT answer, ',' ORDER BY answer) FILTER (answer NOT IN ('UNKNOWN', 'FAILED')), 'UNKNOWN') AS consolidated FROM ({_VOTES}) v GROUP BY user_id"""


@query(_CONSOLIDATED)
def consolidate_answers(store: Store) -> DataFrame:
    return ranking.consolidate(_votes(store), ["user_id"])


@query(f"""WITH c AS ({_CONSOLIDATED}), p AS (SELECT user_id, unnest(string_split(consolidated, ',')) AS part, unnest(range(len(string_split(consolidated, ',')))) AS pos FROM c),
n AS (SELECT user_id, pos, translate(lower(trim(part)), '{_PUNCT}', '') AS part FROM p),
v AS (SELECT user_id, part, count(*) AS n FROM (SELECT user_id, translate(lower(trim(x)), '{_PUNCT}', '') AS part FROM (SELECT user_id, unnest(string_split(answer, ',')) AS x FROM ({_VOTES}) a) b) d GROUP BY user_id, part)
SELECT n.user_id, string_agg(n.part || ' (' || coalesce(v.n, 0) || ')', ', ' ORDER BY coalesce(v.n, 0) DESC, pos) AS ranked FROM n LEFT JOIN v ON v.user_id = n.user_id AND v.part = n.part GROUP BY n.user_id""")
def vote_rank(store: Store) -> DataFrame:
    votes = _votes(store)
    return ranking.vote_rank(ranking.consolidate(votes, ["user_id"]), votes, ["user_id"])


@query("""SELECT ql.question_id, l.url AS link, coalesce(substr(d.text, 1, 500), 'COULD NOT READ') AS scrubbed_webpage_content FROM v_question_links ql JOIN v_links l ON l.id = ql.link_id LEFT JOIN documents d ON d.doc_id = l.id AND d.doc_id % 3 > 0""")
def answer_scope(store: Store) -> DataFrame:
    links = store.links.select(F.col("id").alias("link_id"), F.col("url").alias("link"))
    found = store.question_links.join(links, "link_id").select(F.col("question_id").alias("question_formatted"), "link")
    asked = store.question_links.select(F.col("question_id").alias("question_formatted")).distinct()
    read = store.raw("documents").where("doc_id % 3 > 0").select(F.col("doc_id").alias("link_id"), F.col("text").alias("content")).join(links, "link_id")
    return traits.answer_scope(asked, found, read).select(F.col("question_formatted").alias("question_id"), "link", "scrubbed_webpage_content")


@query("SELECT doc_id, CAST(i AS BIGINT) AS part, substr(text, CAST(i * 1000 + 1 AS BIGINT), 1000) AS chunk FROM (SELECT doc_id, text, unnest(range(CAST(ceil(length(text) / 1000) AS BIGINT))) AS i FROM documents WHERE length(text) > 0) x")
def chunk_text(store: Store) -> DataFrame:
    rows = store.raw("documents").select("doc_id", F.posexplode(T.chunks(F.col("text"), 1000)).alias("part", "chunk"))
    return rows.withColumn("part", F.col("part").cast("long"))


@query("SELECT question_id, type, CAST(position AS BIGINT) AS position, url FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY position) AS r FROM (SELECT user_id AS question_id, event_type AS type, event_id AS position, props AS url FROM events WHERE event_type = 'click') x) y WHERE r <= 10")
def organic_results(store: Store) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "organic").otherwise(F.col("event_type"))
    found = files.organic(store.raw("events").select(F.col("user_id").alias("question_id"), kind.alias("type"), F.col("event_id").alias("position"), F.col("props").alias("url")))
    return found.withColumn("type", F.lit("click"))


@query("SELECT DISTINCT sha256(text) AS content_hash FROM documents")
def stream_content_dedup(store: Store) -> DataFrame:
    """The batch form of the stream: new contents by hash; the stream itself is in ``streaming.ingest``."""
    from .streaming.ingest import dedup_contents

    return dedup_contents(store.raw("documents").select("doc_id", "text")).select("content_hash")


@query("""SELECT user_id, unnest(list(event_type ORDER BY event_id)) AS answer, unnest(list(props ORDER BY event_id)) AS result FROM events GROUP BY user_id""")
def positional_join(store: Store) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("event_id", "event_type", "props")))
    lists = store.raw("events").groupBy("user_id").agg(ordered.alias("l"))
    arrays = lists.select("user_id", F.transform("l", lambda x: x["event_type"]).alias("a"), F.transform("l", lambda x: x["props"]).alias("r"))
    return traits.paired(arrays, ["user_id"], "a", "r")


@query("SELECT count(*) FILTER (doc_id % 10 > 0 AND trim(text) <> '') AS ok, count(*) FILTER (doc_id % 10 = 0 OR trim(text) = '') AS err FROM documents")
def ingest_metrics(store: Store) -> DataFrame:
    return traits.ingest_metrics(store.raw("documents").select(F.when(F.col("doc_id") % 10 == 0, "Error: timeout").otherwise(F.col("text")).alias("text")))


@query("""SELECT (SELECT count(*) FROM v_questions) AS inserted, (SELECT count(*) FROM v_questions WHERE id % 2 = 0) AS updated, (SELECT count(*) FROM v_questions WHERE id % 2 = 1) AS skipped""")
def insert_outcome(store: Store) -> DataFrame:
    q = store.questions
    changed = q.select("text", F.when(F.col("id") % 2 == 0, F.concat("keyword_phrase", F.lit("!"))).otherwise(F.col("keyword_phrase")).alias("keyword_phrase"))
    return traits.insert_outcome(q, changed.union(q.select(F.concat("text", F.lit("?")), "keyword_phrase")), "text", "keyword_phrase")


@query(r"""SELECT page_id, replace(replace(url, '/', chr(10)), chr(10), '<br>' || chr(10)) AS br, CASE WHEN contains(url, '2') THEN '"' || replace(url, '2', ',') || '"' ELSE replace(url, '2', ',') END AS quoted,
regexp_replace(regexp_replace(regexp_replace(replace(url, ' ', ''), '[,.();\\/]', '_', 'g'), '_+', '_', 'g'), '_nan', '', 'g') AS scrubbed, trim(regexp_replace(url || '.', '[\\/:*?"<>|]', '_', 'g'), '.') AS filename, md5(url) AS cache_key FROM pages""")
def name_functions(store: Store) -> DataFrame:
    u = F.col("url")
    return store.raw("pages").select(
        "page_id", T.nl2br(F.translate(u, "/", "\n")).alias("br"), T.quoted_if_needed(F.translate(u, "2", ",")).alias("quoted"), T.scrub_key(u).alias("scrubbed"),
        T.safe_filename(F.concat(u, F.lit("."))).alias("filename"), T.cache_key(u).alias("cache_key"))


# -- rasters at points -------------------------------------------------------------------

_WIN = "SELECT DISTINCT r.year AS ry, y.y FROM v_request r, (SELECT unnest(range(-10, 10)) AS d) k, LATERAL (SELECT r.year + k.d AS y) y WHERE k.d BETWEEN {a} AND {b}"
_JULIAN = """px AS (SELECT v.pixel_id, w.ry, w.y, {agg} AS value FROM v_raster v JOIN win w ON v.ts >= CAST(make_date(CAST(w.y AS BIGINT), 1, 1) AS TIMESTAMP) + INTERVAL ({lo}) DAY AND v.ts < CAST(make_date(CAST(w.y AS BIGINT), 1, 1) AS TIMESTAMP) + INTERVAL ({hi}) DAY
WHERE v.dataset_id = 'DS_R' GROUP BY v.pixel_id, w.ry, w.y)"""


def _pixels(store: Store, dataset: str = "DS_R") -> DataFrame:
    return store.raster.where(F.col("dataset_id") == dataset)


def _rounded(df: DataFrame, column: str = "value", digits: int = 6) -> DataFrame:
    return df.withColumn(column, F.round(column, digits))


for _stat, _agg in (("mean", "avg(v.value)"), ("max", "max(v.value)"), ("min", "min(v.value)"), ("sd", "stddev_pop(v.value)")):
    query(
        f"WITH win AS ({_WIN.format(a=-1, b=0)}), {_JULIAN.format(agg=_agg, lo=99, hi=200)}, yr AS (SELECT pixel_id, ry, avg(value) AS value FROM px GROUP BY pixel_id, ry) "
        "SELECT r.row_id, round(yr.value, 6) AS value FROM v_request r LEFT JOIN yr ON yr.pixel_id = r.pixel_id AND yr.ry = r.year",
        f"eo_julian_{_stat}",
    )(lambda store, stat=_stat: _rounded(raster.evaluate(store.request, _pixels(store), parse(f"spatial_mean(0;years_mean(-1,0;julian_{stat}(100,200)))"))))


@query(f"""WITH win AS ({_WIN.format(a=-2, b=0)}), px AS (SELECT v.pixel_id, w.ry, avg(v.value) AS value FROM v_raster v JOIN win w ON v.ts >= CAST(make_date(CAST(w.y AS BIGINT), 1, 1) AS TIMESTAMP) AND v.ts < CAST(make_date(CAST(w.y AS BIGINT), 1, 1) AS TIMESTAMP) + INTERVAL 365 DAY
WHERE v.dataset_id = 'DS_R' GROUP BY v.pixel_id, w.ry) SELECT r.row_id, round(px.value, 6) AS value FROM v_request r LEFT JOIN px ON px.pixel_id = r.pixel_id AND px.ry = r.year""")
def eo_years_mean(store: Store) -> DataFrame:
    return _rounded(raster.evaluate(store.request, _pixels(store), parse("years_mean(-2,0)")))


def _top_sql(order: str) -> str:
    return f"""WITH win AS ({_WIN.format(a=-1, b=0)}), j AS (SELECT v.pixel_id, w.ry, v.value, row_number() OVER (PARTITION BY v.pixel_id, w.ry ORDER BY v.value {order}) AS k FROM v_raster v JOIN win w
ON v.ts >= CAST(make_date(CAST(w.y AS BIGINT), 1, 1) AS TIMESTAMP) AND v.ts < CAST(make_date(CAST(w.y AS BIGINT), 1, 1) AS TIMESTAMP) + INTERVAL 365 DAY WHERE v.dataset_id = 'DS_R'),
px AS (SELECT pixel_id, ry, avg(value) AS value FROM j WHERE k <= 3 GROUP BY pixel_id, ry) SELECT r.row_id, round(px.value, 6) AS value FROM v_request r LEFT JOIN px ON px.pixel_id = r.pixel_id AND px.ry = r.year"""


@query(_top_sql("DESC"))
def eo_mean_n_max(store: Store) -> DataFrame:
    return _rounded(raster.evaluate(store.request, _pixels(store), parse("years_mean_n_max(3,-1,0)")))


@query(_top_sql("ASC"))
def eo_mean_n_min(store: Store) -> DataFrame:
    return _rounded(raster.evaluate(store.request, _pixels(store), parse("years_mean_n_min(3,-1,0)")))


_HAVERSINE = "2 * 6371008.8 * asin(least(sqrt(pow(sin((radians({b}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2)), 1.0))"
_RADIUS = 400_000


def _locations(store: Store) -> DataFrame:
    return store.point.select(F.col("id_key").alias("pixel_id"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))


_NEAR = f"SELECT a.id_key AS at, b.id_key AS pixel_id FROM (SELECT * FROM v_point WHERE id_key < 200) a, v_point b WHERE {_HAVERSINE.format(a='a.latitude', b='b.latitude', c='a.longitude', d='b.longitude')} <= {_RADIUS}"


@query(f"""WITH win AS ({_WIN.format(a=0, b=0)}), {_JULIAN.format(agg="max(v.value)", lo=0, hi=365)}, near AS ({_NEAR}),
sp AS (SELECT near.at, px.ry, avg(px.value) AS value FROM near JOIN px ON px.pixel_id = near.pixel_id GROUP BY near.at, px.ry)
SELECT r.row_id, round(sp.value, 5) AS value FROM v_request r LEFT JOIN sp ON sp.at = r.pixel_id AND sp.ry = r.year""")
def eo_spatial_radius(store: Store) -> DataFrame:
    return _rounded(raster.evaluate(store.request, _pixels(store), parse(f"spatial_mean({_RADIUS};years_max(0,0))"), locations=_locations(store)), digits=5)


@query(f"""WITH win AS ({_WIN.format(a=-1, b=0)}), {_JULIAN.format(agg="max(v.value)", lo=334, hi=395)}, yr AS (SELECT pixel_id, ry, avg(value) AS value FROM px GROUP BY pixel_id, ry), near AS ({_NEAR}),
sp AS (SELECT near.at, yr.ry, max(yr.value) AS value FROM near JOIN yr ON yr.pixel_id = near.pixel_id GROUP BY near.at, yr.ry)
SELECT r.row_id, round(sp.value, 6) AS value FROM v_request r LEFT JOIN sp ON sp.at = r.pixel_id AND sp.ry = r.year""".replace("INTERVAL (395) DAY", "INTERVAL (30) DAY + INTERVAL 1 YEAR"))
def eo_full_expr(store: Store) -> DataFrame:
    return _rounded(raster.evaluate(store.request, _pixels(store), parse(f"spatial_max({_RADIUS};years_mean(-1,0;julian_max(335,395)))"), locations=_locations(store)))


@query(f"""WITH win AS ({_WIN.format(a=-1, b=0)}), w2 AS (SELECT v.dataset_id, v.pixel_id, w.ry, v.value, v.label FROM v_raster v JOIN win w ON v.ts >= CAST(make_date(CAST(w.y AS BIGINT), 1, 1) AS TIMESTAMP) AND v.ts < CAST(make_date(CAST(w.y AS BIGINT), 1, 1) AS TIMESTAMP) + INTERVAL 365 DAY),
m AS (SELECT pixel_id, ry, CASE WHEN 2 * sum(CASE WHEN label IN (1, 2, 3) THEN 1 ELSE 0 END) > count(*) THEN 1.0 ELSE 0.0 END AS mask FROM w2 WHERE dataset_id = 'DS_N' GROUP BY pixel_id, ry),
v AS (SELECT w2.pixel_id, w2.ry, avg(w2.value * m.mask) AS value FROM w2 JOIN m ON m.pixel_id = w2.pixel_id AND m.ry = w2.ry WHERE w2.dataset_id = 'DS_R' GROUP BY w2.pixel_id, w2.ry)
SELECT r.row_id, round(v.value, 6) AS value FROM v_request r LEFT JOIN v ON v.pixel_id = r.pixel_id AND v.ry = r.year""")
def eo_mask(store: Store) -> DataFrame:
    mask = raster.mode_mask(_pixels(store, "DS_N"), store.request, (-1, 0), (1, 2, 3))
    return _rounded(raster.evaluate(store.request, _pixels(store), parse("years_mean(-1,0)"), mask=mask))


@query("""SELECT pixel_id, ts, round(value * 0.5, 6) AS half, round(value - 273.15, 6) AS shifted, CAST(CASE WHEN label IN (1, 2) THEN 1 ELSE 0 END AS DOUBLE) AS indicator FROM v_raster WHERE dataset_id = 'DS_R'""")
def eo_pixel_transform(store: Store) -> DataFrame:
    v = F.col("value")
    return _pixels(store).select(
        "pixel_id", "ts", F.round(raster.transformed(v, Transform("mult", (0.5,))), 6).alias("half"), F.round(raster.transformed(v, Transform("add", (-273.15,))), 6).alias("shifted"),
        raster.transformed(F.col("label"), Transform("mask", (1, 2))).alias("indicator"))


@query("SELECT pixel_id, " + ", ".join(f"round(avg(CASE WHEN label = {k} THEN 1.0 ELSE 0.0 END), 6) AS lulc_prop_area_{k}" for k in range(9)) + " FROM v_raster GROUP BY pixel_id")
def eo_landcover_table(store: Store) -> DataFrame:
    shares = raster.landcover_shares(store.raster, ["pixel_id"], 9)
    return shares.select("pixel_id", *(F.round(c, 6).alias(c) for c in shares.columns[1:]))


@query("SELECT row_id, CASE WHEN year - 1 < 1996 OR year + 1 > 1999 THEN 'Outside 1996-1999: (' || (year - 1) || ', ' || (year + 1) || ')' ELSE 'ok' END AS value FROM v_request")
def eo_outside_guard(store: Store) -> DataFrame:
    return store.request.select("row_id", raster.outside_guard(F.col("year"), F.lit("ok"), (-1, 0), 1996, 1999).alias("value"))


@query("SELECT row_id, year, (row_number() OVER (PARTITION BY year ORDER BY row_id) - 1) // 50 AS batch FROM v_request")
def eo_batch_number(store: Store) -> DataFrame:
    return raster.batch_numbers(store.request.select("row_id", "year"))


_YEARLY = "SELECT pixel_id, year(ts) AS y, {} AS value FROM v_raster WHERE dataset_id = 'DS_R' GROUP BY pixel_id, year(ts)"


@query(f"SELECT pixel_id, round(avg(value), 6) AS value FROM ({_YEARLY.format('max(value)')}) x GROUP BY pixel_id")
def yearly_max_mean(store: Store) -> DataFrame:
    return _rounded(raster.yearly_then_mean(_pixels(store)))


@query("""SELECT pixel_id, year, mode FROM (SELECT pixel_id, CAST(year(ts) AS INT) AS year, label AS mode, row_number() OVER (PARTITION BY pixel_id, year(ts) ORDER BY count(*) DESC, label) AS k FROM v_raster GROUP BY pixel_id, year(ts), label) x WHERE k = 1""")
def yearly_mode(store: Store) -> DataFrame:
    return raster.yearly_mode(store.raster)


@query("SELECT dataset_id, round(CASE WHEN quantile_cont(value, 0.1) = quantile_cont(value, 0.9) THEN 0.0 ELSE quantile_cont(value, 0.1) END, 5) AS low, round(quantile_cont(value, 0.9), 5) AS high FROM v_raster GROUP BY dataset_id")
def percentile_stretch(store: Store) -> DataFrame:
    return _rounded(_rounded(raster.percentile_stretch(store.raster, ["dataset_id"]), "low", 5), "high", 5)


@query("SELECT pixel_id, CAST(year AS INT) AS year, value FROM (SELECT pixel_id, year(ts) AS year, value, row_number() OVER (PARTITION BY pixel_id, year(ts) ORDER BY ts, value) AS k FROM v_raster WHERE dataset_id = 'DS_R') x WHERE k = 1")
def first_image(store: Store) -> DataFrame:
    return raster.first_image(_pixels(store))


@query(f"""WITH m AS (SELECT pixel_id, avg(value) AS value FROM v_raster WHERE dataset_id = 'DS_R' GROUP BY pixel_id), p AS (SELECT id_key AS pixel_id, latitude AS lat, longitude AS lon FROM v_point)
SELECT a.pixel_id, round(avg(m.value), 5) AS value FROM p a, p b JOIN m ON m.pixel_id = b.pixel_id WHERE {_HAVERSINE.format(a='a.lat', b='b.lat', c='a.lon', d='b.lon')} <= {_RADIUS} GROUP BY a.pixel_id""")
def focal_mean(store: Store) -> DataFrame:
    means = raster.reduce_by(_pixels(store), ["pixel_id"], "mean")
    return _rounded(raster.focal_mean(means, _locations(store), _RADIUS), digits=5)


@query("SELECT pixel_id, ts, label, CASE label WHEN 1 THEN 'water' WHEN 2 THEN 'trees' WHEN 3 THEN 'grass' ELSE 'Unknown' END AS label_name, least(greatest(CAST(year(ts) AS INT), 1997), 1999) AS shown_year FROM v_raster")
def label_lookup(store: Store) -> DataFrame:
    name = raster.label_lookup(F.col("label"), {1: "water", 2: "trees", 3: "grass"})
    return store.raster.select("pixel_id", "ts", "label", name.alias("label_name"), raster.clamp_year(F.year("ts"), 1997, 1999).alias("shown_year"))


@query("SELECT DISTINCT label, CASE WHEN label BETWEEN 1 AND 3 OR label = 5 THEN 'natural' WHEN label = 4 THEN 'cultivated' END AS class FROM v_raster")
def mask_class(store: Store) -> DataFrame:
    return store.raster.select("label", datasets.mask_class(F.col("label"), "gdw").alias("class")).distinct()


@query("""SELECT * FROM (VALUES
('clum_landcover', 'CLUM-50m-{year}', 'b1', [2020], 'dataset_year_pattern', '[[300, 353], 361, 364, [400, 454], 461, 464, [510, 515]]', '[[100, 210], 360, 362, 363, 365, 460, 462, 463, 465]', NULL, false),
('corine', 'COPERNICUS/CORINE/V20/100m/{year}', 'landcover', [1990, 2000, 2006, 2012, 2018], 'dataset_year_pattern', '[[211, 244]]', '[[311, 423]]', NULL, false),
('dea_landcover', 'dea_landcover_{year}_compressed', 'b1', range(1998, 2021), 'dataset_year_pattern', '[1, [3, 8], [14, 18]]', '[[19, 36], [55, 92], [94, 97]]', NULL, false),
('era5_max_air_temp', 'ECMWF/ERA5/DAILY', 'maximum_2m_air_temperature', range(1979, 2020), 'date', '[]', '[]', 'max', false),
('era5_mean_air_temp', 'ECMWF/ERA5/DAILY', 'mean_2m_air_temperature', range(1979, 2020), 'date', '[]', '[]', 'mean', false),
('era5_min_air_temp', 'ECMWF/ERA5/DAILY', 'minimum_2m_air_temperature', range(1979, 2020), 'date', '[]', '[]', 'min', false),
('era5_precip', 'ECMWF/ERA5/DAILY', 'total_precipitation', range(1979, 2020), 'date', '[]', '[]', 'sum', false),
('gdw', 'GOOGLE/DYNAMICWORLD/V1', 'label', range(2015, 2023), 'date', '[4]', '[[1, 3], 5]', NULL, true),
('gfsad', 'USGS/GFSAD1000_V1', 'landcover', [2010], 'None', '[[1, 5]]', '[0]', NULL, false),
('modis', 'MODIS/061/MCD12Q1', 'LC_Type2', range(2001, 2021), 'date', '[12, 14]', '[[1, 11]]', NULL, false),
('nass', 'USDA/NASS/CDL', 'cropland', range(1997, 2021), 'date', '[[1, 77], [204, 254]]', '[87, [141, 195]]', NULL, false),
('nlcd', 'USGS/NLCD_RELEASES/2016_REL', 'landcover', [1992, 2001, 2004, 2006, 2008, 2011, 2013, 2016], 'date', '[81, 82]', '[[41, 74], [90, 95]]', NULL, false),
('precip_daymet', 'NASA/ORNL/DAYMET_V4', 'prcp', range(1980, 2021), 'dataset_string', '[]', '[]', 'sum', true)
) AS t(section, dataset, band, valid_years, filter_by, cultivated, "natural", seasonal, disabled)""")
def dataset_catalog(store: Store) -> DataFrame:
    return datasets.catalog(store.spark)


@query("SELECT p_partkey, list_sort([1990, 2000, 2006, 2012, 2018], 'ASC')[1 + (SELECT count(*) FROM (SELECT unnest([1995, 2003, 2009, 2015]) AS m) x WHERE m < 1985 + p_size)] AS closest FROM part")
def find_closest(store: Store) -> DataFrame:
    years = F.array(*(F.lit(y) for y in (1990, 2000, 2006, 2012, 2018)))
    return store.raw("part").select("p_partkey", raster.find_closest(years, F.lit(1985) + F.col("p_size")).alias("closest"))


@query("""SELECT page_id, '20' || lpad(CAST(page_id % 20 AS VARCHAR), 2, '0') || '-01-01' AS start_date, '2020-01-01' AS end_date, CASE page_id % 5 WHEN 0 THEN 'Image' ELSE 'ImageCollection' END AS dataset_type, url AS dataset_id,
CASE page_id % 3 WHEN 0 THEN 'years' WHEN 1 THEN 'julian' END AS temporal_resolution, CASE page_id % 4 WHEN 0 THEN CAST(page_id AS INT) WHEN 1 THEN 1000 + CAST(page_id % 9 AS INT) END AS nominal_scale FROM pages""")
def catalog_page(store: Store) -> DataFrame:
    """The raw pages with a catalog's parts inside, of which some lack a cadence or give the scale in another way."""
    k = F.col("page_id")
    parts = [
        F.col("html"), F.lit("Dataset Availability\n 20"), F.lpad((k % 20).cast("string"), 2, "0"), F.lit("-01-01T00:00:00Z - 2020-01-01T00:00:00Z <p>Earth Engine Snippet</p> ee."), F.when(k % 5 == 0, "Image").otherwise("ImageCollection"), F.lit('("'), F.col("url"),
        F.lit('") '), F.when(k % 3 == 0, "Cadence 1 Year").when(k % 3 == 1, "Cadence 16 Day").otherwise(""),
        F.when(k % 4 == 0, F.concat(F.lit(" Pixel Size "), k.cast("string"), F.lit(" meters"))).when(k % 4 == 1, F.concat(F.lit("<p> <b>Resolution</b> <br> 1,00"), (k % 9).cast("string"), F.lit(" meters"))).otherwise(""),
        F.col("html"),
    ]
    return store.raw("pages").select("page_id", *datasets.parse_catalog_page(F.concat(*parts)))


@query("SELECT p_partkey, CAST(y AS VARCHAR) AS span FROM (SELECT p_partkey, unnest(range(1990, 1990 + p_size % 4 + 1)) AS y FROM part) x")
def expand_year_range(store: Store) -> DataFrame:
    span = F.concat(F.lit("1990-"), (F.lit(1990) + F.col("p_size") % 4).cast("string"))
    return files.expand_years(store.raw("part").select("p_partkey", span.alias("span")), "span")


@query("SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice + 1 END AS value FROM orders")
def joined_points(store: Store) -> DataFrame:
    o = store.raw("orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("v"))
    even = o.where("row_id % 2 = 0")
    values = even.select("row_id", F.col("v").alias("value"), F.lit(1).alias("seq")).union(even.select("row_id", F.col("v") + 1, F.lit(2)))
    return files.joined_results(o.select("row_id"), values, "value")
