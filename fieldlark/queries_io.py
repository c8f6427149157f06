"""The catalogue, second part: sources and sinks as round trips, the extraction path, and what has no place in the first.

A sink's query writes to the scratch folder and reads back what it wrote.
"""

from __future__ import annotations

import html
import io
import os
import tempfile
import zipfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from . import providers
from .functions import binary, urls
from .functions import text as T
from .operators import catalog, filters, mutate, ranking, results, traits
from .plans import extract as X
from .plans import raster
from .plans.expr import compose, parse
from .plans.spec import spec_from_form
from .queries import _IDS, _JULIAN, _KNOWN, _NORM, _STATUS, _WIN, _YEARLY, ORACLES, _pixels, _rounded, query
from .service import ObservationService
from .sources import datasets, files
from .sources.tables import Store
from .streaming import ingest

# -- sources and sinks -------------------------------------------------------------------


@query('SELECT latitude AS "Latitude", longitude AS "Longitude", year AS "Year", row_id AS "Site" FROM v_request')
def point_table(store: Store) -> DataFrame:
    path = files.scratch(store.spark, "points")
    r = store.request
    files.write_csv(r.select(F.col("latitude").alias("Latitude"), F.col("longitude").alias(" Longitude "), F.col("year").alias("Year"), F.col("row_id").alias("Site")), path)
    return files.read_points(store.spark, path).drop("row_id")


@query("SELECT * FROM (VALUES ('A/B', 'b1', 'spatial_mean(0;years_mean(-1,0))', 'n/a'), ('A/C', 'b2', 'years_max(0,0)', 'mult[0.1]')) AS t(dataset, band, expression, transform)")
def dataset_table(store: Store) -> DataFrame:
    rows = [("A/B", "b1", "spatial_mean(0;years_mean(-1,0))", "n/a", "x"), ("A/C", "b2", "years_max(0,0)", "mult[0.1]", "y"), ("A/D", "b3", "years_max(0,0)", "n/a", "z")]
    names = ["Dataset ID", "Band Name", "Spatiotemporal Aggregation Function", "Pixel Value Transform", "Note"]
    path = files.scratch(store.spark, "datasets")
    files.write_csv(store.spark.createDataFrame(rows, names), path, one_file=True)
    return files.read_dataset_table(store.spark, path, 2).select(*(F.col(n).alias(a) for n, a in zip(names, ("dataset", "band", "expression", "transform"))))


@query("SELECT c_name AS value FROM customer WHERE c_custkey % 4 NOT IN (1, 2)")
def line_list(store: Store) -> DataFrame:
    """Lines of which a quarter are comments and a quarter blank."""
    k = F.col("c_custkey") % 4
    path = files.scratch(store.spark, "lines")
    files.write_lines(store.raw("customer").select(F.when(k == 1, F.concat(F.lit("# "), "c_name")).when(k == 2, "  ").otherwise(F.concat(F.lit(" "), "c_name", F.lit("  "))).alias("value")), path)
    return files.read_list(store.spark, path)


@query("SELECT 0 AS place, chr(65279) || 'n_nationkey,n_name' AS line UNION ALL SELECT n_nationkey + 1, n_nationkey || ',\"' || n_name || ', \"\"x\"\"\"' FROM nation")
def csv_stream(store: Store) -> DataFrame:
    """A CSV with a mark of its encoding, for a person's download, line by line."""
    out = io.StringIO()
    files.stream_csv(store.raw("nation").select("n_nationkey", F.concat("n_name", F.lit(', "x"')).alias("n_name")).orderBy("n_nationkey").coalesce(1), out, bom=True)
    return store.spark.createDataFrame(list(enumerate(out.getvalue().splitlines())), "place int, line string")


@query(f"SELECT species, question, answer, question_id FROM ({ORACLES['qna_report']}) x")
def report_file(store: Store) -> DataFrame:
    path = files.scratch(store.spark, "report")
    files.write_csv(traits.report(store).orderBy("species", "question_id", "answer_id"), path, quote_all=True)
    back = store.spark.read.csv(path, header=True, escape='"', multiLine=True)
    return back.select("species", "question", "answer", F.col("question_id").cast("long").alias("question_id"))


@query(f"SELECT * FROM ({ORACLES['missing_answers']}) x")
def missing_answers_file(store: Store) -> DataFrame:
    path = files.scratch(store.spark, "missing")
    files.write_csv(traits.missing_answers(store), path)
    return store.spark.read.csv(path, header=True, escape='"', schema="question_id long, question string, link_id long, url string", enforceSchema=False)


@query("""SELECT '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","note":null}' AS value FROM customer""")
def json_page(store: Store) -> DataFrame:
    return files.json_rows(store.raw("customer").select("c_custkey", "c_name", F.lit(None).cast("string").alias("note")))


@query("SELECT 'Latitude,Longitude,Year' || chr(10) AS template")
def template_file(store: Store) -> DataFrame:
    return store.spark.createDataFrame([(files.template_csv(),)], "template string")


@query("""SELECT 'nations.csv' AS file, count(*) + 1 AS lines FROM nation UNION ALL SELECT 'none.csv', 1 UNION ALL SELECT 'removed: old.zip', 0""")
def zip_download(store: Store) -> DataFrame:
    """A download, and the removal of an expired one beside it."""
    with tempfile.TemporaryDirectory() as folder:
        for name in ("old.zip", "new.zip"):
            files.write_zip({"nations.csv": store.raw("nation"), "none.csv": store.raw("nation").limit(0)}, os.path.join(folder, name))
        os.utime(os.path.join(folder, "old.zip"), (0, 0))
        gone = files.remove_expired(folder)
        with zipfile.ZipFile(os.path.join(folder, "new.zip")) as z:
            rows = [(n, len(z.read(n).decode().splitlines())) for n in z.namelist()]
    return store.spark.createDataFrame([*rows, *((f"removed: {n}", 0) for n in gone)], "file string, lines long")


@query("SELECT 1 AS version, name FROM v_species UNION ALL SELECT 2, name FROM v_species WHERE name NOT IN ('NATION_1', 'NATION_22')")
def table_versions(store: Store) -> DataFrame:
    """A purge as a new version; the version before stays as its backup."""
    spark, folder = store.spark, files.scratch(store.spark, "species")
    files.write_version(store.species, folder)
    left, _ = mutate.purge(store, spark.createDataFrame([("NATION_1",), ("NATION_22",)], "name string"))
    files.write_version(left["species"], folder)
    return files.read_version(spark, folder, 1).select(F.lit(1).alias("version"), "name").union(files.read_version(spark, folder).select(F.lit(2), "name"))


@query(f"SELECT * FROM ({ORACLES['searchable_values']}) x")
def cached_fields(store: Store) -> DataFrame:
    path = files.scratch(store.spark, "fields")
    service = ObservationService(store)
    service.save_fields(path)
    return service.save_fields(path).select("name", F.array_join("values", ",").alias("joined"))


def _fake_search(query: str, start: int) -> list[dict]:
    return [{"url": f"https://{i}.org/{query[1:5]}", "title": query} for i in range(start, min(start + 10, 24))]


@query("""SELECT id AS question_id, 'https://' || i || '.org/' || substr(keyword_phrase, 2, 4) AS url, keyword_phrase AS title FROM v_questions, (SELECT unnest(range(1, 24)) AS i) x""")
def paged_search(store: Store) -> DataFrame:
    """Three pages of a search that has 23 results, of 30 asked for."""
    search = providers.PagedSearch(_fake_search)
    q = store.questions.select(F.col("id").alias("question_id"), "keyword_phrase")
    return providers.search_links(q, lambda k: search(k, 30))


@query("SELECT DISTINCT sha256(text) AS content_hash FROM documents")
def stream_ingest(store: Store) -> DataFrame:
    """The documents as a file stream, once each, as the table has them after the stream has read all."""
    folder, schema = files.scratch(store.spark, "stream"), store.raw("documents").schema
    pages = ingest.read_pages(store.spark, os.path.join(store.directory, "documents.parquet"), schema)
    ingest.run_ingest(pages, f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
    return store.spark.read.parquet(f"{folder}/table").select("content_hash")


@query("""SELECT * FROM (VALUES ('a_cover', 'A/{year}', 'b1', [2001, 2002, 2003], 'dataset_year_pattern', '[1, [3, 8]]', '[]', NULL, false), ('b_rain', 'B', 'prcp', [1999], 'date', '[]', '[]', 'sum', true))
AS t(section, dataset, band, valid_years, filter_by, cultivated, "natural", seasonal, disabled)""")
def dataset_definitions(store: Store) -> DataFrame:
    cover = "[a_cover]\ngee_dataset = A/{year}\nband_name = b1\nvalid_years = list(range(2001, 2004))\nfilter_by = dataset_year_pattern\n[mask_types]\ncultivated = [1, (3, 8)]\nnatural = []\n"
    rain = "[b_rain]\ngee_dataset = B\nband_name = prcp\nvalid_years = [1999]\nfilter_by = date\ndisabled = True\n[seasonal]\naggregate_function = 'sum'\n"
    return datasets.read_definitions(store.spark, [cover, rain])


@query("SELECT p_partkey, p_brand AS dataset_id, coalesce(s.scale, 30) AS scale FROM part LEFT JOIN (SELECT * FROM (VALUES ('Brand#11', 10), ('Brand#12', 500)) AS t(brand, scale)) s ON s.brand = p_brand")
def dataset_scale(store: Store) -> DataFrame:
    known = store.spark.createDataFrame([("Brand#11", 10), ("Brand#11", 20), ("Brand#12", 500)], "dataset_id string, nominal_scale int")
    return datasets.with_scale(store.raw("part").select("p_partkey", F.col("p_brand").alias("dataset_id")), known)


@query("SELECT 'Longitude' AS missing UNION ALL SELECT 'Year'")
def required_columns(store: Store) -> DataFrame:
    lacking = files.missing_columns(["﻿Latitude", "year", "Site "], ("Latitude", "Longitude", "Year"))
    return store.spark.createDataFrame([(c,) for c in lacking], "missing string")


# -- forms and columns -------------------------------------------------------------------


@query(f"{_IDS} WHERE {_STATUS} AND s.year BETWEEN 1995 AND 1998 AND p.latitude BETWEEN -80 AND 80 AND p.longitude BETWEEN -170 AND 170")
def form_filter(store: Store) -> DataFrame:
    form = {"covariate": ["Status"], "values": ["F"], "valueCounts": ["1"], "yearRange": "1995-1998", "upperLeft": "80 -170", "lowerRight": "-80 170", "minSitesPerStudy": ""}
    return filters.apply_spec(store, spec_from_form(form)).select("id_key", "study_id", "year")


@query("""WITH c AS (SELECT * FROM (VALUES ('row_number', -4.0), ('study_id', -3.0), ('observation', -2.0), ('latitude', -1.0), ('longitude', 0.0)) AS t(name, display_order)
UNION ALL SELECT name, display_order FROM v_covariate_defn WHERE NOT hidden AND (covariate_association = 1 OR show_in_point_table)
AND (always_display OR id_key IN (SELECT covariate_defn_id FROM v_covariate_value WHERE sample_id IS NOT NULL AND value IS NOT NULL AND lower(value) <> 'null')))
SELECT row_number() OVER (ORDER BY display_order) AS place, name FROM c""")
def column_order(store: Store) -> DataFrame:
    shown = {r["name"]: r["display_order"] for r in catalog.display_columns(store, results.SAMPLE_LEVEL).collect()}  # the catalog is small
    names = results.column_order(sorted(shown), shown, results.SAMPLE_COLUMNS)
    return store.spark.createDataFrame(list(enumerate(names, 1)), "place long, name string")


@query("""SELECT DISTINCT d.name, CASE WHEN TRY_CAST(v.value AS DOUBLE) IS NOT NULL THEN 'true' ELSE lower(v.value) END AS value FROM v_covariate_value v JOIN v_covariate_defn d ON d.id_key = v.covariate_defn_id
WHERE v.value IS NOT NULL AND lower(v.value) <> 'null' AND v.sample_id IN (SELECT id_key FROM v_sample ORDER BY id_key LIMIT 5)""")
def unique_value_sample(store: Store) -> DataFrame:
    return catalog.unique_value_summary(store, samples=5)


@query("SELECT id_key, value, TRY_CAST(value AS DOUBLE) IS NOT NULL AS is_number FROM v_covariate_value")
def numeric_strings(store: Store) -> DataFrame:
    return store.covariate_value.select("id_key", "value", T.is_number(F.col("value")).alias("is_number"))


@query("SELECT id_key, CAST(value AS DOUBLE) AS month, value AS mixed FROM v_covariate_value WHERE covariate_defn_id = 5")
def numeric_column(store: Store) -> DataFrame:
    """A column of numbers becomes one of doubles; one with other texts, here in rows that are dropped later, stays."""
    rows = store.covariate_value.select("id_key", "covariate_defn_id", "value")
    month = files.numeric_if_all(rows.where("covariate_defn_id = 5").select("id_key", F.col("value").alias("month")), "month")
    mixed = files.numeric_if_all(rows.withColumnRenamed("value", "mixed"), "mixed")
    return month.join(mixed.where("covariate_defn_id = 5").select("id_key", "mixed"), "id_key")


# -- texts -------------------------------------------------------------------------------


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(text || chr(7) || chr(8232), '[^\P{C}\n\r\t]', '', 'g'), '[^\P{Z} ]', '', 'g') AS printable, text AS valid FROM documents""")
def clean_texts(store: Store) -> DataFrame:
    t = F.concat("text", F.lit("\x07 "))
    return store.raw("documents").select("doc_id", T.printable(t).alias("printable"), T.valid_utf8(F.col("text").cast("binary")).alias("valid"))


@query(r"""WITH w AS (SELECT doc_id, text, regexp_extract_all(text, '\s*\S+') AS w FROM documents) SELECT doc_id, CASE WHEN len(w) > 250 THEN array_to_string(w[1:250], '') ELSE text END AS head, len(w) AS n_tokens, 2 * len(w) AS n_messages FROM w""")
def token_heads(store: Store) -> DataFrame:
    t = F.col("text")
    both = F.array(F.struct(F.lit("user").alias("role"), t.alias("content")), F.struct(F.lit("system").alias("role"), t.alias("content")))
    return store.raw("documents").select("doc_id", T.first_tokens(t, 250).alias("head"), T.count_tokens(t).alias("n_tokens"), T.count_message_tokens(both).alias("n_messages"))


@query("SELECT conv_id, string_agg(trim(translate(text, chr(10) || chr(13), '  ')), ' ... ' ORDER BY turn, text) AS evidence FROM conversations GROUP BY conv_id")
def evidence_lines(store: Store) -> DataFrame:
    items = store.raw("conversations").where("text is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("items"))
    return items.select("conv_id", T.joined_evidence(F.transform("items", lambda i: i["text"])).alias("evidence"))


_TROUBLE = "CASE doc_id % 6 WHEN 0 THEN '  Error: ' || text WHEN 1 THEN text || ' Traceback (most' WHEN 2 THEN 'HTTP 503 ' || text WHEN 3 THEN chr(10) || ' ' WHEN 4 THEN NULL ELSE text END"


@query(rf"""WITH t AS (SELECT doc_id, regexp_replace({_TROUBLE}, '^\s+|\s+$', '', 'g') AS t FROM documents)
SELECT doc_id, coalesce(t = '' OR starts_with(t, 'Error:') OR contains(t, 'Traceback') OR contains(t, 'HTTP 4') OR contains(t, 'HTTP 5'), true) AS error_like FROM t""")
def error_like(store: Store) -> DataFrame:
    k, t = F.col("doc_id") % 6, F.col("text")
    trouble = F.when(k == 0, F.concat(F.lit("  Error: "), t)).when(k == 1, F.concat(t, F.lit(" Traceback (most"))).when(k == 2, F.concat(F.lit("HTTP 503 "), t)).when(k == 3, "\n ").when(k == 4, None).otherwise(t)
    return store.raw("documents").select("doc_id", T.is_error_like(trouble).alias("error_like"))


_ARTICLE = "regexp_extract(html, '(?is)<article\\b[^>]*>(.*?)</article>', 1)"


def _plain(markup: str) -> str:
    for tag in ("script", "style", "noscript"):
        markup = rf"regexp_replace({markup}, '(?is)<{tag}[^>]*>.*?</{tag}>', ' ', 'g')"
    markup = rf"regexp_replace(regexp_replace({markup}, '(?i)</?(?:p|div|br|li|h[1-6]|tr|th|td)\b[^>]*>', chr(10), 'g'), '(?s)<[^>]+>', ' ', 'g')"
    return rf"regexp_replace(regexp_replace(regexp_replace({markup}, '[ \t\f\v]+', ' ', 'g'), '\n\s*\n+', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


def _bare(markup: str) -> str:
    for tag in ("script", "style", "noscript"):
        markup = rf"regexp_replace({markup}, '(?is)<{tag}[^>]*>.*?</{tag}>', ' ', 'g')"
    return markup


_DENSE = r"""list_filter(regexp_extract_all({}, '(?is)<p\b[^>]*>(.*?)</p>', 1), lambda p: length(regexp_replace(p, '(?s)<[^>]+>', '', 'g')) >= 40
 AND 2 * length(regexp_replace(regexp_replace(p, '(?is)<a\b[^>]*>.*?</a>', '', 'g'), '(?s)<[^>]+>', '', 'g')) > length(regexp_replace(p, '(?s)<[^>]+>', '', 'g')))""".format(_bare("html"))
_PARAGRAPHS = f"coalesce(array_to_string(list_transform({_DENSE}, lambda p: '<p>' || p || '</p>'), chr(10)), '')"
_CASCADE = "SELECT page_id, CASE page_id % 3 WHEN 0 THEN html WHEN 1 THEN replace(html, 'article', 'section') ELSE replace(replace(html, 'article', 'section'), '<p', '<q') END AS html FROM pages"


@query(f"SELECT page_id, coalesce(nullif({_plain(_ARTICLE)}, ''), nullif({_plain(_PARAGRAPHS)}, ''), {_plain('html')}) AS text FROM ({_CASCADE}) x")
def main_text(store: Store) -> DataFrame:
    """Pages with an article, with paragraphs only, and with neither."""
    k, whole = F.col("page_id") % 3, F.col("html")
    section = F.replace(whole, F.lit("article"), F.lit("section"))
    page = F.when(k == 0, whole).when(k == 1, section).otherwise(F.replace(section, F.lit("<p"), F.lit("<q")))
    return store.raw("pages").select("page_id", T.extract_text(page, entities=False).alias("text"))


@query("""SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'https://oa.org/' || page_id || '.pdf' WHEN 1 THEN 'https://oa.org/page' WHEN 2 THEN 'https://alex.org/b' WHEN 3 THEN 'https://alex.org/primary.pdf' WHEN 4 THEN 'https://web.archive.org/doi' ELSE 'https://web.archive.org/page' END AS open_url FROM pages""")
def open_versions(store: Store) -> DataFrame:
    """Replies in which each service in turn is the first that knows an open version; the last URL has no title."""
    k, ident = F.col("page_id") % 6, F.col("page_id").cast("string")
    doi = F.when(k <= 2, '{"message": {"items": [{"title": "x"}, {"DOI": "10.1/a"}]}}').when(k == 4, '{"message": {"items": [{"DOI": "10.1/b"}]}}').otherwise('{"message": {"items": []}}')
    paid = F.when(k == 0, F.concat(F.lit('{"best_oa_location": {"url_for_pdf": "https://oa.org/'), ident, F.lit('.pdf", "url": "https://oa.org/x"}}'))).when(k == 1, '{"best_oa_location": {"url_for_pdf": null, "url": "https://oa.org/page"}}').otherwise('{"best_oa_location": null}')
    alex = F.when(k == 2, '{"results": [{"best_oa_location": null}, {"best_oa_location": {"url": "https://alex.org/b"}}]}').when(
        k == 3, '{"results": [{"primary_location": {"source": {"is_oa": false}, "pdf_url": "no"}}, {"primary_location": {"source": {"is_oa": true}, "pdf_url": "https://alex.org/primary.pdf"}}]}').otherwise("{}")
    of_doi = F.lit('{"archived_snapshots": {"closest": {"available": true, "url": "https://web.archive.org/doi"}}}')
    of_page = F.lit('{"archived_snapshots": {"closest": {"available": true, "url": "https://web.archive.org/page"}}}')
    url = F.when(k == 5, "https://x.org/other/1").otherwise(F.concat(F.lit("https://x.org/publication/1_Some_title_"), ident))
    return store.raw("pages").select("page_id", urls.open_version(url, doi, paid, alex, of_doi, of_page).alias("open_url"))


# -- work lists --------------------------------------------------------------------------


@query("SELECT min(c_custkey) AS place, c_mktsegment AS value FROM customer GROUP BY c_mktsegment")
def first_seen(store: Store) -> DataFrame:
    return traits.first_seen(store.raw("customer").select(F.col("c_custkey").alias("place"), F.col("c_mktsegment").alias("value")), "place", "value")


@query("SELECT id, url FROM v_links")
def random_order(store: Store) -> DataFrame:
    return traits.in_random_order(store.links.select("id", "url"), seed=7)


@query("SELECT id, text FROM v_content WHERE is_valid IS NULL")
def pending_classification(store: Store) -> DataFrame:
    return traits.pending_classification(store)


@query("""SELECT question_link_id, answer_text, context FROM v_answers UNION ALL SELECT id, 'new', coalesce(CASE WHEN id % 2 = 0 THEN url END, '') FROM v_links""")
def appended_answers(store: Store) -> DataFrame:
    """New answers after the old ones; their ids are larger and differ, which a window over the old ids shows."""
    old = store.answers.select("id", "question_link_id", "answer_text", "context")
    new = store.links.select(F.col("id").alias("question_link_id"), F.lit("new").alias("answer_text"), F.when(F.col("id") % 2 == 0, F.col("url")).alias("context"))
    return mutate.append_answers(old, new).dropDuplicates(["id"]).drop("id")


_BY_BLANK = _KNOWN.format(f"substr({_NORM}, 1, 3000)")


@query(rf"""SELECT doc_id, CASE WHEN regexp_matches({_BY_BLANK}, '\bnot\b|\bno\b') THEN 'no' WHEN regexp_matches({_BY_BLANK}, '\byes\b|\bcan\b|\bis a\b') THEN 'yes' ELSE 'UNKNOWN' END AS answer FROM documents""")
def one_question(store: Store) -> DataFrame:
    return store.raw("documents").select("doc_id", traits.one_question(F.col("text"), F.lit("Is it?"), providers.keyword_answer).alias("answer"))


# -- the extraction path -----------------------------------------------------------------

@query(f"SELECT * FROM ({ORACLES['eo_julian_max']}) x")
def eo_form_expression(store: Store) -> DataFrame:
    """The expression that the form composes: the mean over the year and the one before of the maximum of days 100 to 200."""
    return _rounded(raster.evaluate(store.request, _pixels(store), parse(compose("mean", 0, 1, "max", 100, 200))))


_DAYS = "v.ts >= CAST(make_date(CAST(w.y AS BIGINT), 1, 1) AS TIMESTAMP) AND v.ts < CAST(make_date(CAST(w.y AS BIGINT), 1, 1) AS TIMESTAMP) + INTERVAL 365 DAY"
_LATE = "r.year - 1 < 1993 OR r.year + 1 > 1998"
_RAIN, _COVER = "spatial_mean(0;years_mean(-1,0;julian_max(100,200)))", "spatial_mean(0;years_mean(0,0))"


@query(f"""WITH win AS ({_WIN.format(a=-1, b=0)}), m AS (SELECT v.pixel_id, w.ry, CASE WHEN 2 * sum(CASE WHEN v.label IN (1, 2, 3) THEN 1 ELSE 0 END) > count(*) THEN 1.0 ELSE 0.0 END AS mask FROM v_raster v JOIN win w ON {_DAYS} WHERE v.dataset_id = 'DS_A' GROUP BY v.pixel_id, w.ry),
{_JULIAN.format(agg="max(v.value)", lo=99, hi=200).replace("GROUP BY", "AND EXISTS (SELECT 1 FROM m WHERE m.pixel_id = v.pixel_id AND m.ry = w.ry) GROUP BY")},
rain AS (SELECT px.pixel_id, px.ry, avg(px.value * m.mask) AS value FROM px JOIN m ON m.pixel_id = px.pixel_id AND m.ry = px.ry GROUP BY px.pixel_id, px.ry),
cover AS (SELECT v.pixel_id, w.ry, {", ".join(f"avg(CASE WHEN v.label = {k} THEN 1.0 ELSE 0.0 END) AS k{k}" for k in range(9))} FROM v_raster v JOIN win w ON {_DAYS} WHERE v.dataset_id = 'DS_A' AND w.y = w.ry GROUP BY v.pixel_id, w.ry)
SELECT r.row_id, CASE WHEN {_LATE} THEN 'Outside 1993-1998: (' || (r.year - 1) || ', ' || (r.year + 1) || ')' END AS outside, CASE WHEN NOT ({_LATE}) THEN round(rain.value, 4) END AS rain, CASE WHEN NOT ({_LATE}) THEN round(rain.value * 0.5, 4) END AS half,
{", ".join(f'round(cover.k{k}, 6) AS "GOOGLE/DYNAMICWORLD/V1_lulc_prop_area_{k}_{_COVER}"' for k in range(9))}
FROM v_request r LEFT JOIN rain ON rain.pixel_id = r.pixel_id AND rain.ry = r.year LEFT JOIN cover ON cover.pixel_id = r.pixel_id AND cover.ry = r.year""")
def eo_extract(store: Store) -> DataFrame:
    """A guarded and masked column in two transforms, and a land-cover table, in one plan."""
    r = store.raster
    rain = r.where("dataset_id = 'DS_R'").select(F.lit("ECMWF/ERA5/MONTHLY").alias("dataset_id"), F.lit("total_precipitation").alias("band"), "ts", "pixel_id", "value")
    cover = r.where("dataset_id = 'DS_A'").select(F.lit("GOOGLE/DYNAMICWORLD/V1"), F.lit("label"), "ts", "pixel_id", F.col("label").cast("double"))
    places = store.point.select(F.col("id_key").alias("pixel_id"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    mask = ("GOOGLE/DYNAMICWORLD/V1", "label", (1.0, 2.0, 3.0))
    source = ("ECMWF/ERA5/MONTHLY", "total_precipitation", _RAIN)
    wanted = [X.Extraction(*source, mask=mask, years=(1993, 1998)), X.Extraction(*source, transform="mult[0.5]", mask=mask, years=(1993, 1998)), X.Extraction("*GOOGLE/DYNAMICWORLD/V1 landcover table", "", _COVER)]
    got = X.extract(store.request.drop("pixel_id"), rain.union(cover), places, wanted, cli=True)
    name = f"ECMWF/ERA5/MONTHLY_total_precipitation_{_RAIN}"
    plain, halved = F.col(f"`{name}_None`"), F.col(f"`{name}_mult[0.5]`")
    table = [c for c in got.columns if "_lulc_prop_area_" in c]
    return got.select(
        "row_id", F.when(plain.startswith("Outside"), plain).alias("outside"), F.round(plain.try_cast("double"), 4).alias("rain"), F.round(halved.try_cast("double"), 4).alias("half"),
        *(F.round(F.col(f"`{c}`"), 6).alias(c) for c in table))


@query("""SELECT * FROM (VALUES ('*GOOGLE/DYNAMICWORLD/V1 landcover table', 'mean', 2015, 2025), ('*MODIS/061/MCD12Q1 landcover table', 'mean', 2001, 2023), ('CSP/ERGo/1_0/Global/SRTM_topoDiversity:constant', 'max,mean,min,sd', 2001, 2023),
('ECMWF/ERA5/MONTHLY:dewpoint_2m_temperature', 'max,mean,min,sd', 1979, 2020), ('ECMWF/ERA5/MONTHLY:maximum_2m_air_temperature', 'max,mean,min,sd', 1979, 2020), ('ECMWF/ERA5/MONTHLY:mean_2m_air_temperature', 'max,mean,min,sd', 1979, 2020),
('ECMWF/ERA5/MONTHLY:minimum_2m_air_temperature', 'max,mean,min,sd', 1979, 2020), ('ECMWF/ERA5/MONTHLY:total_precipitation', 'max,mean,min,sd', 1979, 2020), ('GOOGLE/DYNAMICWORLD/V1:crops', 'mean', 2015, 2025),
('MODIS/061/MCD12Q2:Dormancy_1', 'max,mean,min,sd', 2001, 2023), ('MODIS/061/MCD12Q2:EVI_Amplitude_1', 'max,mean,min,sd', 2001, 2023), ('MODIS/061/MCD12Q2:EVI_Area_1', 'max,mean,min,sd', 2001, 2023),
('MODIS/061/MCD12Q2:Greenup_1', 'max,mean,min,sd', 2001, 2023), ('MODIS/061/MCD12Q2:Peak_1', 'max,mean,min,sd', 2001, 2023)) AS t(source, stats, first_year, last_year)""")
def source_menu(store: Store) -> DataFrame:
    """Each source with the statistics that the form lets through, found by asking it for each."""
    def allowed(source: str) -> str:
        dataset, _, band = (source, "", "") if source in X.TABLES else source.partition(":")
        out = []
        for stat in sorted(X.FULL_STATS):
            try:
                X.check_form(store.spark.range(1), [X.Extraction(dataset, band, f"spatial_{stat}(0;years_mean(0,0))")])
            except X.ExprError:
                continue
            out.append(stat)
        return ",".join(out)

    return store.spark.createDataFrame([(s, allowed(s), *X.years_of(s)) for s in X.SOURCES], "source string, stats string, first_year int, last_year int")


@query(f"SELECT pixel_id, CAST(y AS INT) AS year, round(avg(value) OVER (PARTITION BY pixel_id ORDER BY y RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS value FROM ({_YEARLY.format('max(value)')}) x")
def yearly_max_near(store: Store) -> DataFrame:
    """The mean of the yearly maximum over three years."""
    return _rounded(raster.yearly_then_mean(_pixels(store), around=1))


# -- what stands beside the pipeline -----------------------------------------------------


@query("""SELECT user_id, count(*) AS n, round(list_reduce(list(value ORDER BY ts, event_id), lambda a, x: 0.001 * x + 0.999 * a), 6) AS smoothed FROM events WHERE value IS NOT NULL GROUP BY user_id""")
def smoothed_times(store: Store) -> DataFrame:
    return _rounded(ranking.smoothed(store.raw("events"), "user_id", ["ts", "event_id"], "value"), "smoothed")


@query("""SELECT c_custkey, lpad(CAST(s // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS eta FROM (SELECT c_custkey, c_custkey * 5 % 86400 AS s FROM customer) x""")
def time_left(store: Store) -> DataFrame:
    return store.raw("customer").select("c_custkey", ranking.time_left(F.lit(2.5), F.col("c_custkey") * 2).alias("eta"))


def _fake_fetch(url: str) -> str:
    if url.endswith("3"):
        raise ConnectionError("refused by " + url)
    return f"<html>{url}</html>"


@query("""SELECT id, url, CASE WHEN NOT ends_with(url, '3') THEN '<html>' || url || '</html>' END AS html, CASE WHEN ends_with(url, '3') THEN 'ConnectionError: refused by ' || url END AS fetch_error FROM v_links""")
def fetched_pages(store: Store) -> DataFrame:
    """The links through a fetcher that fails on some."""
    return providers.fetch_pages(store.links, _fake_fetch)


@F.pandas_udf(BinaryType())
def _as_word(text: pd.Series) -> pd.Series:
    """Texts as Word documents, a paragraph for each line."""

    def one(t: str) -> bytes:
        space = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        lines = "".join(f'<w:p xmlns:w="{space}"><w:r><w:t>{html.escape(x[: len(x) // 2])}</w:t></w:r><w:r><w:t>{html.escape(x[len(x) // 2 :])}</w:t></w:r></w:p>' for x in t.split("\n"))
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("word/document.xml", f'<w:document xmlns:w="{space}"><w:body>{lines}</w:body></w:document>')
        return out.getvalue()

    return text.map(one, na_action="ignore")


@query(f"SELECT * FROM ({ORACLES['valid_words']}) x")
def document_words(store: Store) -> DataFrame:
    """Half of the documents as Word files, half as raw bytes, some of them no UTF-8 at their end."""
    d = store.raw("documents").where("text is not null")
    plain = F.regexp_replace("text", r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    data = F.when(F.col("doc_id") % 2 == 0, _as_word(plain)).when(F.col("doc_id") % 3 == 0, F.concat(F.col("text").cast("binary"), F.lit(b" \xff\xfe"))).otherwise(F.col("text").cast("binary"))
    words = d.select("doc_id", binary.document_text(data).alias("words"))
    return words.union(store.raw("documents").where("text is null").select("doc_id", F.lit("")))


@query(f"""SELECT section || '.js' AS file, 'var years = [' || array_to_string(list_transform(valid_years, lambda y: chr(39) || y || chr(39)), ', ') || ']; show("' || dataset || '", "' || dataset || '", "' || band || '", false);' || chr(10) || dataset || chr(10) || section || '.js' || chr(10) AS script
FROM ({ORACLES['dataset_catalog']}) x""")
def viewer_scripts(store: Store) -> DataFrame:
    template = 'var years = $VALID_YEARS$; show("$DATASET_NAME$", "$DATASET_ID$", "$BAND_ID$", $IMAGE_ONLY$);'
    return datasets.catalog(store.spark).select(*datasets.viewer_script(template))
