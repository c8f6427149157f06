"""Domain tables as portable SQL over the raw parquet tables.

Each view is plain SQL that both Spark and other engines run, so that a reference
query can inline the same adapters as common table expressions.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession

from ..shipping import ship

RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_TEMPLATES = (
    ("Can [species] fly?", '"[species]" can fly'), ("Is [species] a pest?", '"[species]" pest'), ("Is [species] invasive?", '"[species]" invasive exotic'),
    *((f"q{i} [species]", f'"[species]" q{i}') for i in range(3, 9)),
)

VIEWS = {
    "v_study": "SELECT c_custkey AS id_key, c_name AS name FROM customer",
    "v_point": "SELECT p_partkey AS id_key, CAST((p_partkey * 37) % 18000 AS DOUBLE) / 100 - 90 AS latitude, CAST((p_partkey * 7919) % 36000 AS DOUBLE) / 100 - 180 AS longitude FROM part",
    "v_geolocation": "SELECT CAST(n_nationkey AS BIGINT) AS id_key, n_name AS geolocation_name, 'COUNTRY' AS geolocation_type FROM nation UNION ALL SELECT CAST(1000 + r_regionkey AS BIGINT), r_name, 'CONTINENT' FROM region",
    "v_geo_point": "SELECT p_partkey AS point_id, p_partkey % 25 AS geolocation_id FROM part UNION ALL SELECT p.p_partkey, CAST(1000 + n.n_regionkey AS BIGINT) FROM part p JOIN nation n ON n.n_nationkey = p.p_partkey % 25",
    "v_sample": "SELECT o_orderkey AS id_key, o_totalprice AS observation, (o_orderkey * 7 + o_custkey) % 200 AS point_id, o_custkey AS study_id, CAST(EXTRACT(YEAR FROM o_orderdate) AS INT) AS year FROM orders",
    "v_covariate_defn": "SELECT id_key, name, true AS editable_name, CAST(display_order AS DOUBLE) AS display_order, 'no description provided' AS description, queryable, always_display, hidden, show_in_point_table, search_by_unique, covariate_type, covariate_association FROM (VALUES (1,'Segment',1.0,true,true,false,false,true,0,0),(2,'Acctbal',2.0,true,false,false,false,false,1,0),(3,'Status',3.0,true,true,false,false,true,0,1),(4,'Priority',4.0,true,false,false,false,true,0,1),(5,'Month',5.0,true,false,false,true,false,2,1),(6,'Internal',6.0,false,false,true,false,false,0,1)) AS t(id_key,name,display_order,queryable,always_display,hidden,show_in_point_table,search_by_unique,covariate_type,covariate_association)",
    "v_covariate_value": "SELECT 1 AS covariate_defn_id, c_mktsegment AS value, c_custkey AS study_id, CAST(NULL AS BIGINT) AS sample_id, c_custkey AS id_key FROM customer UNION ALL SELECT 3, o_orderstatus, CAST(NULL AS BIGINT), o_orderkey, 1000000000 + o_orderkey * 3 FROM orders UNION ALL SELECT 4, o_orderpriority, CAST(NULL AS BIGINT), o_orderkey, 1000000000 + o_orderkey * 3 + 1 FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT 5, CAST(EXTRACT(MONTH FROM o_orderdate) AS VARCHAR(4)), CAST(NULL AS BIGINT), o_orderkey, 1000000000 + o_orderkey * 3 + 2 FROM orders",
    "v_content": "SELECT MIN(d.doc_id) AS id, {SHA} AS content_hash, MIN(d.text) AS text, MIN(l.quality) AS is_valid FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY {SHA}",
    "v_links": "SELECT d.doc_id AS id, 'https://' || d.source || '.example.org/' || CAST(d.doc_id AS VARCHAR(20)) AS url, CASE WHEN d.doc_id % 17 = 0 THEN NULL ELSE c.cid END AS content_id, CASE WHEN d.doc_id % 34 = 0 THEN 'timeout' END AS fetch_error FROM documents d JOIN (SELECT {SHA} AS h, MIN(d.doc_id) AS cid FROM documents d GROUP BY {SHA}) c ON c.h = {SHA}",
    "v_species": "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation",
    "v_questions": "SELECT CAST(n.n_nationkey * 9 + t.k AS BIGINT) AS id, REPLACE(t.txt, '[species]', n.n_name) AS text, REPLACE(t.kw, '[species]', n.n_name) AS keyword_phrase FROM nation n CROSS JOIN (SELECT * FROM (VALUES " + ", ".join(f"({i},'{q}','{k}')" for i, (q, k) in enumerate(_TEMPLATES)) + ") AS t(k,txt,kw)) t",
    "v_species_questions": "SELECT CAST(n_nationkey AS BIGINT) AS species_id, CAST(n_nationkey * 9 + k AS BIGINT) AS question_id FROM nation CROSS JOIN (SELECT * FROM (VALUES (0),(1),(2),(3),(4),(5),(6),(7),(8)) AS t(k)) t",
    "v_question_links": "SELECT doc_id AS id, doc_id % 200 AS question_id, doc_id AS link_id FROM documents",
    "v_answers": "SELECT l.doc_id AS id, l.doc_id AS question_link_id, l.doc_id % 200 AS question_id, l.doc_id AS link_id, CASE WHEN l.quality = 1 THEN 'yes' ELSE 'unknown' END AS answer_text, CASE WHEN l.quality = 1 THEN 'supported' ELSE 'not_enough_information' END AS reason, SUBSTRING(d.text, 1, 400) AS context FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE l.doc_id % 2 = 0",
    "v_raster": "SELECT CONCAT('DS_', l_returnflag) AS dataset_id, 'value' AS band, l_shipdate AS ts, l_partkey AS pixel_id, l_extendedprice AS value, l_linenumber AS label FROM lineitem",
    "v_request": "SELECT o.o_orderkey AS row_id, p.latitude, p.longitude, CAST(EXTRACT(YEAR FROM o.o_orderdate) AS INT) AS year, p.id_key AS pixel_id FROM orders o JOIN v_point p ON p.id_key = (o.o_orderkey * 7 + o.o_custkey) % 200",
}

_SHA = {"spark": "sha2(d.text, 256)", "duckdb": "sha256(d.text)"}


def _needs(sql: str) -> list[str]:
    return [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]


def inline(sql: str) -> str:
    """``sql`` for another engine, with the views that it uses as common table expressions."""
    used: list[str] = []

    def add(text: str) -> None:
        for v in _needs(text):
            if v not in used:
                add(VIEWS[v])
                used.append(v)

    add(sql)
    ctes = [f"{v} AS ({VIEWS[v].replace('{SHA}', _SHA['duckdb'])})" for v in VIEWS if v in used]
    sql = sql.strip()
    if not ctes:
        return sql
    rest = sql[5:].strip() if sql[:5].upper() == "WITH " else None
    return f"WITH {', '.join(ctes)}, {rest}" if rest is not None else f"WITH {', '.join(ctes)} {sql}"


class Store:
    """Domain tables over one directory of raw parquet tables, or over tables given by name."""

    def __init__(self, spark: SparkSession, directory: str, tables: dict[str, DataFrame] | None = None) -> None:
        ship(spark)
        self.spark, self.directory, self.given = spark, directory, dict(tables or {})
        self._made: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self.given.get(name) if name in self.given else self.spark.read.parquet(os.path.join(self.directory, f"{name}.parquet"))
        return self._made[name]

    def __getattr__(self, name: str) -> DataFrame:
        view = f"v_{name}"
        if name.startswith("_") or view not in VIEWS:
            raise AttributeError(name)
        if name in self.given:
            return self.given[name]
        if view not in self._made:
            self._made[view] = self._sql(VIEWS[view].replace("{SHA}", _SHA["spark"]))
        return self._made[view]

    def _sql(self, sql: str) -> DataFrame:
        """Raw tables and views are bound as arguments, so no global name is touched."""
        used: dict[str, DataFrame] = {}

        def bind(m: re.Match) -> str:
            name = m[2]
            used[name] = getattr(self, name[2:]) if name.startswith("v_") else self.raw(name)
            return f"{m[1]} {{{name}}}"

        names = "|".join([*RAW, *VIEWS])
        text = re.sub(rf"\b(FROM|JOIN) ({names})\b", bind, sql)
        return self.spark.sql(text, **used)
