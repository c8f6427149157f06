"""The thin queries: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, blob_ledger, decontamination, packing, pii, quality, revisits, simhash, token_counts, url_filter
from .common import cut, new_folder, read

#: Texts with more tokens than this are over the limit.
TOKEN_LIMIT = 2048


def op1_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents arrive in two parts; the second increment scans only what the ledger of the first lacks."""
    docs, folder = read(spark, sf_dir, "documents"), new_folder(spark, "ledger")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    for i in range(2):
        ledger = blob_ledger.run(docs.where(part == i), folder)
    return blob_ledger.digest(blob_ledger.from_ledger(docs, ["doc_id"], ledger), ["doc_id"])


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    listed = cut(url_filter.recrawled(pages))  # small beside the pages, and read several times
    return url_filter.judge(pages, url_filter.rule_table(spark), listed, ["page_id"])


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = revisits.captures(read(spark, sf_dir, "pages"))
    found = revisits.resolve(log)
    return found.select(F.col("id").alias("page_id"), "target", "status", "response_id", "payload_digest", "payload_length", revisits.header_lines(F.col("headers")).alias("headers"))


def op4_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels")
    weights = quality.fit(docs, labels.where(~quality.held_out()))
    scored = quality.score(docs, weights, keep=["doc_id"])
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(vectors, vectors.where("vec_id % 100 = 0"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(read(spark, sf_dir, "documents"), ["doc_id"])
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(read(spark, sf_dir, "documents"), ["doc_id"]), ["doc_id"])


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_secret_ledger, op2_url_filter, op3_warc_revisits, op4_simhash_golay, op5_quality_ftrl, op6_additive_quantisation, op7_token_counts, op8_pii, op9_decontamination, op10_best_fit_packing)
}


def _op1_sql() -> str:
    """Places come from the lengths of the parts between matches."""
    base = ", ".join(f"'{k}'" for k in blob_ledger.BASE)
    kinds = []
    for i, r in enumerate(blob_ledger.RULES):
        pattern = r.pattern.replace("'", "''")
        kinds.append(
            f"SELECT doc_id, {i} AS r, '{r.kind}' AS kind, {r.group} AS g, {r.least} AS least, string_split_regex(t, '{pattern}') AS gaps, "
            f"regexp_extract_all(t, '{pattern}', 0) AS hits, regexp_extract_all(t, '{pattern}', {r.group}) AS vals FROM d WHERE regexp_matches(t, '{pattern}')"
        )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(kinds)}),
u AS (SELECT doc_id, r, kind, least, unnest(range(1, len(hits) + 1)) AS i, gaps, hits, vals FROM m),
s AS (SELECT doc_id, r, kind, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0) AS s,
      length(hits[i]) AS n FROM u WHERE length(vals[i]) >= least),
f AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
      coalesce(string_agg(kind || ':' || s::BIGINT || ':' || (s + n)::BIGINT, ',' ORDER BY s, r) FILTER (kind IN ({base})), '') AS base,
      string_agg(kind || ':' || s::BIGINT || ':' || (s + n)::BIGINT, ',' ORDER BY s, r) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(d.t) AS blob_id
FROM d LEFT JOIN f ON f.doc_id = d.doc_id"""


_PARTS = r"""
parts AS (SELECT page_id, url, html, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
hp AS (SELECT page_id, url, html, lower(regexp_extract(rest, '^[^/?#]*')) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts)"""

_OP2_SQL = f"""
WITH {_PARTS},
rules AS (SELECT * FROM (VALUES {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in url_filter.RULES)}) AS t(verdict, rh, rp)),
fit AS (SELECT page_id, rh || rp AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC) AS k
        FROM hp JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)),
many AS (SELECT host, path FROM hp WHERE host <> '' GROUP BY host, path HAVING count(*) > 1)
SELECT hp.page_id, hp.host, hp.path, fit.rule, coalesce(fit.verdict, CASE WHEN many.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM hp LEFT JOIN fit ON fit.page_id = hp.page_id AND k = 1 LEFT JOIN many ON many.host = hp.host AND many.path = hp.path"""

_OP3_SQL = f"""
WITH {_PARTS},
c AS (SELECT page_id, md5(concat_ws(' ', url, CAST(page_id AS VARCHAR))) AS mark, CAST(page_id // 5000 AS VARCHAR) AS epoch, html,
      nullif(regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/$', ''), '') AS target FROM hp),
r AS (SELECT page_id, target, epoch, mark, html, substr(mark, 1, 1) IN ('0','1','2','3') AS full_, CASE WHEN substr(mark, 2, 1) NOT IN ('0','1','2') THEN '"' || substr(md5(target || ':' || epoch), 1, 12) || '"' END AS etag FROM c),
s AS (SELECT a.*, b.page_id AS bid, b.etag AS betag, b.epoch AS bepoch, b.html AS bhtml,
      CASE WHEN a.full_ THEN 'response' WHEN b.page_id IS NULL THEN 'orphan'
           WHEN CASE WHEN a.etag IS NOT NULL AND b.etag IS NOT NULL THEN a.etag = b.etag ELSE coalesce(a.epoch = b.epoch, false) END THEN 'resolved' ELSE 'mismatch' END AS status
      FROM r a ASOF LEFT JOIN (SELECT * FROM r WHERE full_) b ON a.target = b.target AND a.page_id > b.page_id)
SELECT page_id, target, status, CASE status WHEN 'response' THEN page_id WHEN 'orphan' THEN NULL ELSE bid END AS response_id,
       CASE status WHEN 'response' THEN md5(coalesce(html, '')) WHEN 'resolved' THEN md5(coalesce(bhtml, '')) END AS payload_digest,
       CASE status WHEN 'response' THEN strlen(coalesce(html, '')) WHEN 'resolved' THEN strlen(coalesce(bhtml, '')) END AS payload_length,
       concat_ws(chr(10), CASE WHEN full_ OR status = 'resolved' THEN 'content-type: text/html' END, 'date: ' || page_id,
                 'etag: ' || CASE WHEN status = 'resolved' THEN coalesce(etag, betag) ELSE etag END,
                 'last-modified: ' || CASE WHEN status = 'resolved' THEN bepoch ELSE epoch END,
                 CASE WHEN NOT full_ AND status <> 'resolved' THEN 'set-cookie: ' || substr(mark, 1, 6) END) AS headers
FROM s"""

#: Letters that the word boundaries of the other engine do not know, as ones that it knows and lower case lacks.
_KNOWN = "translate({}, 'éèñßêçíöüóä', 'ABCDEFGHIJK')"


def _op8_sql() -> str:
    """Patterns as the contract has them; checksums over lists of digits."""
    number = "regexp_replace(v, '[^0-9]', '', 'g')"
    compact = "replace(v, ' ', '')"
    turned = f"string_split(substr({compact}, 5) || substr({compact}, 1, 4), '')"
    rules = {
        "email": ("[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+", "true", 0.9),
        "ip": ("[0-9]+(?:\\.[0-9]+)(?:\\.[0-9]+)(?:\\.[0-9]+)", "list_bool_and(list_transform(string_split(v, '.'), lambda x: coalesce(TRY_CAST('0' || ltrim(x, '0') AS INT) <= 255, false)))", 0.6),
        "card": ("[0-9](?:[ -]?[0-9])+", f"length({number}) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length({number}) + 1), lambda k: CAST(substr({number}, length({number}) - k + 1, 1) AS INT) * (2 - k % 2)"
                 f" - CASE WHEN k % 2 = 0 AND CAST(substr({number}, length({number}) - k + 1, 1) AS INT) > 4 THEN 9 ELSE 0 END)) % 10 = 0", 0.8),
        "phone": ("[+][0-9][ ().0-9-]+[0-9]", f"length({number}) BETWEEN 10 AND 15", 0.5),
        "iban": ("\\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\\b",
                 f"list_reduce(list_prepend(0::BIGINT, list_transform({turned}, lambda c: CAST(CASE WHEN c >= 'A' THEN ascii(c) - 55 ELSE ascii(c) - 48 END AS BIGINT))), lambda a, c: (a * CASE WHEN c > 9 THEN 100 ELSE 10 END + c) % 97) = 1", 0.9),
    }
    context = {"email": "e-?mail|mail|contact|write|kontakt|correo|courriel|@", "ip": "\\bip\\b|address|host|server|adresse", "card": "card|credit|visa|payment|karte|tarjeta|carte", "phone": "phone|tel|call|mobile|fax|anruf|llam", "iban": "iban|bank|account|konto|cuenta|compte"}
    found = " UNION ALL ".join(
        f"SELECT doc_id, t, {i} AS r, '{kind}' AS kind, s, v, {prior} + CASE WHEN regexp_matches({_KNOWN.format('lower(substr(t, greatest(s - 40, 0)::BIGINT + 1, least(s, 40)::BIGINT))')}, '{context[kind]}') THEN {(1 - prior) / 2} ELSE 0.0 END AS score FROM ("
        f"SELECT doc_id, t, hits[i] AS v, list_sum(gaps[1:i]) + coalesce(list_sum(lens[1:i-1]), 0) AS s FROM (SELECT doc_id, t, hits, lens, gaps, unnest(range(1, len(hits) + 1)) AS i FROM ("
        f"SELECT doc_id, t, regexp_extract_all(t, '{pattern}') AS hits, list_transform(regexp_extract_all(t, '{pattern}'), lambda x: length(x)) AS lens, list_transform(string_split_regex(t, '{pattern}'), lambda x: length(x)) AS gaps FROM d"
        f" WHERE regexp_matches(t, '{pattern}')) a) b) c WHERE {valid}"
        for i, (kind, (pattern, valid, prior)) in enumerate(rules.items())
    )
    span = "kind || ':' || s::BIGINT || ':' || (s + length(v))::BIGINT"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in pii.BASE)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({found}),
g AS (SELECT doc_id, {counts}, string_agg({span}, ',' ORDER BY s, r) FILTER (kind <> 'iban') AS base, string_agg({span}, ',' ORDER BY s, r) AS spans,
 string_agg(printf('%.2f', score::DOUBLE), ',' ORDER BY s, r) AS scores FROM f GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in pii.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM d LEFT JOIN g ON g.doc_id = d.doc_id"""


ORACLES = {"op1_secret_ledger": _op1_sql(), "op2_url_filter": _OP2_SQL, "op3_warc_revisits": _OP3_SQL, "op8_pii": _op8_sql()}
