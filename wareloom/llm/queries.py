"""The registered queries of the corpus operators over whole tables, with SQL where it can express them."""

from pyspark.sql import functions as F

from wareloom.llm import (
    decontamination,
    extraction,
    license_scan,
    likelihood,
    near_dup,
    negatives,
    packing,
    quality,
    sharding,
    spelling,
    token_edits,
    toxicity,
    url_rules,
)
from wareloom.llm.common import read_table


def op1_quality_rules(spark, sf_dir):
    return quality.quality_rules(read_table(spark, sf_dir, "documents"))


def op2_sharding(spark, sf_dir):
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"))


def op3_url_filters(spark, sf_dir):
    return url_rules.filter_urls(read_table(spark, sf_dir, "pages"), url_rules.rules_table(spark))


def op4_html_extraction(spark, sf_dir):
    return extraction.extract_pages(read_table(spark, sf_dir, "pages"))


def op5_near_dup(spark, sf_dir):
    return near_dup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op6_token_counts(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    edited = docs.select("doc_id", "text", token_edits.revisions(F.col("text")).alias("edits"))
    return token_edits.count_after_edits(edited).drop("text")


def op7_packing(spark, sf_dir):
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


def op8_toxicity(spark, sf_dir):
    return toxicity.score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_license_scan(spark, sf_dir):
    return license_scan.scan_licenses(read_table(spark, sf_dir, "documents"))


def op10_decontamination(spark, sf_dir):
    return decontamination.find_contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op11_spelling(spark, sf_dir):
    return spelling.spelling_variants(read_table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark, sf_dir):
    return negatives.mine_negatives(read_table(spark, sf_dir, "embeddings"))


def op13_lm_scoring(spark, sf_dir):
    return likelihood.score_documents(read_table(spark, sf_dir, "documents"))


QUERIES = {
    query.__name__: query
    for query in (
        op1_quality_rules,
        op2_sharding,
        op3_url_filters,
        op4_html_extraction,
        op5_near_dup,
        op6_token_counts,
        op7_packing,
        op8_toxicity,
        op9_license_scan,
        op10_decontamination,
        op11_spelling,
        op12_hard_negatives,
        op13_lm_scoring,
    )
}


def _text(value):
    return "'" + value.replace("'", "''") + "'"


_RULES = ", ".join(
    f"({_text(host)}, {_text(path)}, {_text(host + path)}, {_text(action)})" for host, path, action in url_rules.RULES
)

_URL_FILTERS = rf"""
WITH rules(rule_host, rule_path, rule, action) AS (VALUES {_RULES}),
cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
),
parsed AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*', 0), '{url_rules._UPPER}', '{url_rules._LOWER}') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
),
fitted AS (
  SELECT page_id, rule, action, row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host) DESC, length(rule_path) DESC) AS place
  FROM parsed JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT p.page_id, host, path, rule, coalesce(action, 'allow') AS verdict
FROM parsed p LEFT JOIN fitted f ON p.page_id = f.page_id AND f.place = 1
"""

_TEMPLATES = ", ".join(f"({_text(name)}, {_text(text)})" for name, text in license_scan.TEMPLATES)
_WORDS = rf"regexp_extract_all(translate({{}}, '{url_rules._UPPER}', '{url_rules._LOWER}'), '[a-z0-9]+')"

_LICENSE_SCAN = rf"""
WITH templates(license, text) AS (VALUES {_TEMPLATES}),
wanted AS (
  SELECT license, list_distinct([array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)]) AS wanted
  FROM (SELECT license, {_WORDS.format('text')} AS w FROM templates)
),
owned AS (
  SELECT doc_id, list_distinct([array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)]) AS owned
  FROM (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents) WHERE len(w) >= 5
),
wanted_words AS (SELECT license, len(wanted) AS n_shingles, unnest(wanted) AS shingle FROM wanted),
owned_words AS (SELECT doc_id, unnest(owned) AS shingle FROM owned)
SELECT doc_id, license, n_shingles, count(*) AS n_found
FROM owned_words JOIN wanted_words USING (shingle)
GROUP BY doc_id, license, n_shingles HAVING 100 * count(*) >= {license_scan.PERCENT} * n_shingles
"""

_HARD_NEGATIVES = f"""
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor({negatives.SCALE} * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_dot_product(a.v, r.v)::BIGINT AS score
  FROM usable a JOIN usable r ON a.vec_id <> r.vec_id
  WHERE a.vec_id % {negatives.ANCHOR_EVERY} = 0
),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {negatives.POSITIVES}
)
SELECT p.anchor_id, positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT same
  AND {negatives.LOWEST_PERCENT} * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= {negatives.NEGATIVES}
"""

CHECKS = {"op12_hard_negatives": _HARD_NEGATIVES, "op3_url_filters": _URL_FILTERS, "op9_license_scan": _LICENSE_SCAN}
