"""The opN_<name> queries over the driver tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, exact_dedup, fingerprints, html_text, jaccard, licenses, mixing, quality, secret_scan, token_counts
from ._shared import table

RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.jaccard_components(table(spark, sf_dir, "documents"), words=3, num=90, den=100)
    return found.select("doc_id", "n_shingles", "component_id")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("th")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_token_counts(
        table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    )


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = secret_scan.train(secret_scan.labelled_findings(spark))
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"), model)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    return found.withColumn("licenses", F.array_join("licenses", ","))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_jaccard_join, op2_quality, op3_bpe, op4_token_counts, op5_secret_scan, op6_exact_dedup, op7_html_text, op8_mix_sources, op9_license_scan, op10_fingerprints,
    )
}


def _license_templates() -> str:
    """The templates' distinct bigrams as rows of SQL."""
    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    rows = [f"({quoted(n)}, [{', '.join(map(quoted, licenses.template_bigrams(t)))}])" for n, t in licenses.TEMPLATES]
    return ", ".join(rows)


ORACLE_SQL: dict[str, str] = {
    "op6_exact_dedup": r"""
WITH s AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
  FROM documents),
g AS (
  SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id
  FROM s)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM g""",
    "op1_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS sh
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY ALL),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS inter FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM p JOIN n AS nx ON nx.doc_id = x JOIN n AS ny ON ny.doc_id = y WHERE 100 * inter >= 90 * (nx.n + ny.n - inter)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT x, y FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(w.doc_id, coalesce(min(r.y), w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN reach r ON r.x = w.doc_id GROUP BY w.doc_id""",
    "op9_license_scan": r"""
WITH t AS (SELECT * FROM (VALUES """ + _license_templates() + r""") AS v(name, grams)),
u AS (
  SELECT doc_id, 1 AS line, unnest(string_split(coalesce(text, ''), chr(10))) AS u FROM documents UNION ALL
  SELECT DISTINCT doc_id, 0, u FROM (
    SELECT doc_id, unnest(list_append(regexp_split_to_array(text, '\n[ \t\r\n*#/;%-]*\n|\*/'), text)) AS u FROM documents WHERE contains(text, chr(10)))),
w AS (SELECT doc_id, line, regexp_extract_all(lower(u), '[\p{L}\p{N}]+') AS w FROM u),
g AS (
  SELECT row_number() OVER () AS k, doc_id, line, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g
  FROM w WHERE len(w) >= 2),
d AS (
  SELECT k, doc_id, line, name, 2.0 * len(list_intersect(g, grams)) / (len(g) + len(grams)) AS dice FROM g JOIN t ON len(g) BETWEEN len(grams) * 0.6 AND len(grams) * 1.6),
best AS (SELECT k, doc_id, line, max(dice) AS dice, arg_max(name, (dice, name)) AS name FROM d WHERE dice >= 0.8 GROUP BY ALL),
one AS (
  SELECT doc_id, count(*) FILTER (line = 1) AS n_matches, list_sort(list_distinct(list(name))) AS licenses, max(dice) AS dice, arg_min(name, (-dice, name)) AS license_id
  FROM best GROUP BY doc_id)
SELECT documents.doc_id, license_id, CAST(dice AS DOUBLE) AS dice, coalesce(array_to_string(licenses, ','), '') AS licenses, coalesce(n_matches, 0) AS n_matches
FROM documents LEFT JOIN one USING (doc_id)""",
}
