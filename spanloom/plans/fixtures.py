"""Inputs derived from the star-schema tables: query = supplier, target = part, alignment = line item.

The SQL runs on Spark and DuckDB alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.runtime import table

RAW_ALIGNMENTS = """
SELECT
  'Q' || CAST(s AS STRING) AS query_id,
  CASE WHEN ok % 97 = 0 THEN 'Q' || CAST(s AS STRING) ELSE 'T' || CAST(p AS STRING) END AS target_id,
  CAST(90 + (ok % 100) / 10.0 AS DOUBLE) AS identity_pct,
  CAST(qt - qf + 1 AS INT) AS aligned_length,
  CAST(CASE WHEN ln % 3 = 0 THEN qt ELSE qf END AS INT) AS query_start,
  CAST(CASE WHEN ln % 3 = 0 THEN qf ELSE qt END AS INT) AS query_end,
  CAST(len AS INT) AS query_length,
  CAST(CASE WHEN rf = 'R' THEN qt - qf + 1 ELSE 1 END AS INT) AS target_start,
  CAST(CASE WHEN rf = 'R' THEN 1 ELSE qt - qf + 1 END AS INT) AS target_end,
  CAST(qt - qf + 1 AS INT) AS target_length,
  CAST((qt - qf + 1) AS DOUBLE) / len AS query_coverage,
  CAST(1.0 AS DOUBLE) AS target_coverage,
  CAST(0.0 AS DOUBLE) AS evalue,
  CAST(2 * (qt - qf + 1) AS DOUBLE) AS bitscore
FROM (
  SELECT ok, ln, s, p, rf, len,
    CASE WHEN full_len THEN 1
         WHEN s % 4 = 0 THEN CASE WHEN p % 4 < 2 THEN 1 + j + 10 ELSE 405 + j END
         WHEN s % 4 = 1 THEN 1 + (ok * 13 + ln) % 300
         WHEN s % 4 = 2 THEN 1 + (ok * 29 + ln * 17) % (len - 200)
         ELSE CASE WHEN p % 4 < 2 THEN 1 + j + 10 ELSE 480 + j END END AS qf,
    CASE WHEN full_len THEN len
         WHEN s % 4 = 0 THEN CASE WHEN p % 4 < 2 THEN 400 + j ELSE len - j - 10 END
         WHEN s % 4 = 1 THEN 500 + j
         WHEN s % 4 = 2 THEN 1 + (ok * 29 + ln * 17) % (len - 200) + 199
         ELSE CASE WHEN p % 4 < 2 THEN 520 + j ELSE len - j - 10 END END AS qt
  FROM (
    SELECT l_orderkey AS ok, CAST(l_linenumber AS BIGINT) AS ln, l_suppkey AS s, l_partkey AS p,
      l_returnflag AS rf, 800 + (l_suppkey % 5) * 100 AS len,
      (l_orderkey * 7 + l_linenumber * 3) % 21 - 10 AS j,
      (l_suppkey % 8 = 4 AND l_quantity > 45) AS full_len
    FROM {lineitem}) b) g
"""

REPRESENTATIVES = """
SELECT 'Q' || CAST(s_suppkey AS STRING) AS representative_contig_id FROM {supplier}
UNION ALL SELECT 'N' || CAST(n_nationkey AS STRING) FROM {nation}
"""

ANNOTATIONS = """
SELECT 'T' || CAST(p_partkey AS STRING) AS qseqid,
  p_size % 5 <> 0 AS has_viral_hit, p_size % 5 > 1 AS best_hit_is_viral,
  CASE WHEN p_size % 5 > 1 THEN 'Viruses' ELSE 'Eukaryota' END AS best_domain,
  CASE WHEN p_partkey % 4 < 2 THEN 'FamA' ELSE 'FamB' END AS best_family,
  p_brand AS best_genus, p_type AS best_species, p_name AS best_title,
  CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 11 = 0 THEN ' n/a '
       WHEN p_partkey % 4 < 2 THEN 'FamA' ELSE 'FamB' END AS best_viral_family,
  p_brand AS best_viral_genus, p_type AS best_viral_species,
  CASE WHEN p_size % 5 = 0 THEN NULL
       WHEN p_size % 13 = 0 THEN 'hypothetical protein VP' || CAST(p_size AS STRING) || ' [Virus X]'
       WHEN p_partkey % 4 < 2 THEN 'RNA-dependent RNA polymerase, segment L [Virus ' || p_brand || ']'
       ELSE 'nucleocapsid protein NSs [Virus ' || p_brand || ']' END AS best_viral_title
FROM {part} WHERE p_type <> 'PROMO'
"""

#: Variants of an alternative layout, dealt to peaks: target counts, coverage, orientation, order, two gaps.
LAYOUTS = """
SELECT p.peak_id, 'A' || CAST(v.k AS STRING) AS alternative_query_id,
  CAST(v.e AS BIGINT) AS end_target_count, CAST(v.s AS BIGINT) AS start_target_count,
  CAST(v.cov AS DOUBLE) AS alternative_union_coverage_fraction,
  v.orientation AS projected_orientation_relation, v.ordering AS oriented_endpoint_order,
  CAST(v.linear_gap + p.peak_position % 7 AS BIGINT) AS linear_end_to_start_gap_nt,
  CAST(v.end_gap AS BIGINT) AS sequence_end_end_to_start_gap_nt
FROM {peaks} p CROSS JOIN (VALUES
  (1, 3, 5, 0.5, 'same', 'end_before_start', 0, 900),
  (2, 4, 4, 0.4, 'same', 'end_before_start', 294, 900),
  (3, 9, 9, 0.39, 'same', 'end_before_start', 10, 900),
  (4, 9, 9, 0.9, 'mixed', 'end_before_start', 10, 900),
  (5, 5, 3, 0.6, CAST(NULL AS STRING), 'start_before_end', 900, 300),
  (6, 5, 3, 0.7, 'reverse', 'start_before_end', 900, 301),
  (7, 2, 8, 0.8, 'same', 'end_before_start', 5, 900),
  (8, 6, 6, 0.8, 'same', 'other', 5, 5)) v(k, e, s, cov, orientation, ordering, linear_gap, end_gap)
"""

LINKS = """
SELECT DISTINCT t.peak_id, t.query_id AS source_query_id, t.target_id, o.query_id AS alternative_query_id
FROM {targets} t JOIN {alignments} o ON o.target_id = t.target_id AND o.query_id <> t.query_id
WHERE ((t.score_geometry = 'one_sided_end' AND t.enters_peak_end_count)
   OR (t.score_geometry = 'one_sided_start' AND t.enters_peak_start_count))
"""

QUARANTINED = """
SELECT query_id AS contig_id FROM {alignments} GROUP BY query_id HAVING max(query_length) = 800
"""

LOOKUP = """
SELECT CAST(s_suppkey AS STRING) AS sequence_key, 'Q' || CAST(s_suppkey AS STRING) AS contig_id FROM {supplier}
UNION ALL SELECT CAST(1000000 + p_partkey AS STRING), 'T' || CAST(p_partkey AS STRING) FROM {part}
"""

#: Intervals of another kind, for the general counting: how many customers have an order open on a day.
ORDER_SPANS = """
SELECT o_orderpriority AS axis, o_custkey AS member, CAST(1 + o_orderkey % 97 AS INT) AS l,
  CAST(1 + o_orderkey % 97 + o_custkey % 13 - 2 AS INT) AS r, 100 AS length
FROM {orders}
"""


#: Numbers as text, in spellings that only rounding casts take.
ROUGH_ALIGNMENTS = """
SELECT 'Q' || CAST(l_suppkey AS STRING) AS query_id, 'T' || CAST(l_partkey AS STRING) AS target_id,
  ' 9' || CAST(l_linenumber AS STRING) || '.5 ' AS identity_pct,
  CAST(l_orderkey AS STRING) || '.' || CAST(l_linenumber AS STRING) AS aligned_length,
  CAST(l_partkey AS STRING) || 'e' || CAST(l_linenumber % 3 AS STRING) AS query_start,
  ' +' || CAST(l_suppkey AS STRING) || '.50 ' AS query_end, '-.' || CAST(l_linenumber AS STRING) AS query_length,
  CAST(l_linenumber AS STRING) || '_000' AS target_start, CAST(l_linenumber AS STRING) || '5e-1' AS target_end,
  '00' || CAST(l_linenumber AS STRING) || '.' AS target_length, '1_0.5e-1' AS query_coverage, '.5' AS target_coverage,
  '1e-' || CAST(l_linenumber AS STRING) AS evalue, CAST(l_orderkey AS STRING) || '.25' AS bitscore
FROM {lineitem}
"""

#: Without two columns; ids are missing or stand twice.
BROKEN_ANNOTATIONS = """
SELECT CASE WHEN p_size > 45 THEN NULL ELSE 'T' || CAST(CAST(FLOOR(p_partkey / 2.0) AS BIGINT) AS STRING) END AS qseqid,
  p_size > 10 AS has_viral_hit, p_size > 20 AS best_hit_is_viral, 'Viruses' AS best_domain, p_brand AS best_family, p_brand AS best_genus,
  p_brand AS best_viral_family, p_brand AS best_viral_genus, p_type AS best_viral_species, p_name AS best_viral_title
FROM {part}
"""


def run(spark: SparkSession, sql: str, sf_dir: str, **more) -> DataFrame:
    """The SQL over the tables that it names."""
    names = {n for n in ("lineitem", "supplier", "nation", "part", "orders") if "{" + n + "}" in sql}
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names}, **more)
