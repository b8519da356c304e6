"""The queries of the corpus operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanloom.runtime import settled, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.llm import langid

    docs = table(spark, sf_dir, "documents")
    rows = docs.withColumn("held_out", langid.held_out())
    # A null doc_id has no remainder; such rows aren't learned from.
    model = langid.fit(rows.where("doc_id IS NOT NULL AND NOT held_out").select("text", "lang"))
    return langid.identify(rows, model, keep=["doc_id", "held_out"])


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.llm.tokencount import section_tokens

    return section_tokens(table(spark, sf_dir, "documents"), rule="most")


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.llm.tokenbin import token_ids

    return token_ids(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.llm.chunking import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.llm.tiling import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.llm.matroska import media_features, store_texts

    return media_features(store_texts(table(spark, sf_dir, "documents")))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.llm.warc import archive_pages

    return archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.llm.pii import find

    return find(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.llm.alignment import align

    return align(table(spark, sf_dir, "documents"))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.llm.hyperplanes import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


def _settled(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: settled(query(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: _settled(f) for f in (op1_language_id, op2_token_counts, op3_token_ids, op4_substring_dedup, op5_decontamination, op6_minhash, op7_media_columns, op8_warc, op9_pii, op10_packing, op11_token_alignment, op12_embedding_dedup, op13_collocations)}


#: Components by brute force over all pairs that share a shingle, and reachability.
OP6_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT doc_id AS node, doc_id AS other FROM documents UNION SELECT r.node, e.y FROM reach r JOIN edges e ON e.x = r.other)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, c.component_id, c.component_id = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT node, min(other) AS component_id FROM reach GROUP BY 1) c ON c.node = d.doc_id
"""

#: Base32 of the SHA-1: four characters of every five hexadecimal digits.
OP8_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x, strlen(coalesce(html, ''))::BIGINT AS n FROM pages),
f AS (SELECT x, min(page_id) AS first FROM p GROUP BY 1)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(x, k // 4 * 5 + 1, 5))::BIGINT) >> (15 - k % 4 * 5)) & 31)::INTEGER + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to, url
FROM p JOIN f USING (x)
"""

#: Links by brute force over all pairs, and reachability.
OP12_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS node, vec_id AS other FROM embeddings UNION SELECT r.node, l.y FROM reach r JOIN links l ON l.x = r.other),
components AS (SELECT node, min(other) AS component_id FROM reach GROUP BY 1),
counts AS (SELECT x, count(*) AS n FROM links GROUP BY 1)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, component_id = e.vec_id AS kept
FROM embeddings e LEFT JOIN counts ON x = e.vec_id JOIN components ON node = e.vec_id
"""

#: All phrases of all pieces, counted one by one.
OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM documents),
phrases AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM pieces, (VALUES (1), (2), (3), (4)) t(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS a FROM phrases GROUP BY ALL),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 30),
cuts AS (SELECT lang, phrase, a, w, j, array_to_string(w[:j], ' ') AS one, array_to_string(w[j + 1:], ' ') AS two FROM c, (VALUES (1), (2), (3)) t(j) WHERE j < k),
scores AS (SELECT cuts.lang, cuts.phrase, cuts.a, j, x.a AS l, y.a AS r, (2000000 * cuts.a::HUGEINT // (x.a + y.a))::BIGINT AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = one JOIN f y ON y.lang = cuts.lang AND y.phrase = two),
lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
kept AS (SELECT * FROM lowest s WHERE NOT EXISTS (SELECT 1 FROM c q WHERE q.lang = s.lang AND len(q.w) > len(string_split(s.phrase, ' ')) AND contains(' ' || q.phrase || ' ', ' ' || s.phrase || ' ') AND 100 * q.a::HUGEINT >= 80 * s.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1) USING (lang) WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    """The others need a tokenizer, a language model, byte formats or greedy matching: tests hold them against brute force."""
    return {"op6_minhash": OP6_SQL, "op8_warc": OP8_SQL, "op12_embedding_dedup": OP12_SQL, "op13_collocations": OP13_SQL}
