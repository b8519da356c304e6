"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns the rows for the next; ``run`` writes every stage's
result to the shared folder and reads it again. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import langid, minhash, packing, pii, tiling
from spanloom.llm.arrow import fresh_name
from spanloom.runtime import settled, table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the languages of the labelled ones; rejected texts go.

    Rejected are null and empty texts, texts without letters, and texts unlike all of the languages;
    without any label, all texts. Repeated rows and rows without an id stay; an empty table gives no rows.
    """
    model = langid.fit(docs.where(~langid.held_out()).select("text", "lang"))
    return langid.accepted(docs, model)


def _few(ids: DataFrame) -> DataFrame:
    """Ids that are sent to all tasks if they are few enough (counted first)."""
    return F.broadcast(ids) if ids.limit(minhash.BROADCAST_IDS + 1).count() <= minhash.BROADCAST_IDS else ids


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more.

    Of a group the smallest id stays; rows of one id and one text are one row. If an id stands with several
    texts, each row is a document of its own and a group's first row stays. Null and empty texts stay, once
    for each id, and so do all rows without an id; an empty table gives no rows.
    """
    h = F.xxhash64(F.coalesce("text", F.lit("")))
    ids = written(spark, docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(h).alias("low"), F.max(h).alias("high"), F.count("*").alias("n")).where("n > 1"), "repeated-ids")
    if ids.where("low <> high").limit(1).count():
        return _rows_near_dedup(spark, docs)
    rows = written(spark, minhash.near_duplicates(docs, shingle=5, percent=80).select("doc_id", "kept"), "near-duplicates")
    out = docs.join(_few(rows.where("NOT kept").select("doc_id").distinct()), "doc_id", "left_anti").select(*docs.columns)
    twice = ids.select("doc_id")
    if not twice.limit(1).count():
        return out
    # Rows of one id and one text are one document.
    once = out.join(_few(twice), "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return out.join(_few(twice), "doc_id", "left_anti").select(*docs.columns).unionByName(once)


def _rows_near_dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The same, by rows: ids don't tell the documents apart."""
    row, one, blank_text, first = (fresh_name(n, docs.columns) for n in ("row", "one", "blank", "first"))
    numbered = written(spark, docs.withColumn(row, F.monotonically_increasing_id()), "numbered-documents")
    named = numbered.where("doc_id IS NOT NULL")
    found = minhash.near_duplicates(named, shingle=5, percent=80, id_col=row)
    rows = written(spark, found.select(F.col("doc_id").alias(row), "kept", "n_shingles"), "near-duplicates")
    out = numbered.join(_few(rows.where("NOT kept").select(row)), row, "left_anti")
    # Empty texts are linked with nothing: those of one id are one.
    blank = out.where("doc_id IS NOT NULL").join(rows.where("n_shingles = 0").select(row), row, "left_semi").groupBy(F.col("doc_id").alias(one), F.col("text").alias(blank_text)).agg(F.min(row).alias(first))
    again = out.join(blank, (F.col("doc_id") == F.col(one)) & F.col("text").eqNullSafe(F.col(blank_text)) & (F.col(row) > F.col(first))).select(row)
    return out.join(_few(again), row, "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item. Null and empty texts stay, and so do repeated rows; so does all, if there are no items."""
    return tiling.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def sanitisation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced; ``n_chars`` follows the text.

    Null texts stay null; repeated rows stay; an empty table gives no rows. Other columns stay as they are.
    """
    out = pii.sanitise(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, packed. Null and empty texts are documents of one id; repeated rows are packed each; an empty table gives no rows."""
    return packing.pack_documents(docs)


def _settled(stage):
    """The stage's rows in no more partitions than the input needs."""
    return lambda spark, docs, sf_dir: settled(stage(spark, docs, sf_dir))


STAGES = [(name, _settled(stage)) for name, stage in (("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pii", sanitisation), ("packing", sequences))]

#: SQL can't express the language models, tokenizer or packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(spark, stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
