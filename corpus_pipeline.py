"""From raw documents to token ids: toxicity, repeated passages, near copies, contamination, encoding.

Each stage takes ``(spark, docs, sf_dir)``, with docs in the columns of
``documents``, and returns those columns, the last one the encoded documents.

Cases, for every stage: an empty table gives an empty one. Columns beyond text
and id pass through untouched, whatever their names. Rows are judged by text and
id, repeated rows alike. What else holds is said at the stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.llm import decontaminate, line_dedup, near_copies, sentencepieces, toxicity
from stepweave.llm.common import table, vocabulary
from stepweave.session import cut_lineage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go. The labels are learned from the texts given.

    Cases: a null or empty text is scored like one without known features. With
    no labels, or none but of unknown documents, every score is below the cut and
    all stay; null labels and labels of null ids teach nothing.
    """
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out("doc_id"))
    model = toxicity.train(docs, labels, "text", "doc_id", "toxic")
    return toxicity.score(docs, model).where("predicted = 0").select("doc.*")


def later_copies(docs: DataFrame) -> DataFrame:
    """``copy``: a key of each row whose whole text is that of a row with a lesser id (null is the least)."""
    texts = docs.where("text <> ''").select("doc_id", F.sha2("text", 256).alias("digest"))
    rows = cut_lineage(texts.distinct())
    firsts = rows.groupBy("digest").agg(F.min(F.struct("doc_id"))["doc_id"].alias("doc_id"))
    # rows meet by id and text together, so a large group of copies is no hot key
    return rows.select(copy_key("doc_id", F.col("digest"))).subtract(firsts.select(copy_key("doc_id", F.col("digest"))))


def copy_key(doc_id: str, digest: Column) -> Column:
    return F.concat_ws(" ", F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), digest).alias("copy")


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut out of the texts; a document that holds nothing else goes.

    So does an exact copy of an earlier document, whatever lines the cuts would leave of it.

    Cases: null and empty texts stay as they are. A null id comes before all
    others. The same row twice (id and text) stays twice or goes twice.
    """
    cleaned = line_dedup.dedup_lines(docs).where("n_removed = 0 OR text <> ''")
    cleaned = cleaned.withColumn("copy", copy_key("doc.doc_id", F.sha2("doc.text", 256)))
    cleaned = cleaned.join(cut_lineage(later_copies(docs)), "copy", "left_anti")
    given = docs.columns
    columns = [F.col("doc")[c].alias(c) for c in given if c not in ("text", "n_chars")]
    columns.append(F.col("text"))
    if "n_chars" in given:
        same = F.col("n_removed") == 0
        columns.append(F.when(same, F.col("doc.n_chars")).otherwise(F.length("text")).cast("long").alias("n_chars"))
    return cleaned.select(*columns).select(*given)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of the least id.

    Cases: texts without words, null ones too, are no copies and all stay. Of the
    same row twice one stays. Null ids come after all others: of a group whose
    ids are all null one stays.
    """
    return near_copies.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too much of a benchmark go.

    Cases: texts without words, null ones too, hold nothing and stay. Items
    without words, null ones too, and an empty benchmark contaminate nothing.
    """
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.where(~decontaminate.contaminated()).select("doc.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` of each document, null ids and repeated rows included; a null text is empty."""
    coded = sentencepieces.encode_decode(docs, vocabulary("piece_bpe_32k.model"))
    return coded.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_passages),
    ("near copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("sentence pieces", encode),
]

# Nearest examples and sentence pieces have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
