"""A training corpus from ``documents``: five stages, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.llm.common import crc_mod, cut, table
from chronoframe.llm.decontaminate import without_leaks
from chronoframe.llm.language_id import learn_prototypes, predict_language
from chronoframe.llm.mixing import emit, mix
from chronoframe.llm.ngram_join import similar_documents
from chronoframe.llm.toxicity import REJECT, learn_toxicity, tag_toxicity

#: Dropped ids up to this number are sent to every task; beyond it the documents are shuffled.
FEW_IDS = 2_000_000


def judged(docs: DataFrame, names: list[str], judge) -> DataFrame:
    """``judge(docs)``, the rows that it keeps, with all columns as they were, also those that are called like its own ``names``."""
    own = {c: f"_own_{c}" for c in docs.columns if c in names}
    return judge(docs.withColumnsRenamed(own)).drop(*names).withColumnsRenamed({v: k for k, v in own.items()}).select(*docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is at least REJECT go; a null or empty text has no toxic word and stays. Repeated rows are judged alike."""
    model = learn_toxicity(docs, table(spark, sf_dir, "labels").where(crc_mod("doc_id", 3) != 1))
    return judged(docs, ["score", "spans"], lambda rows: tag_toxicity(rows, model, key=None).where(F.col("score") < REJECT))


def least_likeness(letters):
    """The cosine that a text of so many letters has with its language at least: more with length, none up to 40.

    A text shares few n-grams with a profile of a whole language while it is short, so a fixed bound would reject short
    clean texts. In long prose a text of another language stays under this.
    """
    return F.lit(0.18) * F.greatest(F.lit(0.0), 1 - F.sqrt(40.0 / F.greatest(letters, F.lit(1))))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str, wanted: tuple[str, ...] | None = None) -> DataFrame:
    """Documents stay whose predicted language is one of ``wanted`` (default: all that are learned), if they are like it.

    So those without letters go (``und``), those whose best language is not wanted, and those that are too little like it
    for their length. Null and empty texts have no letter. Without a stated language nothing is learned, and all rows
    stay; an empty table gives no rows. Repeated rows are judged alike; columns stay as they are.
    """
    prototypes = learn_prototypes(docs)
    if not prototypes:
        return docs
    keep = [x for x in prototypes if wanted is None or x in wanted]
    letters = F.length(F.regexp_replace("text", r"\P{L}+", ""))
    liked = F.col("lang_pred").isin(keep) & (F.col("score") >= least_likeness(letters))
    return judged(docs, ["lang_pred", "score"], lambda rows: predict_language(rows, prototypes, key=None).where(liked))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group that similarity ties together: that of the least id, then the least text hash.

    A document is known by its id and its text's hash, so of an id with several texts each is judged by itself; null ids
    come first. Rows with the same id and text are one document, of which one row stays. Documents without words stay.
    """
    text_hash = F.xxhash64("text")
    key = F.struct("doc_id", text_hash.alias("hash"))
    found = similar_documents(docs.select(key.alias("key"), "text"), key="key")
    out = cut(found.groupBy("key").agg(F.count("*").alias("rows"), F.max(F.col("component") != F.col("key")).alias("loses")).where("loses or rows > 1"))
    out = out.select(F.col("key.doc_id").alias("_id"), F.col("key.hash").alias("_hash"), "loses")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (text_hash == F.col("_hash"))
    known = F.broadcast(out) if out.count() <= FEW_IDS else out
    again = out.where("not loses")
    kept = docs.join(known, same, "left_anti")
    if again.take(1):  # repeated rows
        kept = kept.unionByName(docs.join(F.broadcast(again) if again.count() <= FEW_IDS else again, same).dropDuplicates(["_id", "_hash"]).select(*docs.columns))
    return kept


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go; a null or empty text stays, and without items all do. Repeated rows are judged alike."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, columns as ``emit`` says; a null source is one of its own, an empty text adds nothing."""
    return emit(mix(docs))


STAGES = [("toxicity", toxicity), ("language", language), ("near_copies", near_copies), ("decontamination", decontamination), ("mixing", mixing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else cut(docs), sf_dir)
    return docs
