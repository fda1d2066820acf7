"""A training corpus from documents: five stages, each on all that the one before it kept.

    language    rejects documents that are in no language that was learned
    toxicity    rejects documents whose score passes the threshold of their language
    near_dedup  keeps one document of each group of near duplicates
    mixing      repeats documents by Poisson numbers so that sources have their target shares
    encoding    token ids of every whole text, decoded again for a digest

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written and
read again as the next one's docs. All but the last return the columns of documents, as they came. SQL can't express
the models and signatures, so ORACLE_SQL is None and the tests hold the stages against brute force.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe_codec, language_id, minhash_dedup, mixing, toxicity
from lodestone.llm.common import cut, fold, shared_dir, table

ORACLE_SQL = None


#: Of what a text's length lets expect of its nearness to its language, so much is asked. Of 8748 held-out documents of
#: sf0.01, sf0.1 and check_s none is under 0.76; other languages of some hundred bytes are mostly under 0.75.
LEAST_FIT = 0.75
#: Languages that stay; None: all that were learned.
LANGUAGES: tuple[str, ...] | None = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose predicted language is one of LANGUAGES and which are near enough to it.

    Null, empty and letterless texts go, as does every row where nothing was learned (no language given at all). A
    document without a language gets the predicted one, the others keep theirs. Equal texts stay or go together;
    repeated rows stay each; an empty table gives an empty table; further columns pass through.
    """
    model = language_id.fit(docs, learn=fold("doc_id", 4) != 2)
    found = language_id.identify(docs, model, out="__lode_pred", score="__lode_score", fit="__lode_fit")
    kept = found.filter((F.col("__lode_pred") != language_id.UNKNOWN) & (F.col("__lode_fit") >= LEAST_FIT))
    if LANGUAGES is not None:
        kept = kept.filter(F.col("__lode_pred").isin(*LANGUAGES))
    return kept.withColumn("lang", F.coalesce("lang", "__lode_pred")).select(*docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the classifier doesn't call toxic, by the threshold of their language.

    Null and empty texts have the score of a text without words and stay where that is under the threshold; without
    labels of both kinds nothing is toxic (or, if all that was learned is, everything). Equal texts have equal scores;
    repeated rows stay or go together; an empty table gives an empty table; further columns pass through.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), learn=fold("doc_id", 5) != 0)
    found = toxicity.score_toxicity(docs, model, out="__lode_score", flag="__lode_toxic")
    return found.filter(~F.col("__lode_toxic")).select(*docs.columns)


#: So many rejected keys at most are sent to every executor (16 bytes each); more are joined by a shuffle.
MOST_BROADCAST = 3_000_000


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of each class, once if its row repeats; null keys and texts stay."""
    found = cut(minhash_dedup.near_duplicates(docs).filter("doc_id IS NOT NULL AND text_hash IS NOT NULL"))
    gone = found.filter("NOT kept").select(F.col("doc_id").alias("__lode_id"), F.col("text_hash").alias("__lode_gone")).distinct()
    gone = F.broadcast(gone) if gone.count() <= MOST_BROADCAST else gone
    marked = docs.withColumn("__lode_hash", minhash_dedup.text_hash(F.col("text")))
    kept = marked.join(gone, (marked.doc_id == F.col("__lode_id")) & (marked["__lode_hash"] == F.col("__lode_gone")), "left_anti")
    if found.filter("kept").groupBy("doc_id", "text_hash").count().filter("count > 1").limit(1).count():
        lone = kept.filter("doc_id IS NULL OR __lode_hash IS NULL")
        kept = kept.filter("doc_id IS NOT NULL AND __lode_hash IS NOT NULL").dropDuplicates(["doc_id", "__lode_hash"]).unionByName(lone)
    return kept.select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents to the target weights of their sources, and shuffles.

    Null sources belong to the group of all that the weights don't name; null keys count as empty text, rows of equal
    keys are repeated alike; texts aren't looked at; an empty table gives an empty table; further columns pass through.
    """
    return mixing.mix_sources(docs, mixing.WEIGHTS).select(*docs.columns)


#: Chunks and words that a worker of the encoding stage remembers: executors have run all other stages before it, and
#: their JVMs are as large as they get. op8, which runs alone, remembers six times as many and takes less time.
REMEMBERED = 50_000


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, the ids of each document of the mixture, and the SHA-256 of what they decode to.

    Null and empty texts have no ids; every row is kept, repeated ones too; an empty table gives an empty table;
    further columns are left out.
    """
    coded = bpe_codec.encode(docs.select("doc_id", "source", "text"), public_tokenizers.path("word_bpe_49k.json"), decoded_digest=True, remembered=REMEMBERED)
    return coded.select("doc_id", "source", "n_tokens", "ids", "decoded_sha256")


STAGES = [("language", language), ("toxicity", toxic), ("near_dedup", near_dedup), ("mixing", mix), ("encoding", encoding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}/{k}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
