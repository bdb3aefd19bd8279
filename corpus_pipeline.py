"""A training corpus from raw documents, in five stages.

Each stage is (name, function of (spark, docs, sf_dir)) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitlake.llm import bpe, mixing, near_copies, substring, toxicity
from hitlake.llm.common import Scratch, remainder, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
TOXIC_FROM = 0.7

#: Learned classifiers, statistics and seeded orders: no SQL has them all.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score TOXIC_FROM or more go. Labels are learned as by op6_toxicity."""
    held_out = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(True))
    labels = table(spark, sf_dir, "labels").where(~held_out).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
    return toxicity.filtered(docs, toxicity.fit(docs, labels), TOXIC_FROM)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of copies and near copies the document with the smallest id stays. Rows without an id stay."""
    return docs.join(near_copies.removed(docs), "doc_id", "left_anti").select(docs.columns)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words under a window of 50 that also starts in a document with a smaller id go from the text; the document stays.

    So a text may become empty; its row then goes through the stages behind without words and tokens.
    """
    _, changed = substring.changes(docs, Scratch(spark, "repeats"))
    name = "_whole"
    while name in docs.columns:
        name += "_"
    keyed = substring.with_sequence(docs, name)
    same = (keyed["doc_id"] == changed["doc_id"]) & (keyed[name] == changed["whole"])
    kept = changed["kept"]
    now = {"text": F.coalesce(kept, keyed["text"])}
    if "n_chars" in docs.columns:
        now["n_chars"] = F.when(kept.isNull(), keyed["n_chars"]).otherwise(F.length(kept)).cast(docs.schema["n_chars"].dataType)
    return keyed.join(changed, same, "left").select(*(now.get(c, keyed[c]).alias(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stand as often as the mix takes them; sources weigh 5, 2, 1, repeating.

    A null source is one source, the last; a null text has no words. Repeated rows are documents of
    their own. Which rows of a source stand once more goes by a hash of the id, then of the text.
    """
    keep = [c for c in docs.columns if c != "doc_id"]
    columns = {c: f"kept_{k}" for k, c in enumerate(keep)}
    named = docs.select("doc_id", F.col("text").alias("mixed_text"), F.col("source").alias("mixed_source"), *(F.col(c).alias(n) for c, n in columns.items()))
    mixed, _, _ = mixing.mix(named, F.array("mixed_source"), mixing.cycle(), keep=list(columns.values()), text="mixed_text")
    mixed = mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return mixed.select(*("doc_id" if c == "doc_id" else F.col(columns[c]).alias(c) for c in docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, bytes_sha256): packed token ids, and the hash of the bytes they decode to; a row for each row of docs.

    A null text is an empty one, without tokens. Rows without an id keep a null one.
    """
    tokens = bpe.round_trip(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return tokens.select("doc_id", "n_tokens", "ids", F.col("decoded_sha256").alias("bytes_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("substring dedup", drop_repeats),
    ("mixing sources", mix_sources),
    ("byte-level BPE", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), str(k))
    return docs
