"""A training corpus from raw documents, in five stages.

1. quality: documents that the quality classifier rejects go
2. toxicity: documents that the toxicity model rejects go
3. line_dedup: lines on many sites, and passages (lines of over 50 words) on
   two or more, stay in one document only; a document that loses all its lines
   goes, as each of them stays elsewhere
4. near_dedup: one document of each group of near copies stays (five-word
   shingles, Jaccard 0.8)
5. packing: the rest is packed into sequences of 4,096 tokens

Each stage is (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, written as Parquet and read again as the next one's
``docs``.  All but the last return the columns of ``documents``.

Defined cases: those of the operators.  Null and empty texts are scored like
others and are nobody's copies; rows with a null id are judged on their own
score; an empty table gives an empty result.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm import jaccard_trie, line_dedup, packing, quality_cnn, toxicity_gbt
from rivulet.llm.common import documents, materialise
from rivulet.session import configure

QUALITY_FROM = 0.7
TOXIC_FROM = 0.5
MIN_SITES = 6
#: A passage: a line of more words, spread from this many distinct sites on.
LONG_WORDS, LONG_SITES = 50, 2
SHINGLE, PERCENT = 5, 80
#: Stems that a packing worker remembers: fewer than alone, as the stages
#: before leave their share of an executor's memory taken.
REMEMBERED = 250_000
CAPACITY = 4096


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    model = quality_cnn.train(documents(spark, sf_dir), _labels(spark, sf_dir))
    return quality_cnn.keep(docs, model, QUALITY_FROM)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    model = toxicity_gbt.train(documents(spark, sf_dir), _labels(spark, sf_dir))
    return toxicity_gbt.keep(docs, model, TOXIC_FROM)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    cleaned = line_dedup.clean_rows(docs, MIN_SITES, long_words=LONG_WORDS, long_sites=LONG_SITES)
    emptied = (F.col("removed") > 0) & (F.trim(F.translate("row.text", "\n\t\r", "   ")) == "")
    own = {c: F.col("row")[c] for c in docs.columns}
    if "n_chars" in own:
        own["n_chars"] = F.when(F.col("removed") > 0, F.length("row.text")).otherwise(own["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return cleaned.where(~F.coalesce(emptied, F.lit(False))).select(*[v.alias(c) for c, v in own.items()])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    return jaccard_trie.keep_one(docs, SHINGLE, PERCENT)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    out = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), CAPACITY, remembered=REMEMBERED)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("quality", quality), ("toxicity", toxicity), ("line_dedup", line_dedup_stage),
          ("near_dedup", near_dedup), ("packing", pack)]

#: Scores of trained models and the tokenizer have no SQL form; tests compare
#: run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
