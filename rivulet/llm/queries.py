"""Registered queries of this package: thin contracts over the operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (exact_dedup, fill_middle, hash_index, jaccard_trie, line_dedup, ngram_lm, packing, quality_cnn, rank_merge, secret_scan,
               token_align, toxicity_gbt, transducer)
from .common import documents

#: Boilerplate: a line on at least this many distinct sources.
MIN_SITES = 6
#: Passage: a line of more words, spread from this many distinct sources on.
LONG_WORDS, LONG_SITES = 50, 2
CAPACITY = 4096


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cnn.classify(documents(spark, sf_dir), _labels(spark, sf_dir), 0.7)


def op3_toxicity_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_gbt.classify(documents(spark, sf_dir), _labels(spark, sf_dir), 0.5)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_dedup(spark, f"{sf_dir}/documents.parquet")
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_trie.ngram_components(documents(spark, sf_dir), 3, 90).select("doc_id", "n_shingles", "component_id")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.clean_rows(documents(spark, sf_dir), MIN_SITES)
    return out.select("row.doc_id", F.col("lines").cast("long").alias("n_lines"), F.col("removed").cast("long").alias("n_removed"),
                      F.sha2(F.coalesce(F.col("row.text"), F.lit("")), 256).alias("clean_sha256"))


def op5_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.clean_rows(documents(spark, sf_dir), MIN_SITES, long_words=LONG_WORDS, long_sites=LONG_SITES)
    return out.select("row.doc_id", F.col("lines").cast("long").alias("n_lines"), F.col("removed").cast("long").alias("n_removed"),
                      F.sha2(F.coalesce(F.col("row.text"), F.lit("")), 256).alias("clean_sha256"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), CAPACITY)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transducer.round_trip_digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                                         public_tokenizers.PATTERN)


def op8_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return hash_index.nearest(rows, rows.where(F.col("vec_id") % 20 == 0), 20)


def op9_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.train_and_score(documents(spark, sf_dir), 10, 0)[0]


def op10_rank_merge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_merge.count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op11_block_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle.restore(fill_middle.transform(documents(spark, sf_dir)))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                      F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.align_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"),
                                       public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN)[0]


def op13_assignment_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.col("findings")

    def spans(of):
        return F.array_join(F.transform(of, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")

    def number(kind):
        return F.size(F.filter(found, lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter(found, lambda f: f["kind"] != "literal")
    return secret_scan.scan(documents(spark, sf_dir)).select("doc_id", *map(number, ("assign", "access", "hex")), F.sha2(spans(base).cast("binary"), 256).alias("base_sha256"),
                                                             spans(found).alias("spans"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_quality_cnn, op2_exact_dedup, op3_toxicity_gbt, op4_ngram_jaccard, op5_line_dedup, op5_passage_dedup, op6_best_fit_packing, op7_bpe_transducer, op8_multi_index_hashing, op9_elias_fano_lm,
    op10_rank_merge_counts, op11_block_rotation, op12_token_alignment, op13_assignment_secrets, pipeline)}

ORACLES = {
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op5_line_dedup": f"""
        WITH split AS (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
        lines AS (SELECT doc_id, source, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM split),
        spread AS (SELECT line, min(doc_id) AS keeper FROM lines
                   WHERE trim(translate(line, chr(9) || chr(13), '  ')) <> ''
                   GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}),
        marked AS (SELECT l.*, s.keeper IS NOT NULL AND s.keeper <> l.doc_id AS gone FROM lines l LEFT JOIN spread s USING (line))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS clean_sha256
        FROM marked GROUP BY doc_id""",
    "op5_passage_dedup": f"""
        WITH split AS (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
        lines AS (SELECT doc_id, source, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM split),
        spread AS (SELECT line, min(doc_id) AS keeper FROM lines
                   WHERE trim(translate(line, chr(9) || chr(13), '  ')) <> ''
                   GROUP BY line HAVING count(DISTINCT source) >=
                       CASE WHEN len(list_filter(string_split(translate(line, chr(9) || chr(13), '  '), ' '), lambda w: w <> '')) > {LONG_WORDS}
                            THEN {LONG_SITES} ELSE {MIN_SITES} END),
        marked AS (SELECT l.*, s.keeper IS NOT NULL AND s.keeper <> l.doc_id AS gone FROM lines l LEFT JOIN spread s USING (line))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS clean_sha256
        FROM marked GROUP BY doc_id""",
    "op11_block_rotation": r"""
        WITH drawn AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id) AS h FROM documents),
        numbers AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
                           ('0x' || substr(h, 1, 8))::UBIGINT AS h1, ('0x' || substr(h, 9, 8))::UBIGINT AS h2,
                           ('0x' || substr(h, 17, 8))::UBIGINT AS h3, ('0x' || substr(h, 25, 8))::UBIGINT AS h4 FROM drawn),
        cuts AS (SELECT doc_id, t, units, len(units) AS n, (h1 % (len(units) + 1))::BIGINT AS c1, (h2 % (len(units) + 1))::BIGINT AS c2,
                        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                             WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM numbers),
        parts AS (SELECT doc_id, t, n, form, array_to_string(units[1:least(c1, c2)], '') AS a,
                         array_to_string(units[least(c1, c2) + 1:greatest(c1, c2)], '') AS b,
                         array_to_string(units[greatest(c1, c2) + 1:], '') AS c FROM cuts)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b
                      ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM parts""",
}
