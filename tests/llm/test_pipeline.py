import corpus_pipeline
import public_tokenizers
from conftest import SF_SMALL
from llm.test_dedup import brute_components, brute_lines
from llm.test_tokens import check_packed
from tokenizers import Tokenizer

from rivulet.llm import quality_cnn, toxicity_gbt
from rivulet.llm.common import materialise


def test_stages_equal_a_brute_force_version(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in now.collect()]
        out = materialise(stage(spark, now, SF_SMALL), f"test-{name}")
        if name == "packing":
            lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            check_packed(out.collect(), [(r[0], lib.encode(r[1], add_special_tokens=False).ids + [1]) for r in before], 4096)
            break
        assert out.columns == docs.columns
        after = [tuple(r) for r in out.collect()]
        if name == "quality":
            good = dict(quality_cnn.score(now, quality_cnn.train(docs, labels), 0.7).select("doc_id", "predicted").collect())
            assert sorted(after) == sorted(r for r in before if good[r[0]] == 1)
        elif name == "toxicity":
            bad = dict(toxicity_gbt.score(now, toxicity_gbt.train(docs, labels), 0.5).select("doc_id", "predicted").collect())
            assert sorted(after) == sorted(r for r in before if bad[r[0]] == 0)
        elif name == "line_dedup":
            expect = [(i, t) for i, lines, gone, t in brute_lines(before, corpus_pipeline.MIN_SITES, 50, 2) if not gone or t.strip()]
            assert sorted((r[0], r[1]) for r in after) == sorted(expect)
            assert all(r[4] == len(r[1]) for r in after)
        elif name == "near_dedup":
            groups, n = brute_components(before, 5, 80)
            assert len(after) == n and {c for _, _, c in groups} == {r[0] for r in after}
            assert set(after) <= set(before)
        now = out
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "line_dedup", "near_dedup", "packing"]


def test_run_and_odd_rows(spark, odd, nothing, tmpdir_path):
    assert corpus_pipeline.run(spark, SF_SMALL).count() > 0
    labels = spark.createDataFrame([(1, 1, 0), (9, 0, 1), (None, None, None)], "doc_id long, quality int, toxic int")
    for k, docs in enumerate((odd, nothing)):
        folder = f"{tmpdir_path}/{k}"
        docs.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        now = docs
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, folder)
            assert name == "packing" or out.columns == docs.columns
            now = materialise(out, f"odd-{name}")
        assert now.count() == 0 or k == 0
