import zlib

import numpy as np
import pytest
from conftest import SF_MID

from rivulet.llm import quality_cnn, queries, toxicity_gbt
from rivulet.llm.labelled import fit_sample


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(len(order))
    n = (y == 1).sum()
    return (rank[y == 1].sum() - n * (n - 1) / 2) / n / (len(y) - n)


@pytest.mark.parametrize("name, label, modulus, remainder, threshold, good",
                         [("op1_quality_cnn", "quality", 4, 2, 0.7, 0.97), ("op3_toxicity_gbt", "toxic", 5, 0, 0.5, 0.95)])
def test_held_out_accuracy(spark, name, label, modulus, remainder, threshold, good):
    out = queries.QUERIES[name](spark, SF_MID).toPandas()
    labels = spark.read.parquet(f"{SF_MID}/labels.parquet").toPandas()
    assert len(out) == spark.read.parquet(f"{SF_MID}/documents.parquet").count()
    assert out["score"].between(0, 1).all() and (out["predicted"] == (out["score"] >= threshold)).all()
    assert (out["held_out"] == [zlib.crc32(str(i).encode()) % modulus == remainder for i in out["doc_id"]]).all()
    known = out.merge(labels, on="doc_id")
    known = known[known["held_out"]]
    assert auc(known["score"].to_numpy(), known[label].to_numpy()) >= good
    assert (known["predicted"] == known[label]).mean() >= 0.93


def test_labels_are_no_input(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    labels = spark.read.parquet(f"{SF_MID}/labels.parquet").selectExpr("doc_id", "quality", "toxic")
    for label, modulus, remainder in (("quality", 4, 2), ("toxic", 5, 0)):
        rows, _ = fit_sample(docs, labels, label, modulus, remainder)
        assert not [r for r in rows.collect() if zlib.crc32(str(r["doc_id"]).encode()) % modulus == remainder]


def test_fit_sample_is_bounded_and_weighted(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    labels = spark.read.parquet(f"{SF_MID}/labels.parquet")
    rows, weights = fit_sample(docs, labels.unionByName(labels), "quality", 4, 2, per_class=20)
    got = rows.collect()
    assert len(got) == 40 and weights[1] > weights[0] >= 1


@pytest.mark.parametrize("module, model", [
    (quality_cnn, quality_cnn.Network()), (quality_cnn, quality_cnn.Constant(1.0)), (toxicity_gbt, 0.5),
    (toxicity_gbt, "fitted")])
def test_odd_rows(spark, odd, odd_rows, nothing, module, model):
    if model == "fitted":
        texts = ["you are a stupid idiot and scum"] * 20 + ["a fine day to walk in the park"] * 20
        model = toxicity_gbt.fit(texts, np.r_[np.ones(20), np.zeros(20)], np.ones(40))
    out = module.score(odd, model).collect()
    assert sorted((r["doc_id"] or 0) for r in out) == sorted((r[0] or 0) for r in odd_rows)
    assert all(0 <= r["score"] <= 1 for r in out)
    empty = {r["score"] for r in out if r["doc_id"] in (3, 4)}
    assert len(empty) == 1  # null equals empty
    kept = module.keep(odd, model, 0.5)
    assert kept.columns == odd.columns
    good = sum((r["score"] >= 0.5) == (module is quality_cnn) for r in out)
    assert kept.count() == good
    assert module.score(nothing, model).count() == 0 and module.keep(nothing, model).count() == 0


def test_labels_of_one_class_or_none(spark, odd):
    one = spark.createDataFrame([(i, 1, 1) for i in (1, 2, 5, 6, 8, 9)] + [(None, 0, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    assert quality_cnn.train(odd, one).scores([b""])[0] == 1.0 and toxicity_gbt.train(odd, one) == 1.0
    none = one.limit(0)
    assert quality_cnn.train(odd, none).scores([b""])[0] == 0.5 and toxicity_gbt.train(odd, none) == 0.5


def test_chunks_cover_the_text():
    for n in (0, 1, 63, 64, 511, 512, 513, 960, 961, 5000):
        data = bytes(1 + k % 250 for k in range(n))
        chunks = quality_cnn.chunks_of(data)
        joined = chunks[0].tobytes() + b"".join(c[quality_cnn.OVERLAP:].tobytes() for c in chunks[1:])
        assert joined.rstrip(b"\0") == data and len(joined) - n <= quality_cnn.CHUNK


def test_recurrence_marks_repeats():
    x = quality_cnn.chunks_of(b"abcdefghij" * 20)
    once = quality_cnn.chunks_of(bytes(np.random.default_rng(0).integers(1, 255, 400).tolist()))
    assert quality_cnn.recurrence(x)[0, 10:90, 0].mean() == 1 and quality_cnn.recurrence(once).sum() == 0


def test_gradients_equal_differences():
    rng = np.random.default_rng(1)
    net = quality_cnn.Network()
    net.params = {k: v.astype(np.float64) for k, v in net.params.items()}
    net.params["out"] = rng.normal(size=net.params["out"].shape)
    x = rng.integers(97, 110, (5, quality_cnn.CHUNK)).astype(np.uint8)
    starts, y, w = np.array([0, 2, 3]), np.array([1.0, 0, 1]), np.array([1.0, 2, 1])

    def loss():
        p = np.float64(1) / (1 + np.exp(-net.combine(net.pooled(x), starts)[0].astype(np.float64)))
        return -(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / w.sum()

    grads = net.gradients(x, starts, y, w)
    for name, g in grads.items():
        v = net.params[name]
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        h = 1e-3
        old = v[at]
        v[at] = old + h
        up = loss()
        v[at] = old - h
        down = loss()
        v[at] = old
        assert (up - down) / (2 * h) == pytest.approx(g[at], rel=0.05, abs=2e-4), name


def test_trees_learn_and_isotonic_rises():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    trees = toxicity_gbt.Trees(rounds=60).fit(x, y, np.ones(600))
    assert ((trees.margins(x) > 0) == y).mean() > 0.95
    xs, ps = toxicity_gbt.isotonic(trees.margins(x), y, np.ones(600))
    assert (np.diff(ps) >= 0).all() and (np.diff(xs) >= 0).all()


def test_word_features():
    of = toxicity_gbt.Features({"vequ": 4.0})
    at = {n: k for k, n in enumerate(toxicity_gbt.NAMES)}
    assert of("You idiot!")[at["near"]] > of("idiot is a word that someone else far away wrote you")[at["near"]] > 0
    assert of("1d10t")[at["hidden"]] == 1 and of("stuuupid")[at["hidden"]] == 1 and of("fine")[at["hidden"]] == 0
    assert of("vequment le")[at["strong"]] == 0.5 and of("")[0] == 0
    assert of("GO AWAY NOW")[at["capitals"]] == 1 and of("i d i o t")[at["spelled"]] > 0


def test_a_labelled_id_repeated_is_one_row(spark):
    docs = spark.range(5000).selectExpr("1L as doc_id", "concat('text ', id % 7) as text").union(spark.range(2, 40).selectExpr("id", "'other'"))
    labels = spark.range(1, 40).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    rows, weights = fit_sample(docs, labels, "quality", 4, 2, per_class=20)
    got = rows.collect()
    assert len(got) <= 40 and len({r["doc_id"] for r in got}) == len(got)
