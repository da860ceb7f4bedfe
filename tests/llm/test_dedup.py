from collections import defaultdict

import duckdb
import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from rivulet.llm import exact_dedup, jaccard_trie, line_dedup, queries
from rivulet.llm.jaccard_trie import components


def expected_groups(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[1] or ""].append(r[0])
    out = []
    for r in rows:
        ids = by[r[1] or ""]
        known = [i for i in ids if i is not None]
        out.append((r[0], max(known) if known else None, len(ids)))
    return sorted(out, key=str), len(by)


@pytest.mark.parametrize("digest", [exact_dedup.sha256_of, lambda t: F.unhex(F.substring(F.sha2(t, 256), 1, 2)), lambda t: F.lit(b"same")])
def test_exact_dedup_also_with_colliding_digests(spark, odd, odd_rows, tmpdir_path, digest):
    path = f"{tmpdir_path}/documents.parquet"
    odd.repartition(4).write.parquet(path)
    out = exact_dedup.exact_dedup(spark, path, digest=digest, max_files_per_trigger=1).collect()
    expect, groups = expected_groups(odd_rows)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in out), key=str) == expect
    assert sum(r["kept"] for r in out) == groups
    assert all(r["doc_id"] == r["keep_id"] for r in out if r["kept"])


def test_exact_dedup_salts_large_groups(spark, tmpdir_path, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SALT_ROWS", 8)
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", 0)
    path = f"{tmpdir_path}/documents.parquet"
    spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 200, "copy").otherwise(F.concat(F.lit("t"), F.col("id") % 150)).alias("text")).write.parquet(path)
    out = exact_dedup.exact_dedup(spark, path).collect()
    assert sum(r["kept"] for r in out) == 1 + 150 and {(r["keep_id"], r["group_size"]) for r in out if r["doc_id"] < 200} == {(199, 200)}


def test_ledger_takes_in_new_files_only(spark, odd, tmpdir_path):
    path, state = f"{tmpdir_path}/documents.parquet", f"{tmpdir_path}/state"
    odd.write.parquet(path)
    before = exact_dedup.update_ledger(spark, path, state).agg(F.sum("n")).first()[0]
    odd.write.mode("append").parquet(path)
    assert exact_dedup.update_ledger(spark, path, state).agg(F.sum("n")).first()[0] == 2 * before


def test_exact_dedup_of_nothing(spark, nothing, tmpdir_path):
    nothing.write.parquet(f"{tmpdir_path}/documents.parquet")
    assert exact_dedup.exact_dedup(spark, f"{tmpdir_path}/documents.parquet").count() == 0


def brute_lines(rows, min_sites, long_words=None, long_sites=2):
    """(id, lines, removed, text) per row."""
    last = (1 << 63) - 1
    sites, keeper = defaultdict(set), {}
    for r in rows:
        for x in (r[1] or "").split("\n"):
            if x.strip(" \t\r"):
                sites[x].add(r[3] or "")
                keeper[x] = min(keeper.get(x, last), last if r[0] is None else r[0])
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        own = last if r[0] is None else r[0]
        need = {x: long_sites if long_words is not None and len(x.replace("\t", " ").replace("\r", " ").split(" ")) - x.replace("\t", " ").replace("\r", " ").split(" ").count("") > long_words
                else min_sites for x in lines}
        left = [x for x in lines if not (x in sites and len(sites[x]) >= need[x] and keeper[x] != own)]
        out.append((r[0], len(lines), len(lines) - len(left), r[1] if len(left) == len(lines) else "\n".join(left)))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_sites", [2, 3])
def test_line_dedup_of_odd_rows(spark, odd_rows, odd, nothing, min_sites):
    from llm.conftest import KIND, row
    more = [row(20 + k, f"shared line\nown {k}\n\nshared line\n  \nother shared {k % 2}", f"s{k % 4}") for k in range(12)]
    rows = odd_rows + more + [row(None, "shared line", "z")]
    out = line_dedup.remove_boilerplate(spark.createDataFrame(rows, KIND), min_sites)
    assert out.columns == [f.name for f in KIND] + ["_lines", "_removed"]
    assert sorted(((r["doc_id"], r["_lines"], r["_removed"], r["text"]) for r in out.collect()), key=str) == brute_lines(rows, min_sites)
    assert line_dedup.remove_boilerplate(nothing).count() == 0


@pytest.mark.parametrize("sites", [39, 40, 41, 400])
def test_lines_near_the_threshold_are_counted_exactly(spark, sites):
    docs = spark.range(sites * 3).select(F.col("id").alias("doc_id"), F.lit("a line").alias("text"), (F.col("id") % sites).cast("string").alias("source"))
    found = line_dedup.boilerplate(docs, 40).collect()
    assert [r["keeper"] for r in found] == ([0] if sites >= 40 else [])


def test_long_passages_go_from_two_sites_on(spark):
    from llm.conftest import KIND, row
    say = {k: " ".join(f"p{k}w{j}" for j in range(k)) for k in (49, 50, 60)}
    # per n: 51 words, 50 words and a short line on n sites; 50 words on five sites
    rows = [row(10 * n + d, f"own {n} {d}\n{say[50]}\t{n}\n{say[49]} {n}\n\tshort {n}\n{say[50]}", f"s{d}") for n in (2, 3, 4, 5) for d in range(n)]
    # one hot source repeats two passages; one of them is on a second site too
    rows += [row(1000 + k, f"hot own {k}\nhot {say[60]}\nboth {say[60]}", "hot") for k in range(300)]
    rows += [row(5, f"other\nboth {say[60]}", "cold")]
    found = {r["doc_id"]: r for r in line_dedup.remove_boilerplate(spark.createDataFrame(rows, KIND), 6, long_words=50).collect()}
    for n in (2, 3, 4, 5):
        for d in range(n):
            left = found[10 * n + d]["text"].split("\n")
            assert (f"{say[50]}\t{n}" in left) == (d == 0) and found[10 * n + d]["_removed"] == (d > 0)
            assert {f"{say[49]} {n}", f"\tshort {n}", say[50]} <= set(left)
    assert all(found[1000 + k]["text"] == f"hot own {k}\nhot {say[60]}" for k in range(300))
    assert found[5]["_removed"] == 0


NAMES = ("_ID", "_key", "_lines", "_removed", "_drop", "_kept", "row", "at", "key", "lines", "removed", "split", "text_key")


def clashing(spark, rows):
    """The rows with a column of each name that an operator uses itself."""
    return spark.createDataFrame([(*r[:5], *(f"{n} {k}" for n in NAMES)) for k, r in enumerate(rows)],
                                 "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES))


def test_clashing_columns_come_back_unchanged(spark, odd_rows):
    import corpus_pipeline
    from llm.conftest import row
    rows = odd_rows + [row(30 + k, f"shared line\nown {k}\nshared line", f"s{k}") for k in range(8)]
    docs = clashing(spark, rows)
    out = line_dedup.remove_boilerplate(docs, 2)
    assert out.columns == [*docs.columns, "__lines", "__removed"]
    cleaned = brute_lines(rows, 2)
    assert sorted(((r["doc_id"], r["__lines"], r["__removed"], r["text"]) for r in out.collect()), key=str) == cleaned
    whole = {tuple(r) for r in docs.select("doc_id", *NAMES).collect()}
    assert {tuple(r) for r in out.select("doc_id", *NAMES).collect()} == whole
    kept = jaccard_trie.keep_one(docs, 3, 90)
    assert kept.columns == docs.columns and {tuple(r) for r in kept.collect()} <= {tuple(r) for r in docs.collect()}
    stage = corpus_pipeline.line_dedup_stage(spark, docs, None)
    assert stage.columns == docs.columns and {tuple(r) for r in stage.select("doc_id", *NAMES).collect()} <= whole


def test_many_lines_of_one_text(spark):
    from llm.conftest import KIND, row
    rows = [row(1, "\n".join(f"line {k}" for k in range(30_000)), "a"), row(2, "\n".join(f"line {k}" for k in range(0, 30_000, 2)), "b"),
            row(3, "\n".join([*(f"line {k}" for k in range(1, 30_000, 2)), "own", "own"]), "c")]
    got = line_dedup.remove_boilerplate(spark.createDataFrame(rows, KIND), 2).collect()
    assert sorted((r["doc_id"], r["_lines"], r["_removed"], r["text"]) for r in got) == brute_lines(rows, 2)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF_SMALL}/documents.parquet')")
    res = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in res.description]
    out = queries.QUERIES[name](spark, SF_SMALL)
    assert sorted(out.columns) == sorted(columns)
    assert sorted(tuple(r) for r in out.select(columns).collect()) == sorted(res.fetchall())


# --- n-gram Jaccard join ----------------------------------------------

def grams(text, n):
    w = (text or "").encode().lower()
    for c in (b"\t", b"\n", b"\x0b", b"\x0c", b"\r"):
        w = w.replace(c, b" ")
    w = [x for x in w.split(b" ") if x]
    return frozenset(tuple(w[k:k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute_components(rows, n, percent):
    sets = [grams(r[1], n) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    ids = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            ids[find(i)].append(r[0])
    return sorted(((r[0], len(sets[i]), min(ids[find(i)], default=None)) for i, r in enumerate(rows)), key=str), len({find(i) for i in range(len(rows))})


def check_components(spark, rows, n, percent):
    from llm.conftest import KIND
    got = jaccard_trie.ngram_components(spark.createDataFrame(rows, KIND).repartition(3), n, percent).collect()
    expect, _ = brute_components(rows, n, percent)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == expect


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80), (1, 50)])
def test_jaccard_of_odd_rows(spark, odd, odd_rows, nothing, n, percent):
    check_components(spark, odd_rows, n, percent)
    kept = jaccard_trie.keep_one(odd, n, percent)
    rows = kept.collect()
    assert kept.columns == odd.columns
    assert len(rows) == brute_components(odd_rows, n, percent)[1]
    assert jaccard_trie.ngram_components(nothing).count() == 0 and jaccard_trie.keep_one(nothing).count() == 0


@pytest.mark.parametrize("block", [512, 4])
def test_jaccard_of_chains_clusters_and_blocks(spark, monkeypatch, block):
    """Chains link far ends; a large cluster of near copies; shared passages."""
    import random
    from llm.conftest import row
    monkeypatch.setattr(jaccard_trie, "BLOCK", block)
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(15)]
    rows, i = [], 100
    for _ in range(6):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(30, 80))]
        for _ in range(10):  # a chain: each a small step from the last
            words = list(words)
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append(row(i, " ".join(words + passage)))
            i += 1
    base = [rng.choice(vocabulary) for _ in range(120)]
    for _ in range(25):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(120)] = rng.choice(vocabulary)
        rows.append(row(i, " ".join(words)))
        i += 1
    rng.shuffle(rows)
    for percent in (60, 80, 90):
        check_components(spark, rows, 3, percent)


def test_sketch_order_is_one_for_all_sets():
    import numpy as np
    sketch = np.random.default_rng(0).integers(0, 3, 1 << jaccard_trie.SKETCH_BITS)
    of = jaccard_trie.Shingler(2)
    a, b = (jaccard_trie.ordered(of(t), sketch).tolist() for t in ("a b c d e f g h", "c d e f g h i j k"))
    common = set(a) & set(b)
    assert [x for x in a if x in common] == [x for x in b if x in common]


def test_order_counts_every_text(spark):
    docs = spark.createDataFrame([(k, f"alpha beta word{k} gamma") for k in range(40)] + [(99, None)], "doc_id long, text string")
    of = jaccard_trie.Shingler(2)
    sketch = jaccard_trie.merge_sketch(jaccard_trie.count_sketch(docs.repartition(3), 2))
    assert int(sketch.sum()) == sum(len(of(f"alpha beta word{k} gamma")) for k in range(40))
    shared = int(of("alpha beta")[0] >> (64 - jaccard_trie.SKETCH_BITS))
    assert sketch[shared] >= 40


def test_components_of_long_paths(spark):
    n = 300
    edges = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).where("a % 100 <> 99")
    found = {r["u"]: r["root"] for r in components(edges).collect()}
    assert all(found.get(k, k) == k // 100 * 100 for k in range(n))
    assert components(edges.where("a < 0")).count() == 0
