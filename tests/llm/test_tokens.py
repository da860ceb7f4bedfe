import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from conftest import SF_SMALL
from rivulet.llm import packing, rank_merge, transducer
from rivulet.llm.common import Memo

JSON, RANKS, WORDS = (P.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json"))


def strings(seed, n=1500):
    rng = random.Random(seed)
    fixed = ["", "a" * 5000, "   \n\n  x", "<|endoftext|>a<|endoftext|> b", "==" * 2000, "日本語🙂🙂", "\x1c \x1d a\x85b　c", "don't we'll I'M",
             "It's DON'T. x.' Abc, 'a.b c.. d| |", "Σας ΣΑΣ İstanbul ﬁ"]
    return fixed + ["".join(rng.choice("aab 'séÉ\n\t<|>日1½²\x1c\x85Σ́.,") for _ in range(rng.randint(1, 60))) for _ in range(n)]


def raw(path):
    with open(path, "rb") as f:
        return f.read()


def test_rank_merge_equals_library():
    lib, own = Tokenizer.from_file(JSON), rank_merge.Counter(raw(JSON), P.PATTERN)
    texts = strings(1)
    assert own.merger.together
    assert own.many(texts) == [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]
    long = " ".join(texts) * 40
    assert len(long) > 1_000_000
    assert own.many([long]) == [len(lib.encode(long, add_special_tokens=False).ids)]


def test_one_merge_at_a_time_gives_the_same_counts():
    own, slow = (rank_merge.RankMerger(raw(JSON)) for _ in range(2))
    slow.together = False
    words = [w for t in strings(2, 200) for w in t.split(" ") if w][:800] + ["aaaaaaa", "abababab"]
    assert own.counts(words) == slow.counts(words)


@pytest.fixture(scope="module")
def codec():
    ranks = transducer.read_ranks(raw(RANKS))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return transducer.Codec(raw(RANKS), P.PATTERN, transducer.last_merges(ranks)), enc


def test_transducer_equals_library_and_round_trips(codec):
    own, enc = codec
    for t in strings(3):
        packed = b"".join(own.encode(t))
        ids = np.frombuffer(packed, np.uint32)
        assert ids.tolist() == enc.encode_ordinary(t)
        cuts = sorted({0, len(packed), *(4 * random.Random(len(t)).randint(0, len(ids)) for _ in range(4))})
        assert own.decode([packed[a:b] for a, b in zip(cuts, cuts[1:])]) == t


def test_transducer_on_arbitrary_bytes_and_small_tables(codec):
    own, enc = codec
    small = transducer.Transducer(own.machine.ranks, transducer.last_merges(own.machine.ranks), max_arcs=300)
    rng = random.Random(4)
    for _ in range(3000):
        b = bytes(rng.choice(b"abcdethn \xc3\xa9\xe2=\xff") for _ in range(rng.randint(1, 25)))
        assert small.encode(b) == enc._encode_single_piece(b) == own.machine.encode(b)


def test_transducer_with_ranks_out_of_order():
    rng = random.Random(6)
    for trial in range(60):
        ranks = {bytes([c]): i for i, c in enumerate(b"abc")}
        tokens = {bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 4))) for _ in range(8)}
        order = list(range(3, 3 + len(tokens)))
        rng.shuffle(order)
        ranks |= dict(zip(sorted(tokens), order))
        enc = tiktoken.Encoding(f"t{trial}", pat_str=".+", mergeable_ranks=ranks, special_tokens={})
        own = transducer.Transducer(ranks, transducer.last_merges(ranks))
        for _ in range(60):
            b = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 9)))
            assert own.encode(b) == enc._encode_single_piece(b), (ranks, b)


def test_utf8_machine_equals_decoder():
    rng = random.Random(5)
    for _ in range(5000):
        b = bytes(rng.choice([0x41, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x99, 0xFF, 0xED, 0xA0, 0xC0]) for _ in range(rng.randint(1, 9)))
        held, out = b"", ""
        for i in range(len(b)):
            text, held = transducer.Utf8Stream.advance(held, b[i:i + 1])
            out += text
            assert len(held) <= 3
        assert out + held.decode("utf-8", "replace") == b.decode("utf-8", "replace")


def test_stream_gives_characters_as_they_complete(codec):
    own, _ = codec
    ranks = own.machine.ranks
    ids = np.array([ranks[bytes([b])] for b in "é🙂".encode()], np.uint32)
    stream = transducer.Utf8Stream(*own.table)
    assert [stream.feed(ids[i:i + 1]) for i in range(len(ids))] == ["", "é", "", "", "", "🙂"] and stream.close() == ""
    stream.feed(ids[2:4])
    assert stream.close() == "�"


def test_counts_and_digests_of_odd_rows(spark, odd, odd_rows, nothing):
    lib = Tokenizer.from_file(JSON)
    got = {tuple(r) for r in rank_merge.count_tokens(odd, JSON, P.PATTERN).collect()}
    texts = [(r[0], r[1] or "") for r in odd_rows]
    n = [len(lib.encode(t, add_special_tokens=False).ids) for _, t in texts]
    assert got == {(i, len(t.encode()), k, k > 512) for (i, t), k in zip(texts, n)}
    assert rank_merge.count_tokens(nothing, JSON, P.PATTERN).count() == 0

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw(RANKS).splitlines())}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expect = set()
    for i, t in texts:
        ids = enc.encode_ordinary(t)
        expect.add((i, len(ids), hashlib.sha256(np.array(ids, np.uint32).tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    out = transducer.round_trip_digests(odd, RANKS, P.PATTERN)
    assert {tuple(r) for r in out.collect()} == expect and out.count() == len(odd_rows)
    assert transducer.round_trip_digests(nothing, RANKS, P.PATTERN).count() == 0
    both = transducer.decode_documents(transducer.encode_documents(odd, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    assert sorted((r["doc_id"] or 0, r["decoded_text"]) for r in both) == sorted((i or 0, t) for i, t in texts)


def check_packed(rows, expected, capacity):
    """expected: (id, ids) of each document."""
    pieces = sorted((i or 0, k, at, zlib.crc32(np.array(ids[at:at + capacity], np.uint32).tobytes()), len(ids[at:at + capacity]))
                    for i, ids in expected for k, at in enumerate(range(0, len(ids), capacity)))
    assert sorted((r["doc_id"] or 0, r["piece"], r["start"], r["ids_crc32"], r["length"]) for r in rows) == pieces
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("capacity", [4096, 64])
def test_packing_of_odd_rows(spark, odd, odd_rows, nothing, capacity):
    lib = Tokenizer.from_file(WORDS)
    expected = [(r[0], lib.encode(r[1] or "", add_special_tokens=False).ids + [1]) for r in odd_rows]
    packed = packing.pack_documents(odd, WORDS, capacity)
    n = check_packed(packed.collect(), expected, capacity)
    assert n == len(best_fit([len(ids[at:at + capacity]) for _, ids in expected for at in range(0, len(ids), capacity)], capacity))
    whole = packing.sequences(packed).collect()
    assert len(whole) == n and all(len(r["ids"]) == 4 * r["length"] <= 4 * capacity for r in whole)
    assert packing.pack_documents(nothing, WORDS).count() == 0


def best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = min((b for b in range(len(bins)) if bins[b] >= n), key=lambda b: bins[b], default=None)
        if fit is None:
            bins.append(capacity)
            fit = -1
        bins[fit] -= n
    return bins


def test_plan_equals_one_by_one_best_fit():
    rng = random.Random(9)
    for _ in range(80):
        capacity = rng.choice([5, 16, 100])
        lengths = [min(capacity, int(rng.expovariate(4 / capacity)) + 1) for _ in range(rng.randint(0, 300))]
        counts = {n: lengths.count(n) for n in set(lengths)}
        left = {}
        plan = packing.best_fit_plan(counts, capacity)
        for k, (n, first, at, per_bin, offset) in enumerate(plan):
            last = plan[k + 1][1] if k + 1 < len(plan) and plan[k + 1][0] == n else counts[n]
            for j in range(last - first):
                b = at + j // per_bin
                assert left.get(b, capacity) == capacity - offset - j % per_bin * n
                left[b] = left.get(b, capacity) - n
                assert left[b] >= 0
        assert sorted(left.values()) == sorted(best_fit(lengths, capacity))


def test_packing_whole_table(spark):
    lib = Tokenizer.from_file(WORDS)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    expected = [(r["doc_id"], lib.encode(r["text"] or "", add_special_tokens=False).ids + [1]) for r in docs.collect()]
    check_packed(packing.pack_documents(docs.repartition(5), WORDS).collect(), expected, 4096)


def test_memo_keeps_within_its_bound():
    calls = []
    memo = Memo(lambda ks: [calls.append(k) or k * 2 for k in ks], 10)
    for at in range(0, 100, 5):
        got = memo.over(range(at, at + 5))
        assert all(got[k] == 2 * k for k in range(at, at + 5)) and len(memo.young) + len(memo.old) <= 40


def test_memo_does_not_keep_long_keys():
    memo = packing.ShortMemo(lambda ks: [len(k) for k in ks], 10)
    for n in range(300, 400):
        got = memo.over(["x" * n, "y"])
        assert got["x" * n] == n and got["y"] == 1 and len(memo.young) <= 2 and not memo.old


def test_words_of_a_stem_are_looked_up_once():
    """Capitals, a mark at the end and a return in a later batch cost no new
    look-up; the ids are the library's."""
    lib = Tokenizer.from_file(WORDS)
    encode = packing.WordIds(raw(WORDS), 1_000)
    asked = []
    encode.memo.compute, compute = lambda ks: (asked.extend(ks), compute(ks))[1], encode.memo.compute
    for texts in (["The the, THE. the", "Été été! 3, a.b x.'"], ["thE| ÉTÉ", "", "3, a.b"]):
        assert encode.many(pa.array(texts)) == [np.array(lib.encode(t, add_special_tokens=False).ids, np.uint32).tobytes() for t in texts]
    assert sorted(asked) == sorted({"the", "été", "3,", "a.b", "x.'"})
    texts = strings(31)
    assert encode.many(pa.array(texts).slice(7)) == [encode(t) for t in texts[7:]]
    batches = [pa.record_batch({"doc_id": [k], "text": [f"t{k}"]}) for k in range(7)]
    joined = [(d.to_pylist(), t.to_pylist()) for d, t in packing.groups(batches, rows=3)]
    assert joined == [([0, 1, 2], ["t0", "t1", "t2"]), ([3, 4, 5], ["t3", "t4", "t5"]), ([6], ["t6"])]
