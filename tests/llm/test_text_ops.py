"""Fill-in-the-middle, cross-tokenizer alignment and secret scans."""

import hashlib
import random
import re
from bisect import bisect_left
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from conftest import SF_MID, SF_SMALL
from rivulet.llm import fill_middle, queries, secret_scan, token_align

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- fill-in-the-middle -----------------------------------------------------
def plain_fim(doc_id, text):
    """The contract, on strings."""
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = sha(f"42:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(digest[8 * k:8 * k + 8], 16) for k in range(4))
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b, c = ("".join(part) for part in (units[:low], units[low:high], units[high:]))
    if h4 % 100 < 80:
        return doc_id, n, "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}"
    return doc_id, n, "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}"


def key(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_fim_of_odd_rows_and_whole_table(spark, odd, odd_rows, nothing):
    more = [(k, t, "en", "s", 1, "n", "l", "s", "i", "x") for k, t in enumerate(
        ["<P> held", "a<S", "M>b <", "x<M>", "é 日本 🙂 z", " a", "a ", "\x1cq\x85r", "< P> <", "a b c d e f g"] * 8, 100)]
    frame = odd.unionByName(spark.createDataFrame(more, odd.schema))
    made = fill_middle.transform(frame)
    assert key(made.collect()) == key(plain_fim(r[0], r[1]) for r in odd_rows + more)
    back = fill_middle.restore(made.join(frame.select("doc_id", "text").distinct(), "doc_id"))
    assert back.where("restored <> coalesce(text, '')").count() == 0 and back.count() > 80
    assert fill_middle.restore(fill_middle.transform(nothing)).count() == 0
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    want = [plain_fim(r["doc_id"], r["text"]) for r in docs.collect()]
    got = [tuple(r) for r in queries.op11_block_rotation(spark, SF_SMALL).collect()]
    assert key(got) == key((*w[:5], sha(w[5]), sha(r["text"] or "")) for w, r in zip(want, docs.collect()))
    assert {w[2] for w in want} == {"plain", "psm", "spm"}


def test_restore_keeps_other_columns(spark):
    rows = spark.createDataFrame([(1, "spm", "<S>c<P>a<M>b", "kept", "was"), (2, "plain", None, "kept", "was"), (None, None, "text", "kept", "was")],
                                 "doc_id long, form string, output string, row string, restored string")
    got = {r["doc_id"]: (r["row"], r["restored"]) for r in fill_middle.restore(rows).collect()}
    assert got == {1: ("kept", "abc"), 2: ("kept", None), None: ("kept", "text")}


def test_rotation_in_place_over_block_bounds(monkeypatch):
    rng = random.Random(3)
    for block in (1, 3, 1 << 16):
        monkeypatch.setattr(fill_middle, "BLOCK", block)
        for _ in range(150):
            text = bytes(rng.choice(b"ab \n<PSM>") for _ in range(rng.randint(0, 40)))
            if any(s in text for s in (b"<P>", b"<S>", b"<M>")):
                continue
            one, two = sorted(rng.randint(0, len(text)) for _ in range(2))
            a, b, c = text[:one], text[one:two], text[two:]
            psm, spm = (fill_middle.rotate(text, one, two, f) for f in ("psm", "spm"))
            assert psm == b"<P>" + a + b"<S>" + c + b"<M>" + b and spm == b"<S>" + c + b"<P>" + a + b"<M>" + b
            assert fill_middle.unrotate(psm, "psm") == fill_middle.unrotate(spm, "spm") == text


# ---- cross-tokenizer alignment ----------------------------------------------
@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def plain_tokens(both, text):
    """((id, end) of A, (id, end) of B), or nothing."""
    lib, model = both
    table = {c: b for b, c in enumerate(token_align.byte_alphabet())}
    whole = (" " + (text or "")).encode()
    sides = []
    for ids, to_bytes in ((lib.encode(whole.decode(), add_special_tokens=False).ids, lambda k: bytes(table[c] for c in lib.id_to_token(k))),
                          (model.encode(text or ""), lambda k: bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p := model.id_to_piece(k))
                           else p.replace("▁", " ").encode())):
        parts, side, end = [to_bytes(k) for k in ids], [], 0
        for k, part in zip(ids, parts):
            end += len(part)
            side.append((k, end))
        if not text or b"".join(parts) != whole:
            return [], []
        sides.append(side)
    return sides


def plain_alignment(both, rows):
    """The contract, one text at a time."""
    tokens = [plain_tokens(both, t) for _, t in rows]
    links = []
    for a, b in tokens:
        ends = {}
        for k, e in a:
            ends.setdefault(e, []).append(k)
        links.append([(x, y) for y, e in b for x in ends.get(e, [])])
    count = Counter(p for pairs in links for p in pairs)
    top = {}
    for (_, y), n in count.items():
        top[y] = max(top.get(y, 0), n)
    out = []
    for (doc_id, _), (a, b), pairs in zip(rows, tokens, links):
        shared = sorted({e for _, e in a} & {e for _, e in b})
        held = {e: ([], []) for e in shared}
        for at, side in enumerate((a, b)):
            for k, end in side:
                held[shared[bisect_left(shared, end)]][at].append(str(k))
        groups = ["|".join(map(",".join, held[e])) for e in shared]
        out.append((doc_id, len(a), len(b), len(groups), len(pairs), sum(count[p] == top[p[1]] for p in pairs),
                    sum(count[p] for p in pairs), sha(";".join(groups)) if a else ""))
    return out, count


def test_alignment_of_odd_rows(spark, odd, odd_rows, nothing, both):
    more = [(k, t, "en", "s", 1, "n", "l", "s", "i", "x") for k, t in enumerate(
        ["a ▁ b", "<|endoftext|> and <s>", "  two  spaces ", "don't", "▁", "tab\there", "same", "same", "same"], 100)]
    docs, pairs = token_align.align_documents(odd.unionByName(spark.createDataFrame(more, odd.schema)), A, B, P.PATTERN)
    want, count = plain_alignment(both, [(r[0], r[1]) for r in odd_rows + more])
    assert key(docs.collect()) == key(want)
    assert {(r["id_a"], r["id_b"]): r["n"] for r in pairs.collect()} == dict(count)
    assert token_align.align_documents(nothing, A, B, P.PATTERN)[0].count() == 0


def test_alignment_of_whole_table(spark, both):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    want, _ = plain_alignment(both, [tuple(r) for r in docs])
    assert key(queries.op12_token_alignment(spark, SF_SMALL).collect()) == key(want)


def test_possible_pairs_are_the_suffix_pairs():
    a, b = [b"x", b"ab", b"b", b"zab", b"a"], [b"ab", b"b", b"q", b"xx"]
    want = sorted((i << 32) | j for i, x in enumerate(a) for j, y in enumerate(b) if x.endswith(y) or y.endswith(x))
    assert token_align.possible_pairs(a, b).tolist() == want


# ---- secret scans -----------------------------------------------------------
def literals(text):
    return [text[a:b] for kind, a, b, _, _ in secret_scan.scan_text(text) if kind == "literal"]


@pytest.mark.parametrize("text, found", [
    ('password = "hunter2abc"', ["hunter2abc"]),
    ("x = 'hunter2abc'\ny = x\ndb.password = y", ["hunter2abc"]),
    ('x = "hunter2abc"\nx = "none"\npassword = x', []),
    ('a = "abc123"\nb = "def456"\napi_key = a + b', ["abc123", "def456"]),
    ('password = "abc" "def123"', ["abc", "def123"]),
    ("base = 'abcd1234'\nsecret = f'pre-{base}'", ["abcd1234", "pre-{base}"]),
    ('K=abcd1234\nexport API_TOKEN="${K}"', ["abcd1234"]),
    ('{"user": "bob", "password": "s3cr3tV4lue"}', ["s3cr3tV4lue"]),
    ("db:\n  password: s3cr3tV4lue\n  name: x", ["s3cr3tV4lue"]),
    ('cfg["api-key"] = "qwer9876"', ["qwer9876"]),
    ('put("client_secret", "kjh34kjh5")', ["kjh34kjh5"]),
    ('os.environ.get("DB_PASSWORD", "dflt12345")', ["dflt12345"]),
    ('pwd = getenv("X") or "fallb4ck9"', ["fallb4ck9"]),
    ('pwd = getenv("LONGNAME1")', []),
    ('token = SecretStr("aZ19sdfkj2")', ["aZ19sdfkj2"]),
    ('password: str = "hunter2abc"', ["hunter2abc"]),
    ('p = q = "qwe123rty"; auth_token = p', ["qwe123rty"]),
    ("<secret>Zx81kkq9</secret>", ["Zx81kkq9"]),
    ("mysql --password abc123XYZ -u x", ["abc123XYZ"]),
    ("ENV DB_PASSWORD abc123XYZ", ["abc123XYZ"]),
    ("postgres://bob:pa55word99@h/x", ["pa55word99"]),
    ("Authorization: Bearer abc123def456", ["abc123def456"]),
    ('é日🙂 don\'t: secret := "aZ19sdfkj2"', ["aZ19sdfkj2"]),
    ('token_count = "1234567a"', []), ("max_token: 1234567a", ["1234567a"]), ('passwordLength = "abcdefgh1"', []),
    ('password = "changeme"', []), ('password = "${DB_PASSWORD}"', []), ('password = "<your password>"', []),
    ("the secret: something good", []), ("no syntax here, a password and a token.", []), ("", []),
])
def test_literals_by_target_name(text, found):
    assert literals(text) == found


def test_doubling_constants_stay_linear():
    text = "\n".join(["a0 = 'abcd1234'", *(f"a{k + 1} = a{k} + a{k}" for k in range(3000)), "secret = a3000"])
    assert literals(text) == ["abcd1234"]


def plain_base(text):
    """The three patterns, stepped through by hand."""
    out = []
    patterns = {"assign": re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"""
                                     r"""|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
                "access": re.compile("AKIA[A-Z0-9]+"), "hex": re.compile("[0-9a-f]+")}
    for order, (kind, pattern) in enumerate(patterns.items()):
        at = 0
        while m := pattern.search(text, at):
            size = {"assign": lambda m: len(m.group(2)) >= 6, "access": lambda m: len(m.group()) >= 20, "hex": lambda m: len(m.group()) >= 24}[kind](m)
            if size:
                out.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
            at = m.end()
    return [s for _, _, s in sorted(out)]


def test_scan_of_odd_rows_and_whole_table(spark, odd, odd_rows, nothing):
    rng = random.Random(8)
    words = ["secret", "token", "toKen", "API_KEY", "apikey", "=", ":", " ", "'", '"', "abc", "AKIA", "A1B2C3D4E5F6G7H8", "0123456789abcdef", "é", "\n", "ſecret", "toKen"]
    more = [(k, "".join(rng.choice(words) for _ in range(rng.randint(1, 30))), "en", "s", 1, "n", "l", "s", "i", "x") for k in range(100, 500)]
    frame = odd.unionByName(spark.createDataFrame(more, odd.schema))
    got = [(r["doc_id"], [f"{f['kind']}:{f['start']}:{f['end']}" for f in r["findings"] if f["kind"] != "literal"]) for r in secret_scan.scan(frame).collect()]
    assert key(got) == key((r[0], plain_base(r[1] or "")) for r in odd_rows + more)
    assert secret_scan.scan(nothing).count() == 0
    rows = {r["doc_id"]: r for r in queries.op13_assignment_secrets(spark, SF_MID).collect()}
    for r in spark.read.parquet(f"{SF_MID}/documents.parquet").collect():
        base, own = plain_base(r["text"] or ""), rows[r["doc_id"]]
        spans = own["spans"].split(",") if own["spans"] else []
        assert own["base_sha256"] == sha(",".join(base)) and [s for s in spans if not s.startswith("literal")] == base
        assert (own["n_assign"], own["n_access"], own["n_hex"]) == tuple(sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex"))
        order = [(int(s.split(":")[1]), secret_scan.KINDS.index(s.split(":")[0])) for s in spans]
        assert order == sorted(order)
    assert sum(r["n_assign"] for r in rows.values()) and any("literal" in r["spans"] for r in rows.values())


def test_redact(spark, odd):
    rows = spark.createDataFrame([(1, 'password = "hunter2abc" é', "a", "b"), (2, None, "a", "b"), (3, "plain", "a", "b")],
                                 "doc_id long, text string, `row` string, clean string")
    got = {r["doc_id"]: (r["text"], r["row"], r["clean"]) for r in secret_scan.redact(rows).collect()}
    assert got == {1: ("*" * 22 + '" é', "a", "b"), 2: (None, "a", "b"), 3: ("plain", "a", "b")}
    assert secret_scan.redact(odd).columns == odd.columns and secret_scan.redact(odd).count() == odd.count()
