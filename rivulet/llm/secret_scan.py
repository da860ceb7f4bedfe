"""Secret scans by assignment-aware lexing.

Source and configuration syntax is read as name-literal pairs wherever a text
holds it: ``name = "x"``, ``"name": "x"``, ``name: x``, ``name := x``,
``obj["name"] = x``, ``put("name", "x")``, ``a = b = "x"``, ``name: str = "x"``,
``<name>x</name>``, ``--name x``, ``export NAME x`` and ``scheme://user:x@host``.  Values may be
joined literals (``"x" + y``, ``"x" "y"``, ``a or "x"``, ``${Y}`` in a string)
and refer to names that were bound before.  Each bound value is a node over
the literals and values that it is made of; from the last to the first, every
node hands the sensitivity of its target name, weighed by how much its value
looks like a secret, to what it is made of.  A literal's score is the highest
that reaches it.  Literals from a threshold on are found as kind ``literal``.

Three fixed patterns (kinds ``assign``, ``access``, ``hex``) are found beside
them, leftmost and without overlap within a kind.

Defined cases: null text counts as empty, with no finding; a null id stays
null; repeated rows are scanned each; texts of any length are scanned whole,
in time that grows with their length; an empty table gives an empty result;
other columns are not read.  Places are code points, the end exclusive.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare, slices, worker_state

# ---- fixed patterns -------------------------------------------------------
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "literal")

# ---- names ----------------------------------------------------------------
#: Words of a target name and how sensitive they make it.
WORDS = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "passcode": 1.0, "pwd": 1.0, "pass": 0.8, "secret": 1.0, "secrets": 1.0,
         "token": 0.95, "apikey": 1.0, "credential": 1.0, "credentials": 1.0, "bearer": 0.9, "auth": 0.8, "authorization": 0.8,
         "privatekey": 1.0, "accesskey": 1.0, "secretkey": 1.0, "authtoken": 1.0, "accesstoken": 1.0, "signature": 0.7, "salt": 0.7, "pin": 0.6}
#: Words that make ``key`` sensitive, before it.
KEYS = {"api", "access", "private", "secret", "signing", "encryption", "client", "account", "storage", "master", "license", "shared"}
#: Last words that say the value is about a secret, not one.
ABOUT = {"count", "length", "len", "size", "name", "type", "path", "file", "url", "uri", "endpoint", "expiry", "expires", "ttl", "field",
         "label", "hint", "prompt", "policy", "regex", "pattern", "min", "max", "limit", "id", "index", "env", "var", "error", "message", "header"}
#: Every sensitive name holds one of these, in lower case.
STEMS = re.compile("pass|pwd|secret|token|key|credential|bearer|auth|signature|salt|pin|://", re.I | re.A)
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
ABOUT_WEIGHT = 0.2


def sensitivity(name: str) -> float:
    """0 to 1: how sensitive a value of this name is."""
    words = [w.lower() for w in PARTS.findall(name)]
    if not words:
        return 0.0
    best = max(WORDS.get(w, 0.0) for w in words)
    if any(a in KEYS and b in ("key", "keys") for a, b in zip(words, words[1:])):
        best = 1.0
    return best * ABOUT_WEIGHT if words[-1] in ABOUT else best


# ---- literals -------------------------------------------------------------
PLACEHOLDER = re.compile(r"(?:x+|\*+|\.+|-+|<.*>|\$?\{.*\}|%.*%|change[-_ ]?me.*|your[-_ ].*|my[-_ ].*|insert[-_ ].*|example.*|sample.*|placeholder|dummy.*"
                         r"|none|null|nil|true|false|undefined|todo|tbd|password|passwd|secret|token|string|redacted|hidden)", re.I)
LEAST = 6
ENOUGH = 0.5
QUOTED_PLAIN, BARE_PLAIN, SPACED = 1.0, 0.6, 0.3


class Look:
    """What a value looks like: length, kinds and set of its characters."""
    __slots__ = ("bare", "chars", "classes", "length", "spaced")

    def __init__(self, length=0, classes=0, chars=0, spaced=False, bare=False):
        self.length, self.classes, self.chars, self.spaced, self.bare = length, classes, chars, spaced, bare

    @classmethod
    def of(cls, text: str, bare: bool) -> Look:
        classes = chars = 0
        for c in set(text):
            classes |= 1 if c.islower() else 2 if c.isupper() else 4 if c.isdigit() else 8
            chars |= 1 << (ord(c) & 127)
        return cls(len(text), classes, chars, any(map(text.__contains__, " \t\n")), bare)

    def joined(self, other: Look) -> Look:
        return Look(min(self.length + other.length, 1 << 40), self.classes | other.classes, self.chars | other.chars,
                    self.spaced or other.spaced, self.bare and other.bare)

    def strength(self) -> float:
        if self.length < LEAST:
            return 0.0
        kinds, distinct = self.classes.bit_count(), self.chars.bit_count()
        out = min(1.0, 0.4 + 0.3 * min(1.0, self.length / 16) + 0.15 * (kinds - 1)) * min(1.0, 1.6 * distinct / min(self.length, 16))
        if self.spaced:
            out *= SPACED
        if self.bare and not self.classes & 4:  # a bare word without digits is rather a word or a name
            out *= BARE_PLAIN
        return out


# ---- syntax ---------------------------------------------------------------
NAME = r"[A-Za-z_$][\w$]*+(?:(?:\.|::|->|-)[A-Za-z_$][\w$]*+)*+"
SITE = re.compile(rf"""
    (?P<quote>["'`]) (?P<key>[A-Za-z_$][\w$.\-]*+) (?P=quote) [\x20\t]*+ \]? [\x20\t]*+ (?: :=|=>|={{1,3}}|:|, )
  | <(?P<tag>[A-Za-z_][\w.\-]*+) (?:\s[^<>]*+)? > (?P<inner>[^<>]*+) </
  | ://[^\s/:@'"]*+:(?P<url>[^\s/@'"]++)@
  | (?<![\w$.\-]) (?: --(?P<flag>{NAME}) [\x20\t]++ (?![-=:])
                    | (?:export|setenv|ENV) [\x20\t]++ (?P<env>[A-Za-z_]\w*+) [\x20\t]++ (?![=:])
                    | (?P<name>{NAME}) [\x20\t]*+ (?: :=|=>|={{1,3}}|:(?!//|:) ) )
""", re.X)
TYPED = re.compile(r"[\x20\t]*+[A-Za-z_][\w.]*+(?:\[(?:[^\[\]\n]|\[[^\[\]\n]*+\])*+\]|<(?:[^<>\n]|<[^<>\n]*+>)*+>)?+[\x20\t?!]*+=(?![=>])")
CHAIN = re.compile(rf"[\x20\t]*+({NAME})[\x20\t]*+=(?![=>])")
SCHEME = re.compile(r"(?:bearer|basic|token)[\x20\t]++(?=[^\s=:])", re.I)
BLANK = re.compile(r"(?:[\x20\t]|\\\n)*+")
STRING = re.compile(r'''(?:[bBrRuUfF]{1,2}+(?=["']))?+(?:"""(?P<a>(?:[^"\\]|\\.|"(?!""))*+)"""|\'\'\'(?P<b>(?:[^'\\]|\\.|'(?!\'\'))*+)\'\'\''''
                    r'''|"(?P<c>(?:[^"\\\n]|\\.)*+)"|'(?P<d>(?:[^'\\\n]|\\.)*+)'|`(?P<e>(?:[^`\\]|\\.)*+)`)''', re.S)
REFERENCE = re.compile(rf"\$\{{({NAME})\}}|\$({NAME})")
WORD = re.compile(NAME)
CALL = re.compile(r"[\x20\t]*+\(\s*+")
BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>|]++""")
JOIN = re.compile(r"\s*+(?:\+(?!=)|\.\.|&(?!&))\s*+")
ELSE = re.compile(r"\s*+(?:\|\||\?\?|or\b)\s*+")
INSIDE = re.compile(r"\$?\{([A-Za-z_]\w*+)\}")
#: Calls whose argument names a value that is elsewhere.
READERS = {"get", "getenv", "getproperty", "environ", "env", "lookup", "read", "fetch", "prompt", "input", "open", "load", "find", "getpass"}


class Scope:
    """Names and nodes of one text.  A node: its look and what it is made of;
    a leaf also has its place in the text."""

    def __init__(self, text: str):
        self.text = text
        self.names: dict[str, int] = {}
        self.looks: list[Look] = []
        self.parts: list[tuple] = []
        self.place: list[tuple | None] = []
        self.reached: list[float] = []
        self.by: list[str] = []
        self.leaves: dict[tuple, int] = {}

    def node(self, look: Look, parts=(), place=None) -> int:
        self.looks.append(look)
        self.parts.append(tuple(parts))
        self.place.append(place)
        self.reached.append(0.0)
        self.by.append("")
        return len(self.looks) - 1

    def leaf(self, start: int, end: int, bare: bool) -> int:
        known = self.leaves.get((start, end))
        if known is None:
            value = self.text[start:end]
            look = Look() if PLACEHOLDER.fullmatch(value) else Look.of(value, bare)
            inside = () if bare else [self.names[n] for n in INSIDE.findall(value) if n in self.names]
            if inside:  # a string with names in it is made of their values too
                own = self.node(look, (), (start, end))
                known = self.joined([own, *dict.fromkeys(inside)])
            else:
                known = self.node(look, (), (start, end))
            self.leaves[(start, end)] = known
        return known

    def joined(self, parts: list[int]) -> int:
        if len(parts) == 1:
            return parts[0]
        look = self.looks[parts[0]]
        for p in parts[1:]:
            look = look.joined(self.looks[p])
        return self.node(look, dict.fromkeys(parts))

    def bind(self, name: str, value: int) -> None:
        # a node of its own, so that a later meaning of the name is another's
        held = self.node(self.looks[value], (value,))
        self.names[name] = held
        score = sensitivity(name) * self.looks[value].strength()
        if score > self.reached[held]:
            self.reached[held], self.by[held] = score, name

    def literals(self) -> list[tuple]:
        """(start, end, name, score) of each literal from the threshold on."""
        for k in range(len(self.parts) - 1, -1, -1):  # what a node is made of came before it
            for p in self.parts[k]:
                if self.reached[k] > self.reached[p]:
                    self.reached[p], self.by[p] = self.reached[k], self.by[k]
        return [(*place, self.by[k], self.reached[k]) for k, place in enumerate(self.place)
                if place is not None and self.reached[k] >= ENOUGH and self.looks[k].length]


class Lexer:
    def __init__(self, text: str):
        self.text, self.scope = text, Scope(text)

    def operand(self, at: int) -> tuple[int | None, int, int]:
        """(node, end, where to read on) of the literal, name or call at ``at``."""
        text, scope = self.text, self.scope
        m = STRING.match(text, at)
        if m:
            return scope.leaf(*m.span(m.lastgroup), False), m.end(), at
        m = REFERENCE.match(text, at)
        if m:
            return scope.names.get(m.group(1) or m.group(2)), m.end(), m.end()
        m = WORD.match(text, at)
        if m:
            call = CALL.match(text, m.end())
            if call:  # one literal in a call that does not look it up
                last = PARTS.findall(m.group())[-1:] or [""]
                inner = STRING.match(text, call.end())
                if not inner:
                    return None, call.end(), call.end()
                reads = last[0].lower() in READERS or m.group().lower() in READERS
                node = None if reads else scope.leaf(*inner.span(inner.lastgroup), False)
                return node, inner.end() + text.startswith(")", inner.end()), call.end()
            if m.group() in scope.names:
                return scope.names[m.group()], m.end(), m.end()
        m = BARE.match(text, at)
        if not m:
            return None, at, at
        value = m.group().rstrip(".:=")
        return (scope.leaf(at, at + len(value), True) if value else None), m.end(), m.end()

    def value(self, at: int) -> tuple[list[int], int, list[str]]:
        """Nodes of the value at ``at`` (one per alternative), where to read
        on, and names that are bound on the way."""
        text, chained = self.text, []
        while m := CHAIN.match(text, at):
            chained.append(m.group(1))
            at = m.end()
        at = BLANK.match(text, at).end()
        if text.startswith("(", at):
            at = BLANK.match(text, at + 1).end()
        if (m := SITE.match(text, at)) and m.group("name"):  # another pair begins here
            return [], at, chained
        if m := SCHEME.match(text, at):
            at = m.end()
        found, parts, resume = [], [], None
        while True:
            node, end, read_on = self.operand(at)
            resume = read_on if resume is None else resume
            if node is not None:
                parts.append(node)
            if end == at:
                break
            m = JOIN.match(text, end)
            if not m:
                if STRING.match(text, BLANK.match(text, end).end()) and text[end - 1] in "\"'`":
                    at = BLANK.match(text, end).end()
                    continue
                if parts:
                    found.append(self.scope.joined(parts))
                parts = []
                m = ELSE.match(text, end)
                if not m:
                    break
            at = m.end()
        if parts:
            found.append(self.scope.joined(parts))
        return found, resume, chained

    def run(self) -> list[tuple]:
        text, scope, at = self.text, self.scope, 0
        while m := SITE.search(text, at):
            at = m.end()
            if m.group("tag"):
                inner = m.group("inner").strip()
                if inner:
                    start = m.start("inner") + m.group("inner").index(inner)
                    scope.bind(m.group("tag"), scope.leaf(start, start + len(inner), False))
                at = m.start("inner")
                continue
            if m.group("url"):
                scope.bind("url.password", scope.leaf(*m.span("url"), False))
                continue
            start = m.end()
            if text[start - 1] == ":" and (typed := TYPED.match(text, start)):
                start = typed.end()
            nodes, at, chained = self.value(start)
            at = max(at, m.end())
            for name in (*chained[::-1], m.group("key") or m.group("name") or m.group("flag") or m.group("env")):
                for node in nodes:
                    scope.bind(name, node)
        return scope.literals()


def scan_text(text: str) -> list[tuple]:
    """(kind, start, end, name, score), by start and then kind as listed."""
    found = [("assign", *m.span(), None, None) for m in ASSIGN.finditer(text) if len(m.group(1)) >= 6]
    found += [("access", *m.span(), None, None) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", *m.span(), None, None) for m in HEX.finditer(text)]
    if STEMS.search(text):
        found += [("literal", *f) for f in Lexer(text).run()]
    return sorted(found, key=lambda f: (f[1], KINDS.index(f[0]), f[2]))


FINDINGS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
                                     T.StructField("name", T.StringType()), T.StructField("score", T.DoubleType())]))


def scan(docs: DataFrame) -> DataFrame:
    """Per row: doc_id and findings (kind, start, end; target name and score
    of literals), in order."""
    prepare(docs)
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("findings", FINDINGS)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("score", pa.float64())]))

    def run(batches):
        keys = ("kind", "start", "end", "name", "score")
        find = worker_state("secret_scan", lambda: scan_text)
        for batch in slices(batches):
            found = [[dict(zip(keys, f)) for f in find(t)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], names=schema.names)

    return rows.mapInArrow(run, schema)


def redact(docs: DataFrame, mask: str = "*") -> DataFrame:
    """All columns of ``docs`` with every found span of ``text`` overwritten
    by as many ``mask`` characters; null text stays null."""
    prepare(docs)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").alias("text"))
    schema = T.StructType([rows.schema["row"], T.StructField("clean", T.StringType())])

    def clean(text):
        if text is None:
            return None
        out, at = [], 0
        for _, start, end, _, _ in scan_text(text):
            if end > at:
                out += [text[at:max(start, at)], mask * (end - max(start, at))]
                at = end
        return "".join([*out, text[at:]])

    def run(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([clean(t) for t in batch.column("text").to_pylist()], pa.string())],
                                             names=schema.names)

    made = rows.mapInArrow(run, schema)
    return made.select(*[(F.col("clean") if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns])
