"""Column -> Column helpers (all JVM-side, codegen friendly).

Each helper that an oracle needs has a ``*_sql`` twin producing the same
expression as DuckDB SQL text, so the Spark plan and the oracle are written
from one definition.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K

# Whitespace class written out (Java's and RE2's ``\s`` differ on \x0B).
WS = r"\t\n\x0B\f\r "
# Word characters in the Unicode sense (Java's ``\w`` is ASCII-only).
WORD = r"\p{L}\p{N}_"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_ws(col) -> Column:
    return F.regexp_replace(_c(col), f"^[{WS}]+|[{WS}]+$", "")


def norm_title(col) -> Column:
    """lower, trim, drop a leading the/a/an, punctuation -> space, collapse."""
    t = strip_ws(F.lower(_c(col)))
    t = F.regexp_replace(t, f"^(the|a|an)[{WS}]+", "")
    t = F.regexp_replace(t, f"[^{WORD}{WS}]", " ")
    t = F.regexp_replace(t, f"[{WS}]+", " ")
    return strip_ws(t)


def norm_title_sql(expr: str) -> str:
    t = f"regexp_replace(lower({expr}), '^[{WS}]+|[{WS}]+$', '', 'g')"
    t = f"regexp_replace({t}, '^(the|a|an)[{WS}]+', '')"
    t = f"regexp_replace({t}, '[^{WORD}{WS}]', ' ', 'g')"
    t = f"regexp_replace({t}, '[{WS}]+', ' ', 'g')"
    return f"regexp_replace({t}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def title_year(col) -> Column:
    """Four-digit year in parentheses, '' when absent."""
    return F.regexp_extract(_c(col), r"\(([0-9]{4})\)", 1)


def title_year_sql(expr: str) -> str:
    return f"regexp_extract({expr}, '\\(([0-9]{{4}})\\)', 1)"


def fix_trailing_article(col) -> Column:
    """'Dark Knight, The (2008)' -> 'The Dark Knight (2008)'."""
    moved = F.regexp_replace(
        _c(col), r"(?i)^(.*),[\t\n\x0B\f\r ]*(The|A|An)[\t\n\x0B\f\r ]*(\([0-9]{4}\))?[\t\n\x0B\f\r ]*$",
        "$2 $1 $3")
    return strip_ws(moved)


def artist_key(col) -> Column:
    """Normalised text after the last em dash ('track — artist')."""
    return norm_title(F.substring_index(_c(col), "—", -1))


def rating_to_interaction(col) -> Column:
    r = _c(col)
    return F.when(r >= 4.0, "like").when(r <= 2.0, "dislike").otherwise("view")


def rating_to_interaction_sql(expr: str) -> str:
    return f"CASE WHEN {expr} >= 4.0 THEN 'like' WHEN {expr} <= 2.0 THEN 'dislike' ELSE 'view' END"


def confidence_weight(itype, dwell) -> Column:
    t, d = _c(itype), F.coalesce(_c(dwell), F.lit(0))
    base = F.coalesce(F.create_map(*[x for k, v in K.CONFIDENCE_WEIGHTS.items()
                                     for x in (F.lit(k), F.lit(v))])[t], F.lit(1.0))
    w = F.when((t == "view") & (d > 60), F.lit(3.0)).otherwise(base)
    return F.greatest(w, F.lit(0.0))


def confidence_weight_sql(itype: str, dwell: str) -> str:
    cases = " ".join(f"WHEN {itype} = '{k}' THEN {v}" for k, v in K.CONFIDENCE_WEIGHTS.items())
    return (f"CAST(greatest(CASE WHEN {itype} = 'view' AND coalesce({dwell}, 0) > 60 THEN 3.0 "
            f"{cases} ELSE 1.0 END, 0.0) AS DOUBLE)")


def training_label(itype, dwell) -> Column:
    t, d = _c(itype), F.coalesce(_c(dwell), F.lit(0))
    return (F.when(t.isin(*K.STRONG_POSITIVE_TYPES), F.lit(1.0))
            .when(d > 60, F.lit(1.0)).otherwise(F.lit(0.7)))


def training_label_sql(itype: str, dwell: str) -> str:
    strong = ", ".join(f"'{x}'" for x in K.STRONG_POSITIVE_TYPES)
    return (f"CAST(CASE WHEN {itype} IN ({strong}) THEN 1.0 "
            f"WHEN coalesce({dwell}, 0) > 60 THEN 1.0 ELSE 0.7 END AS DOUBLE)")


def combined_rating(rich, avg, n, max_weight=0.65, min_samples=10,
                    samples_for_max=5000, rounded=True) -> Column:
    """Blend a rich-source rating with a dataset mean by sample count."""
    n_, w_max = _c(n), max_weight if isinstance(max_weight, Column) else F.lit(max_weight)
    w = F.least(w_max, F.lit(0.1) + n_ / F.lit(float(samples_for_max)))
    blended = F.least((F.lit(1.0) - w) * _c(rich) + w * _c(avg), F.lit(5.0))
    if rounded:
        blended = F.round(blended, 2)
    return F.when(n_ < min_samples, _c(rich)).otherwise(blended)


def literal_match(text, *fields, tags=None) -> Column:
    """Case-insensitive literal substring of ``text`` in any field or tag.

    ``text`` is trimmed; empty text matches all.
    """
    t = F.lower(strip_ws(_c(text)))
    hits = [F.coalesce(F.lower(_c(f)).contains(t), F.lit(False)) for f in fields]
    if tags is not None:
        hits.append(F.coalesce(F.exists(_c(tags), lambda x: F.lower(x).contains(t)), F.lit(False)))
    return (t == F.lit("")) | reduce(lambda a, b: a | b, hits)


def literal_match_sql(text: str, fields: list[str], tags: str | None = None) -> str:
    t = f"lower(regexp_replace({text}, '^[{WS}]+|[{WS}]+$', '', 'g'))"
    hits = [f"coalesce(contains(lower({f}), {t}), false)" for f in fields]
    if tags:
        hits.append(f"coalesce(len(list_filter({tags}, lambda x: contains(lower(x), {t}))) > 0, false)")
    return f"({t} = '' OR " + " OR ".join(hits) + ")"


def normal_cdf(col) -> Column:
    """Standard normal CDF by the five-term polynomial approximation."""
    x = _c(col)
    ax = F.abs(x)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(K.NORMAL_CDF_P) * ax)
    b = K.NORMAL_CDF_B
    poly = t * (F.lit(b[0]) + t * (F.lit(b[1]) + t * (F.lit(b[2]) + t * (F.lit(b[3]) + t * F.lit(b[4])))))
    cdf = F.lit(1.0) - F.lit(1.0) / F.sqrt(F.lit(2.0) * F.pi()) * F.exp(F.lit(-0.5) * ax * ax) * poly
    return F.when(x >= 0, cdf).otherwise(F.lit(1.0) - cdf)


def normal_cdf_sql(expr: str) -> str:
    b = K.NORMAL_CDF_B
    ax = f"abs({expr})"
    t = f"(1.0 / (1.0 + {K.NORMAL_CDF_P} * {ax}))"
    poly = f"{t} * ({b[0]} + {t} * ({b[1]} + {t} * ({b[2]} + {t} * ({b[3]} + {t} * {b[4]}))))"
    cdf = f"(1.0 - 1.0 / sqrt(2.0 * pi()) * exp(-0.5 * {ax} * {ax}) * {poly})"
    return f"(CASE WHEN {expr} >= 0 THEN {cdf} ELSE 1.0 - {cdf} END)"


def sha_mod(col, m: int) -> Column:
    """Integer value of SHA-256(text) modulo m, exactly.

    The 256-bit digest is read as eight 32-bit blocks and reduced by Horner's
    rule, so no big integers are needed.
    """
    h = F.sha2(_c(col).cast("string"), 256)
    step = (1 << 32) % m
    acc = F.lit(0).cast("long")
    for i in range(8):
        block = F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long")
        acc = (acc * F.lit(step) + block) % F.lit(m)
    return acc


def sha_mod_sql(expr: str, m: int) -> str:
    h = f"sha256(CAST({expr} AS VARCHAR))"
    step = (1 << 32) % m
    acc = "CAST(0 AS BIGINT)"
    for i in range(8):
        block = f"CAST(('0x' || substr({h}, {8 * i + 1}, 8)) AS BIGINT)"
        acc = f"(({acc}) * {step} + {block}) % {m}"
    return acc


def code_lookup(col, table: dict, default) -> Column:
    """Small fixed code table as a map literal (no join, no shuffle)."""
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.create_map(*pairs)[_c(col)], F.lit(default))


def pick(arr: list[str], index) -> Column:
    """``arr[index]`` for a fixed list literal, 0-based index column."""
    return F.element_at(F.array(*[F.lit(x) for x in arr]), _c(index).cast("int") + 1)


def pick_sql(arr: list[str], index_expr: str) -> str:
    lit = "[" + ", ".join(f"'{x}'" for x in arr) + "]"
    return f"({lit})[({index_expr}) + 1]"


def item_card(df, score=None):
    """The search / recommendation result projection."""
    cols = ["item_id", "title", "content_type", "category", "description",
            "thumbnail_url", "rating", "view_count", "tags"]
    out = df.select(*cols)
    if score is not None:
        out = out.withColumn("search_score", score)
    return out


def ts_str(col) -> Column:
    """Timestamp as fixed-format text (microseconds) for result tables."""
    return F.date_format(_c(col), "yyyy-MM-dd HH:mm:ss.SSSSSS")


def ts_str_sql(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S.%f')"
