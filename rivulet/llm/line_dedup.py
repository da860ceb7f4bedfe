"""Line deduplication by distinct-site spread.

Each line's hash gets a HyperLogLog sketch of the sites (sources) it occurs
on; sketches merge by aggregation, map side first.  Lines clearly below the
threshold stay; lines near it get an exact count of distinct sites; lines on
enough sites are boilerplate and are removed from every document but the one
with the smallest id, so that no passage is lost from the corpus.

Given ``long_words``, a line of more words than that is a passage, spread from
``long_sites`` distinct sites on; shorter lines keep the other threshold.
Repeats within one site count as that one site.

Defined cases: null text counts as empty and stays null; null ids are larger
than any other; null sites are one site; empty and white-space lines are
never removed; repeated rows with the same id and text are treated alike; an
empty table gives an empty result; other columns pass through unread, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: log2 of sketch registers: standard error 1.04 / sqrt(2 ** 9), 4.6 %.
LOG_K = 9
#: Estimates within this many standard errors of the threshold are recounted.
ERRORS = 5.0


def _id(doc_id):
    return F.coalesce(F.col(doc_id).cast("long"), F.lit((1 << 63) - 1))


def _hash(line):
    """128 bits of two independent hashes."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def _is_long(line, long_words: int):
    """More words than ``long_words``; they need a character each and one between."""
    return (F.length(line) > 2 * long_words) & (F.regexp_count(line, F.lit("[^ \t\r]+")) > long_words)


def line_table(docs: DataFrame, site_col: str = "source", long_words: int | None = None) -> DataFrame:
    """One row per line of text: key of its document, line hash, its place,
    site, id; given ``long_words``, also whether the line is longer."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = docs.select(_id("doc_id").alias("id"),
                        F.coalesce(F.col(site_col).cast("string"), F.lit("")).alias("site"),
                        F.xxhash64(text).alias("text_key"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    long = [] if long_words is None else [_is_long(F.col("line"), long_words).alias("long")]
    return lines.where(F.trim(F.translate("line", "\t\r", "  ")) != "").select("id", "site", "text_key", "pos", _hash(F.col("line")).alias("line"), *long)


def spread_lines(lines: DataFrame, min_sites: int = 6, long_words: int | None = None, long_sites: int = 2) -> DataFrame:
    """Of a line table: lines on at least ``min_sites`` distinct sites
    (``long_sites`` if they have more than ``long_words`` words): line hash,
    keeper id."""
    key = ["line"] if long_words is None else ["line", "long"]
    need = F.lit(min_sites) if long_words is None else F.when(F.col("long"), long_sites).otherwise(min_sites)
    # one row per line and site first: no hot line meets in one task;
    # sketches pass over empty strings, so sites get a letter in front
    by_site = lines.groupBy(*key, "site").agg(F.min("id").alias("first_id"))
    spread = by_site.groupBy(*key).agg(F.hll_sketch_agg(F.concat(F.lit("s"), "site"), F.lit(LOG_K)).alias("sketch"), F.min("first_id").alias("keeper"))
    error = ERRORS * 1.04 / (2 ** (LOG_K / 2))
    low, high = F.col("need") * (1 - error) - 0.5, F.col("need") * (1 + error) + 0.5
    sites = F.hll_sketch_estimate("sketch")
    likely = spread.select("line", "keeper", sites.alias("sites"), need.alias("need")).where(F.col("sites") >= low)
    near = likely.where(F.col("sites") <= high)
    exact = (by_site.join(near.select("line"), "line", "left_semi").groupBy("line")
             .agg(F.count("*").alias("exact_sites")))
    return (likely.join(exact, "line", "left").where(F.coalesce("exact_sites", "need") >= F.col("need"))
            .select("line", "keeper"))


def boilerplate(docs: DataFrame, min_sites: int = 6, site_col: str = "source", long_words: int | None = None, long_sites: int = 2) -> DataFrame:
    """``spread_lines`` of the texts of ``docs``."""
    return spread_lines(line_table(docs, site_col, long_words), min_sites, long_words, long_sites)


def clean_rows(docs: DataFrame, min_sites: int = 6, site_col: str = "source", long_words: int | None = None, long_sites: int = 2) -> DataFrame:
    """Per row: ``row``, a struct of all columns of ``docs`` with boilerplate
    lines taken out of its text, ``lines`` and ``removed``: lines before, and
    lines taken out.  Texts are split once, into a written line table."""
    lines = materialise(line_table(docs, site_col, long_words), "lines")
    found = spread_lines(lines, min_sites, long_words, long_sites)
    # a document's own lines, once each, so that a page repeating one line is one row
    own = lines.groupBy("id", "text_key", "line").agg(F.collect_set("pos").alias("at"))
    drop = (own.join(found, "line").where(F.col("id") != F.col("keeper"))
            .groupBy("id", "text_key").agg(F.sort_array(F.flatten(F.collect_set("at"))).alias("drop")))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                        _id("doc_id").alias("id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_key"))
    split, drop_at = F.split("row.text", "\n"), F.col("drop")

    def between(k):  # the lines after the k-th dropped one, up to the next
        start = F.when(k == 0, 0).otherwise(F.get(drop_at, k - 1) + 1)
        end = F.coalesce(F.get(drop_at, k), F.size("split"))
        return F.slice("split", start + 1, end - start)

    joined = keyed.join(drop, ["id", "text_key"], "left").withColumn("split", split)
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size("drop")), between))
    text = F.when(drop_at.isNotNull(), F.array_join(kept, "\n")).otherwise(F.col("row.text"))
    return joined.select(F.struct(*[(text if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns]).alias("row"),
                         F.coalesce(F.size(F.when(F.col("row.text").isNotNull(), F.col("split"))), F.lit(1)).alias("lines"),
                         F.coalesce(F.size(F.when(drop_at.isNotNull(), drop_at)), F.lit(0)).alias("removed"))


def free_name(name: str, columns: list[str]) -> str:
    """``name``, with as many underscores in front as keep it off ``columns``."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def remove_boilerplate(docs: DataFrame, min_sites: int = 6, site_col: str = "source", long_words: int | None = None,
                       long_sites: int = 2) -> DataFrame:
    """All columns of ``docs`` with boilerplate lines taken out of ``text``,
    plus ``_lines`` and ``_removed``: lines before, and lines taken out.  If
    ``docs`` has columns of these names, the new ones get more underscores."""
    out = clean_rows(docs, min_sites, site_col, long_words, long_sites)
    return out.select("row.*", F.col("lines").alias(free_name("_lines", docs.columns)), F.col("removed").alias(free_name("_removed", docs.columns)))
