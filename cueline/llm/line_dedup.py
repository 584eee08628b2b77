"""Line dedup by distinct-site spread.

Each line's hash gets a HyperLogLog sketch of the sites that show it; sketches merge by aggregation. Lines whose estimate lies near
the threshold get an exact distinct count, and lines on too many sites are removed as boilerplate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Staged, small_side

#: log2 of a sketch's registers; its standard error is 1.04 / sqrt(2^10), about 3 %. Estimates within four errors of the threshold are recounted.
REGISTERS, BAND = 10, 0.13
#: Scripts that are written without spaces: each letter counts as a word. Other words are parted by any white space.
UNSPACED = "".join(rf"\p{{Is{s}}}" for s in "Han Hiragana Katakana Thai Lao Khmer Myanmar".split())
WORDS = rf"[{UNSPACED}]|[^\s\p{{Z}}{UNSPACED}]+"


def line_hash(line: Column) -> Column:
    return F.xxhash64(line)


def judged(line: Column, min_words: int) -> Column:
    """Whether a trimmed line has ``min_words`` words, by single spaces or, where these part too few, by WORDS."""
    return (line != "") & ((F.size(F.split(line, " ")) >= min_words) | (F.regexp_count(line, F.lit(WORDS)) >= min_words))


def _lines(docs: DataFrame, min_words: int) -> DataFrame:
    lines = docs.select("key", "site", F.explode(F.split("text", "\n")).alias("line")).withColumn("line", F.btrim("line", F.lit(" \t\r")))
    return lines.filter(judged(F.col("line"), min_words)).select("key", "site", line_hash(F.col("line")).alias("line"))


def boilerplate(docs: DataFrame, *, min_sites: int, min_words: int) -> DataFrame:
    """Hashes of the lines shown by ``min_sites`` sites or more."""
    lines = _lines(docs, min_words).filter(F.col("site").isNotNull()).select("line", "site")
    sketches = lines.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(REGISTERS)).alias("sketch"))
    spread = sketches.select("line", F.hll_sketch_estimate("sketch").alias("sites")).filter(F.col("sites") >= (1 - BAND) * min_sites - 0.5)
    near = F.col("sites") <= (1 + BAND) * min_sites + 0.5
    far = spread.filter(~near).select("line")
    # a line's sites are made distinct first, so that a line of very many rows brings a row for each site to the join
    exact = lines.distinct().join(spread.filter(near).select("line"), "line").groupBy("line").agg(F.count("*").alias("sites"))
    return far.union(exact.filter(F.col("sites") >= min_sites).select("line"))


def remove_boilerplate(docs: DataFrame, *, key: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = 8, min_words: int = 3) -> DataFrame:
    """Per row: key, n_lines, n_removed, text without the lines (spaces, tabs and returns around them aside) that ``min_sites`` sites or more show.

    Lines of fewer than ``min_words`` words (see ``judged``) and blank lines always stay. A null site counts for no line. Null texts count as empty:
    one blank line. Every row gives a row; rows of equal or null keys are treated alike. Other columns are ignored.
    """
    docs = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(site).cast("string").alias("site"))
    bad = small_side(Staged(boilerplate(docs, min_sites=min_sites, min_words=min_words), "boilerplate").df)
    # the lines to remove from each key's texts: distinct boilerplate lines of a document
    hit = _lines(docs, min_words).join(bad, "line").groupBy(F.col("key").alias("hit_key")).agg(F.collect_set("line").alias("bad"))
    rows = docs.join(hit, F.col("key").eqNullSafe(F.col("hit_key")), "left")
    lines, keep = F.split("text", "\n"), lambda x: ~F.array_contains("bad", line_hash(F.btrim(x, F.lit(" \t\r"))))
    kept = F.when(F.col("bad").isNull(), lines).otherwise(F.filter(lines, keep))
    rows = rows.select("key", F.size(lines).alias("n"), kept.alias("kept"))
    return rows.select(F.col("key").alias(key), F.col("n").cast("long").alias("n_lines"), (F.col("n") - F.size("kept")).cast("long").alias("n_removed"), F.array_join("kept", "\n").alias("text"))


def oracle(min_sites: int = 8, min_words: int = 3) -> str:
    return f"""
        WITH lines AS (
            SELECT row, doc_id, source, pos, lines[pos] AS line, trim(lines[pos], ' ' || chr(9) || chr(13)) AS norm
            FROM (SELECT row, doc_id, source, lines, unnest(range(1, len(lines) + 1)) AS pos
                  FROM (SELECT row_number() OVER () AS row, doc_id, source, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
        long AS (SELECT * FROM lines WHERE norm <> '' AND len(string_split(norm, ' ')) >= {min_words}),
        bad AS (SELECT norm FROM long GROUP BY norm HAVING count(DISTINCT source) >= {min_sites}),
        marked AS (SELECT l.*, (l.norm <> '' AND len(string_split(l.norm, ' ')) >= {min_words} AND l.norm IN (SELECT norm FROM bad)) AS gone FROM lines l)
        SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_removed,
               coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text
        FROM marked GROUP BY row, doc_id"""
