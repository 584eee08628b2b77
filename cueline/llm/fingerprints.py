"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

Each five-word shingle is hashed once. The top bits of a hash choose one of ``BINS`` bins, and a bin keeps its least hash.
An empty bin takes the value of a non-empty one in an order of its own drawn by hashing the two bins' numbers (optimal
densification): the order is the same for all documents, so the chance that two documents agree in a bin stays their Jaccard
similarity. Of each bin the low ``BITS`` bits are packed; likeness is the share of equal bins, corrected for bits
that agree by chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Staged, small_side

SHINGLE = 5
BIN_BITS, BITS = 7, 8
BINS = 1 << BIN_BITS
#: Text and rows that one task orders to find each document's neighbour.
BUCKET_BYTES, BUCKET_ROWS, BOUNDS = 4 << 20, 2000, 512

_HEX = "".join(f"{i:02x}" for i in range(1 << BITS))
_SPACE = "\\t\\n\\u000b\\f\\r "


def packed_fingerprint(text: str) -> Column:
    """Two hex digits a bin for a text column (name); empty for a text without words."""
    shift, low = 63 - BIN_BITS, (1 << BITS) - 1
    return F.expr(f"""
        transform(array(btrim(lower({text}), '{_SPACE}')), t -> IF(t = '', '',
        transform(array(split(t, '[ \\t-\\r]+')), words ->
        transform(array(array_sort(transform(sequence(1, greatest(1, size(words) - {SHINGLE - 1})),
                                             i -> shiftrightunsigned(xxhash64(slice(words, i, {SHINGLE})), 1)))), hashes ->
        transform(array(filter(hashes, (x, i) -> i = 0 OR shiftright(x, {shift}) <> shiftright(get(hashes, i - 1), {shift}))), least ->
            array_join(transform(
                concat(
                    flatten(transform(least, (x, i) -> concat(
                        array_repeat(CAST(NULL AS BIGINT), int(shiftright(x, {shift}) - IF(i = 0, -1L, shiftright(get(least, i - 1), {shift})) - 1)),
                        array(x)))),
                    array_repeat(CAST(NULL AS BIGINT), int({BINS - 1} - shiftright(element_at(least, -1), {shift})))),
                (x, bin) -> substring('{_HEX}', 1 + 2 * int({low} & coalesce(x,
                    array_min(transform(least, y -> (xxhash64(bin, shiftright(y, {shift})) & -{low + 1}L) | (y & {low}L))))), 2)), '')
        )[0])[0])[0]))[0]""")


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard similarity of two packed fingerprints (names), 0 to 1; 1 for two texts without words, 0 for one."""
    equal = f"aggregate(sequence(0, {BINS - 1}), 0, (n, i) -> n + int(substring({a}, 2 * i + 1, 2) = substring({b}, 2 * i + 1, 2)))"
    chance = 2.0**-BITS
    return F.expr(f"CASE WHEN {a} = {b} THEN 1D WHEN {a} = '' OR {b} = '' THEN 0D ELSE greatest(0D, ({equal} / {BINS}D - {chance}D) / {1 - chance}D) END")


def _buckets(rows: DataFrame) -> Column:
    """Number of a row's bucket: buckets follow the order of the key and hold about as many rows each; null keys come first."""
    total = rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("n")).first()
    wanted = max(1, -(-(total["bytes"] or 0) // BUCKET_BYTES), -(-total["n"] // BUCKET_ROWS))
    cuts = min(wanted, BOUNDS)
    at = [i / cuts for i in range(cuts)]
    bounds = sorted(set(rows.select(F.percentile_approx("key", at, 10_000)).first()[0] or []))
    if not bounds:
        return F.lit(0).cast("long")
    split = -(-wanted // cuts)
    lows = "array(" + ",".join(f"{b}L" for b in bounds) + ")"
    within = f"aggregate({lows}, 0, (n, b) -> n + int(b <= key))"
    bucket = f"{within} * {split}L"
    if split > 1 and len(bounds) > 1:  # even steps between two bounds
        low, high = f"get({lows}, greatest(0, {within} - 1))", f"get({lows}, least({len(bounds) - 1}, {within}))"
        bucket += f" + least({split - 1}L, greatest(0L, bigint({split} * (double(key) - {low}) / greatest(1L, {high} - {low}))))"
    return F.coalesce(F.expr(bucket), F.lit(-1).cast("long"))


def with_next(rows: DataFrame) -> DataFrame:
    """Columns next_text and next_print: those of the next row by descending key (null last, then text), the first after the last.

    Rows are ordered within buckets of the key. Each bucket also gets the top row of the bucket below (the lowest bucket that of
    the highest), so one exchange of the texts suffices.
    """
    rows = rows.withColumn("bucket", _buckets(rows))
    tops = rows.groupBy("bucket").agg(F.max("key").alias("top"))  # a row per bucket
    order = Window.orderBy("bucket")
    above = F.coalesce(F.lead("bucket").over(order), F.first("bucket").over(order))
    tops = Staged(tops.select(F.col("bucket").alias("own"), "top", above.alias("above")), "tops").df
    edge = rows.join(small_side(tops), (F.col("bucket") == F.col("own")) & F.col("key").eqNullSafe(F.col("top")))
    edge = edge.groupBy("above").agg(F.min("text").alias("text"))  # equal keys: the first by text
    edge = edge.select(F.col("above").alias("bucket"), F.lit(1).alias("edge"), F.lit(None).cast("long").alias("key"), "text")
    both = rows.select("bucket", F.lit(0).alias("edge"), "key", "text").union(edge).withColumn("print", packed_fingerprint("text"))
    w = Window.partitionBy("bucket").orderBy("edge", F.col("key").desc_nulls_last(), "text")
    both = both.withColumns({"next_text": F.lead("text").over(w), "next_print": F.lead("print").over(w)})
    return both.filter("edge = 0").drop("edge", "bucket")


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last half (rounded down, in code points) replaced by as much of the beginning of the next document's text. Null
    texts count as empty; an empty text has an empty fingerprint. Texts of one to four words are one shingle. Repeated rows and null keys (last in
    the order) keep a row each; a single document is its own next. The key must be an integer. Other columns are ignored.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    half = F.expr("int(length(text) div 2)")
    edited = F.concat(F.left("text", F.length("text") - half), F.left("next_text", half))
    rows = with_next(rows).withColumn("edited", edited).withColumn("edited_print", packed_fingerprint("edited"))
    return rows.select(
        F.col("key").alias(key), F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        F.col("print").alias("fingerprint"), F.col("edited_print").alias("edited_fingerprint"),
        likeness("print", "edited_print").alias("near_edited"), likeness("print", "next_print").alias("near_next"),
    )
