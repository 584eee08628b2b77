"""Benchmark decontamination by winnowing, in DataFrame functions only.

A text's k-gram hashes are winnowed: each window of consecutive k-grams keeps its least hash (the leftmost of equals). A
window of ``span`` words holds ``span - k + 1`` k-grams, so two equal spans keep the same k-gram at the same place, and
every shared span of ``span`` words or more shares a fingerprint. Fingerprints of documents are joined to
those of benchmark windows, and each hit is extended to the whole window, word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Staged, ascii_lower

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a k-gram; shorter spans are taken whole.
GRAM = 5
#: A fingerprint is one long: the hash above, the word position (at most 2^30, as a string holds 2^31 bytes) below.
POSITION_BITS = 30
#: Bits of the table that a document's fingerprints are tested with before they leave their row. A full table only lets more through to the join.
TABLE_BITS = 1 << 18
#: Windows of the benchmark up to which they are broadcast (some 200 bytes each); beyond, both sides are shuffled.
BROADCAST_WINDOWS = 100_000


def word_array(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _grams(words: str, span: int) -> str:
    k = min(GRAM, span)
    keep = -1 << POSITION_BITS
    return f"transform(sequence(1, size({words}) - {k - 1}), i -> (xxhash64(slice({words}, i, {k})) & {keep}L) | i)"


def winnow(words: str, span: int) -> Column:
    """The fingerprints of a word column (name) for shared spans of ``span`` words; none if it has fewer."""
    w = span - min(GRAM, span) + 1
    least = f"array_distinct(transform(sequence(1, size({words}) - {span - 1}), j -> array_min(slice(g, j, {w}))))"
    picked = f"transform(array({_grams(words, span)}), g -> {least})[0]" if w > 1 else f"array_distinct({_grams(words, span)})"
    return F.expr(f"IF(size({words}) >= {span}, {picked}, CAST(array() AS ARRAY<BIGINT>))")


def benchmark_windows(bench: DataFrame, *, key: str, text: str, span: int) -> tuple[DataFrame, DataFrame]:
    """(windows: win, span, words, hash, place) and (win, item): the distinct windows of all items."""
    items = bench.select(F.col(key).cast("string").alias("item"), word_array(F.col(text)).alias("words")).filter(F.size("words") > 0)
    size = F.least(F.size("words"), F.lit(span))
    items = items.withColumn("span", size).withColumn("at", F.explode(F.sequence(F.lit(1), F.size("words") - size + 1)))
    items = items.select("item", "span", F.expr("slice(words, at, span)").alias("words"))
    windows = items.select("span", "words").distinct()
    by_span = [F.when(F.col("span") == n, winnow("words", n)[0]) for n in range(1, span + 1)]
    windows = windows.withColumn("print", F.coalesce(*by_span)).withColumn("win", F.monotonically_increasing_id())
    place = F.col("print").bitwiseAND(F.lit((1 << POSITION_BITS) - 1)).cast("int")
    windows = Staged(windows.select("win", "span", "words", F.shiftright("print", POSITION_BITS).alias("hash"), place.alias("place")), "windows").df
    return windows, Staged(items.join(windows, ["span", "words"]).select("win", "item").distinct(), "window-items").df


def _table(windows: DataFrame) -> str:
    """A bit table of the windows' hashes, as SQL text of at most TABLE_BITS / 64 longs."""
    slot = F.col("hash").bitwiseAND(F.lit(TABLE_BITS - 1))
    rows = windows.select(slot.alias("slot")).distinct().select(F.expr("int(slot div 64)").alias("at"), F.expr("shiftleft(1L, int(slot % 64))").alias("bit"))
    longs = [0] * (TABLE_BITS // 64)
    for r in rows.groupBy("at").agg(F.bit_or("bit").alias("bits")).collect():
        longs[r["at"]] = r["bits"]
    return "array(" + ",".join(f"{v}L" if v > -(1 << 63) else "shiftleft(1L, 63)" for v in longs) + ")"


def decontaminate(
    docs: DataFrame, bench: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", span: int = 10
) -> DataFrame:
    """Per row of ``docs``: key, n_words, n_hit, spans, n_items, items, items_sha256, contaminated.

    A benchmark window is ``span`` consecutive words of an item, or a whole shorter item. A document's word is hit if it lies inside an occurrence
    of a window; ``spans`` are the hit stretches as word positions (from 1, both ends included). Null and empty texts have no words; items
    without words never occur; items of null id count for words but are not listed. Items that share an id are one item. Every
    row, repeated or with a null key, gives a row; an empty benchmark hits nothing. Other columns are ignored.
    """
    spark = docs.sparkSession
    windows, window_items = benchmark_windows(bench, key=item, text=item_text, span=span)
    spans = sorted(r[0] for r in windows.select("span").distinct().collect())  # at most ``span`` values
    count = windows.count()
    rows = docs.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("row"), word_array(F.col(text)).alias("words"))
    mask = (1 << POSITION_BITS) - 1
    table, near = _table(windows), []
    for n in spans:
        k = min(GRAM, n)
        slot = f"shiftright(f, {POSITION_BITS}) & {TABLE_BITS - 1}L"
        listed = f"(shiftright(get(bits, int(shiftright({slot}, 6))), int({slot} & 63L)) & 1L) = 1L".replace("bits", table)
        rows = rows.withColumn(f"prints{n}", winnow("words", n))
        around = (
            f"struct({n} AS span, shiftright(f, {POSITION_BITS}) AS hash, int(f & {mask}L) AS at, greatest(1, int(f & {mask}L) - {n - k}) AS first,"
            f" slice(words, greatest(1, int(f & {mask}L) - {n - k}), least({n - k + n}, int(f & {mask}L) + {n - 1})) AS around)"
        )
        near.append(F.expr(f"transform(filter(prints{n}, f -> {listed}), f -> {around})"))
    none = F.expr("CAST(array() AS ARRAY<STRUCT<span: INT, hash: BIGINT, at: INT, first: INT, around: ARRAY<STRING>>>)")
    rows = rows.select("key", "row", F.size("words").alias("n_words"), F.explode_outer(F.concat(none, *near)).alias("near")).select("key", "row", "n_words", "near.*")

    sides = windows.select(F.col("span").alias("w_span"), F.col("hash").alias("w_hash"), "place", "win", F.col("words").alias("w_words"))
    if count <= BROADCAST_WINDOWS:
        sides = F.broadcast(sides)
    else:  # rows without a hit must not meet in one task
        rows = rows.withColumns({"hash": F.coalesce("hash", "row"), "span": F.coalesce("span", F.lit(0))})
    start = F.col("at") - F.col("place") + 1
    same = (start >= 1) & (F.expr("slice(around, greatest(1, at - place + 1 - first + 1), size(w_words))") == F.col("w_words"))
    found = rows.join(sides, (F.col("span") == F.col("w_span")) & (F.col("hash") == F.col("w_hash")) & same, "left")
    stretch = F.when(F.col("win").isNotNull(), F.struct(start.alias("a"), (start + F.col("span") - 1).alias("b")))
    found = found.groupBy("row", "key", "n_words").agg(F.collect_set(stretch).alias("at"), F.collect_set("win").alias("wins"))
    merged = """aggregate(array_sort(at), CAST(array() AS ARRAY<STRUCT<a: INT, b: INT>>), (acc, x) ->
        CASE WHEN size(acc) > 0 AND x.a <= element_at(acc, -1).b + 1
             THEN concat(slice(acc, 1, size(acc) - 1), array(struct(element_at(acc, -1).a AS a, greatest(x.b, element_at(acc, -1).b) AS b)))
             ELSE concat(acc, array(x)) END)"""
    found = Staged(found.select("row", "key", "n_words", F.expr(merged).alias("spans"), "wins"), "hits").df

    items = found.select("row", F.explode("wins").alias("win")).join(window_items, "win").groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = found.drop("wins").join(items, "row", "left").withColumn("items", F.coalesce("items", F.expr("CAST(array() AS ARRAY<STRING>)")))
    n_hit = F.expr("aggregate(spans, 0L, (n, x) -> n + x.b - x.a + 1)")
    return out.select(
        F.col("key").alias(key), F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), "spans",
        F.size("items").cast("long").alias("n_items"), "items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
