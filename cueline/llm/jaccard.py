"""N-gram Jaccard join as a blocked sparse product of the document by n-gram incidence matrix.

Rows are classes of documents with equal n-gram sets, columns are n-grams. The product's entries (overlaps of two rows) are
accumulated column block by column block: first over each row's leading columns, in one global order that puts
very common n-grams last; an entry whose partial count and sizes cannot reach the similarity is discarded, and only
the rest is completed over all columns. Two rows above the similarity share a leading column, so no link is lost.

A column's rows are not multiplied with one another at once: each column first meets its few most central rows
(stars), links found so join rows to components, and only rows of different components in a column are multiplied after that.
Large groups of near copies so cost a few products per row and column, while every two rows that could link two components are still compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Staged, forget_finished, returning, small_batches
from .components import components
from .shingles import shingle_sets

#: N-grams at most that are put last in the column order (4 MB on each executor), the documents that one must be seen in at least.
MAX_COMMON, LEAST_COMMON = 1 << 18, 8
#: Rows of a column that all its other rows are multiplied with at first.
CENTRES = 8
#: Columns, at most, that two rows of different components must share among the earliest of both.
EARLY = 2
#: Documents of a common n-gram for each part that its column is dealt out in.
SLOT_ROWS = 1000
#: N-grams whose local counts a task holds at once.
HELD_GRAMS = 2_000_000
#: Keys up to which texts are looked up by a broadcast (some 40 bytes each) instead of an exchange of the texts.
BROADCAST_KEYS = 1_000_000
#: What an entry of the product carries of a row: number, size, and the place of its last leading column in the order.
ROW = ("node", "n", "place")
#: Bits of a class number; the few classes that share one are numbered anew.
NODE_BITS = 64


def leading(n: int, percent: int) -> int:
    """Columns among which two rows of this similarity must share one."""
    return n - -(-percent * n // 100) + 1 if n else 0


def _class(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def _rows(docs: DataFrame, width: int) -> DataFrame:
    """kind 0: key, n, cls of each document; kind 1: an n-gram and the number of a task's documents with it, if two at least."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def batch(kind: int, keys: pa.Array, n: pa.Array, cls: pa.Array, grams: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([kind] * len(n), pa.int32()), keys, n, cls, grams], ["kind", "key", "n", "cls", "gram"])

        def seen(keys: pa.DataType) -> pa.RecordBatch:
            grams, counts = np.unique(np.concatenate(held), return_counts=True)
            more = counts > 1
            size = int(more.sum())
            return batch(1, pa.nulls(size, keys), pa.array(counts[more], pa.int64()), pa.nulls(size, pa.binary()), pa.array(grams[more].view(np.int64)))

        b = None
        for b in batches:
            n, cls = [], []
            for grams in shingle_sets(b.column("text"), width):
                n.append(len(grams))
                cls.append(_class(grams))
                held.append(grams)
            yield batch(0, b.column("key"), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.nulls(len(n), pa.int64()))
            if sum(map(len, held)) >= HELD_GRAMS:
                yield seen(b.column("key").type)
                held = []
        if held:
            yield seen(b.column("key").type)

    return docs.mapInArrow(returning(scan), f"kind int, key {docs.schema['key'].dataType.simpleString()}, n long, cls binary, gram long")


def _common(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-grams seen in most documents, sorted, with the place of each by rising count and its slots; as many as MAX_COMMON allows."""
    seen = rows.filter("kind = 1").groupBy("gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COMMON)
    steps = seen.groupBy(F.floor(F.log2("n")).alias("step")).count().collect()  # at most 64 rows
    least, total = 1 << 62, 0
    for r in sorted(steps, key=lambda r: -r["step"]):
        total += r["count"]
        if total > MAX_COMMON:
            break
        least = 1 << r["step"]
    found = seen.filter(F.col("n") >= least).select("gram", "n").collect()
    grams, counts = np.array([r[0] for r in found], np.int64).view(np.uint64), np.array([r[1] for r in found], np.int64)
    place = np.empty(len(grams), np.int64)
    place[np.lexsort((grams, counts))] = np.arange(len(grams))
    order = np.argsort(grams)
    return grams[order], place[order], 1 + counts[order] // SLOT_ROWS


def _node(classes: DataFrame) -> Column:
    """A number for each class: the hash of its digest, but for the few classes whose hash another one has, one that no class has."""
    number = lambda salt: F.shiftright(F.xxhash64("cls", F.lit(salt)), 64 - NODE_BITS)
    twice = classes.groupBy(number(0).alias("node")).agg(F.min("cls").alias("first"), F.max("cls").alias("last")).filter("first <> last")
    if twice.isEmpty():
        return number(0)
    # some N * N / 2^65 of N classes: 270 of 10^11
    later = classes.withColumn("node", number(0)).join(F.broadcast(twice), "node").filter("cls <> first").select("cls").distinct().collect()
    later = sorted(bytes(r["cls"]) for r in later)
    moved = F.col("cls").isin([F.lit(c) for c in later])
    salt = 1
    while True:
        again = F.when(moved, number(salt)).otherwise(number(0))
        new = [r[0] for r in classes.filter(moved).select(again).distinct().collect()]
        if len(new) == len(later) and classes.filter(~moved & number(0).isin(new)).isEmpty():
            return again
        salt += 1


def _leading_rows(docs: DataFrame, common: tuple[np.ndarray, np.ndarray, np.ndarray], width: int, percent: int) -> DataFrame:
    """cls, n, p and the leading columns of each class in a task: rare ones, and common ones with their slots; place: that of the last leading column in the order."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (late, places, slots), known = shared.value, set()
        for b in batches:
            out: list[tuple] = []
            for grams in shingle_sets(b.column("text"), width):
                cls = _class(grams)
                if not len(grams) or cls in known:
                    continue
                known.add(cls)
                place = (grams >> np.uint64(2)).view(np.int64)  # rare n-grams by hash, then the common ones by count
                at = np.minimum(np.searchsorted(late, grams), max(0, len(late) - 1))
                is_late = late[at] == grams if len(late) else np.zeros(len(grams), bool)
                place[is_late] = (1 << 62) + places[at[is_late]]
                p = leading(len(grams), percent)
                first = np.argsort(place, kind="stable")[:p]
                rare, often = first[~is_late[first]], first[is_late[first]]
                out.append((cls, len(grams), p, int(place[first].max()), grams[rare].view(np.int64), grams[often].view(np.int64), slots[at[often]]))
            cols = list(zip(*out, strict=True)) if out else [()] * 7
            kinds = [pa.binary(), *[pa.int64()] * 3, *[pa.list_(pa.int64())] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["cls", "n", "p", "place", "rare", "often", "slots"])

    return docs.mapInArrow(returning(scan), "cls binary, n long, p long, place long, rare array<long>, often array<long>, slots array<long>")


def _possible(count: Column, percent: int) -> Column:
    """Whether rows a and b can reach the similarity: ``count`` shared among both's leading columns, the rest of one after its last."""
    rest_a, rest_b = (F.ceil(F.col(n) * percent / 100) - 1 for n in ("a_n", "b_n"))
    rest = F.when(F.col("a_place") < F.col("b_place"), rest_a).when(F.col("a_place") > F.col("b_place"), rest_b).otherwise(F.greatest(rest_a, rest_b))
    most = F.least(count + rest, F.col("a_n"), F.col("b_n"))
    return (100 + percent) * most >= percent * (F.col("a_n") + F.col("b_n"))


def _fits(percent: int) -> Column:
    """Whether the sizes of rows a and b alone allow the similarity."""
    return 100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n")


def _accumulate(entries: DataFrame, percent: int) -> DataFrame:
    """Sum the entries (of rows a and b: node, n, place) of the product over the leading columns, and discard by size."""
    pairs = entries.groupBy(*[f"{s}_{c}" for s in "ab" for c in ROW]).agg(F.count("*").alias("shared"))
    return pairs.filter(_possible(F.col("shared"), percent)).select("a_node", "b_node")


def _named(df: DataFrame, s: str) -> DataFrame:
    return df.select(*[F.col(c).alias(c if c in ("gram", "slot") else f"{s}_{c}") for c in df.columns])


def _complete(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among the pairs: the product over all columns."""
    a = sets.select(F.col("node").alias("a_node"), F.col("grams").alias("a_grams"))
    b = sets.select(F.col("node").alias("b_node"), F.col("grams").alias("b_grams"))
    both = pairs.join(a, "a_node").join(b, "b_node")
    overlap = F.size(F.array_intersect("a_grams", "b_grams"))
    linked = (100 + percent) * overlap >= percent * (F.size("a_grams") + F.size("b_grams"))
    return both.filter(linked).select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))


def _sets(docs: DataFrame, nodes: DataFrame, members: DataFrame, node: Column, width: int) -> DataFrame:
    """(node, grams) of the given nodes, from the text of each class's least key."""
    keys = members.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("key").alias("key")).select(F.col("key").alias("wanted")).distinct()
    keys = Staged(keys, "keys").df
    if keys.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    texts = docs.join(keys, F.col("key").eqNullSafe(F.col("wanted")), "left_semi")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [s for s in shingle_sets(b.column("text"), width) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([_class(s) for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["cls", "grams"])

    found = texts.select("text").mapInArrow(returning(scan), "cls binary, grams array<long>").select(node.alias("node"), "grams")
    return found.join(nodes, "node", "left_semi").groupBy("node").agg(F.first("grams").alias("grams"))


def _columns(lead: DataFrame) -> DataFrame:
    """(gram, slots, node, at) of the columns that hold two rows or more; ``at`` is the column's place among the row's, from 0.

    A rare n-gram's rows meet in one task. A common one's do not: it is known to be seen twice, so its rows are dealt out by n-gram and row.
    """
    rare = lead.select(F.posexplode("rare").alias("at", "gram"), "node")
    w = Window.partitionBy("gram")
    rare = rare.withColumns({"low": F.min("node").over(w), "high": F.max("node").over(w)}).filter("low < high")
    rare = rare.select("gram", F.lit(1).cast("long").alias("slots"), "node", "at").distinct()  # a class may come from two tasks
    often = lead.select(F.posexplode(F.arrays_zip("often", "slots")).alias("at", "c"), F.size("rare").alias("before"), "node")
    often = often.select(F.col("c.often").alias("gram"), F.col("c.slots").alias("slots"), "node", (F.col("at") + F.col("before")).alias("at")).distinct()
    return rare.union(often)


def _star(index: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Entries of each column's rows with its central rows: those with the fewest leading columns of their own."""
    own = index.groupBy("node").agg(F.count("*").alias("s")).join(sizes, "node").select(*ROW, (F.col("p") - F.col("s")).alias("own"))
    index = Staged(index.drop("at").join(own, "node"), "columns").df

    def rows(many: bool) -> DataFrame:
        return index.filter("slots > 1" if many else "slots = 1")

    def centres(many: bool) -> DataFrame:
        found = rows(many).withColumn("rank", F.row_number().over(Window.partitionBy("gram").orderBy("own", "node")))
        return found.filter(F.col("rank") <= CENTRES).drop("rank")

    outer = (F.col("a_own") > F.col("b_own")) | ((F.col("a_own") == F.col("b_own")) & (F.col("a_node") > F.col("b_node")))
    outer &= _fits(percent)
    few = _named(rows(False).drop("slots"), "a").join(_named(centres(False).drop("slots"), "b"), "gram").filter(outer)
    # a column of many rows: its central rows go to each of its slots
    dealt = rows(True).withColumn("slot", F.expr("pmod(xxhash64(node), slots)")).drop("slots")
    copied = centres(True).withColumn("slot", F.explode(F.expr("sequence(0L, slots - 1)"))).drop("slots")
    many = _named(dealt, "a").join(_named(copied, "b"), ["gram", "slot"]).filter(outer)
    sides = [f"{s}_{c}" for s in "ab" for c in ROW]
    return few.select(*sides).union(many.select(*sides))


def _crossed(index: DataFrame, sizes: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs (a_node, b_node) of rows of different components that share enough early columns.

    Two such rows are not both in a column's largest component: its other rows meet all rows, and no row meets its own component.
    """
    info = sizes.join(labels, "node", "left").select("node", "n", F.coalesce("comp", "node").alias("comp"))
    one, column = Window.partitionBy("gram", "comp"), Window.partitionBy("gram")
    rows, kept = index.join(info, "node"), ["gram", "node", "n", "at", "comp"]
    few = rows.filter("slots = 1").withColumn("rows", F.count("*").over(one))
    few = few.withColumns({"low": F.min("comp").over(column), "high": F.max("comp").over(column), "top": F.max(F.struct("rows", "comp")).over(column)["comp"]}).filter("low < high")
    few = few.select(*kept, (F.col("comp") != F.col("top")).alias("small"))
    many = rows.filter("slots > 1")
    largest = many.groupBy("gram", "comp").agg(F.count("*").alias("rows")).groupBy("gram")
    largest = largest.agg(F.max_by("comp", F.struct("rows", "comp")).alias("top"), F.count("*").alias("comps")).filter("comps > 1").select("gram", "top")
    many = many.join(F.broadcast(largest), "gram")  # at most MAX_COMMON rows
    known = Staged(few.union(many.select(*kept, (F.col("comp") != F.col("top")).alias("small"))), "open").df
    other = (F.col("a_comp") != F.col("b_comp")) & (~F.col("b_small") | (F.col("a_node") < F.col("b_node")))
    least, wanted = _early(percent)
    early = (F.col("a_at") < F.col("a_n") - least + wanted) & (F.col("b_at") < F.col("b_n") - least + wanted)
    met = _named(known.filter("small"), "a").join(_named(known, "b"), "gram").filter(other & _fits(percent) & early)
    a_first = F.col("a_node") < F.col("b_node")
    a = [F.when(a_first, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}")).alias(f"a_{c}") for c in ("node", "n")]
    b = [F.when(a_first, F.col(f"b_{c}")).otherwise(F.col(f"a_{c}")).alias(f"b_{c}") for c in ("node", "n")]
    pairs = met.select(*a, *b).groupBy("a_node", "a_n", "b_node", "b_n").agg(F.count("*").alias("shared"))
    return pairs.filter(F.col("shared") >= wanted).select("a_node", "b_node")


def _early(percent: int) -> tuple[Column, Column]:
    """Of rows a and b: columns that they must share, and how many of these must be early in both.

    The first k columns that they share have all others that they must share after them, so they lie among the first n - least + k of
    each row; k is as many as EARLY and the rows' leading columns allow.
    """
    least = F.ceil(percent * (F.col("a_n") + F.col("b_n")) / (100 + percent))
    rest_a, rest_b = (F.ceil(F.col(n) * percent / 100) - 1 for n in ("a_n", "b_n"))
    return least, F.least(F.lit(EARLY).cast("long"), least - rest_a, least - rest_b)


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """Per row: key, n_shingles, component_id (the least key that links lead to, its own included).

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a text of fewer than ``width`` words is one shingle. Texts without words and
    null texts have no shingle and no link: their component is their own key. Every row gives a row; a null key takes part, and its component has the least
    non-null key, or null. Repeated rows fall together. The key may be of any type with an order. Other columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
    rows = Staged(_rows(docs, width), "shingles")
    node = _node(rows.df.filter("kind = 0"))
    members = rows.df.filter("kind = 0 AND n > 0").select("key", "n", node.alias("node"))
    empty = rows.df.filter("kind = 0 AND n = 0").select("key", "n", F.col("key").alias("component_id"))

    lead = Staged(_leading_rows(docs.select("text"), _common(rows.df), width, percent).select(node.alias("node"), "n", "p", "place", "rare", "often", "slots"), "leading")
    sizes = Staged(lead.df.select("node", "n", "p", "place").distinct(), "sizes")
    index = Staged(_columns(lead.df), "index")
    lead.drop()
    forget_finished(spark)

    def links_among(pairs: DataFrame) -> Staged:
        pairs = Staged(pairs, "pairs")
        nodes = Staged(pairs.df.select(F.explode(F.array("a_node", "b_node")).alias("node")).distinct(), "nodes")
        sets = Staged(_sets(docs, nodes.df, members, node, width), "sets")
        links = Staged(_complete(pairs.df, sets.df, percent), "links")
        for t in (pairs, nodes, sets):
            t.drop()
        forget_finished(spark)
        return links

    links = links_among(_accumulate(_star(index.df, sizes.df, percent), percent))
    labels = components(links.df)
    more = links_among(_crossed(index.df, sizes.df, labels.df, percent))
    if not more.df.isEmpty():
        labels.drop()
        labels = components(links.df.union(more.df))
    for t in (links, more, index, sizes):
        t.drop()

    # tables on both sides of a join, so that a class or component of many rows can be split
    classes = Staged(members.groupBy("node").agg(F.min("key").alias("own")).join(labels.df, "node", "left"), "classes").df
    least = Staged(classes.filter("comp IS NOT NULL").groupBy("comp").agg(F.min("own").alias("component")), "components").df
    ids = Staged(classes.join(least, "comp", "left").select("node", F.coalesce("component", "own").alias("component_id")), "ids").df
    out = members.join(ids, "node").select("key", "n", "component_id").union(empty)
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id")
