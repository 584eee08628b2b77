from collections import defaultdict

from cueline.llm import mixing
from pyspark.sql import functions as F
from rows import awkward, clashing, table


def test_targets_cap_and_reshare():
    assert mixing.capped_targets([10, 10, 10], [1, 2, 3], 30, 3) == [5, 10, 15]
    got = mixing.capped_targets([1, 100, 100], [1, 1, 1], 201, 3)
    assert got == [3.0, 99.0, 99.0]
    assert mixing.capped_targets([0, 0], [1, 2], 0, 3) == [0, 0]
    assert mixing.capped_targets([], [], 0, 3) == []


def test_flow_serves_overlaps_at_least_cost():
    # a only in s, ab in both: s can be served by either, t by ab alone
    flow = mixing.route({"a": 10, "ab": 10}, {"a": ["s"], "ab": ["s", "t"]}, {"s": 10, "t": 10}, 3)
    assert flow == {"a": 10, "ab": 10}
    flow = mixing.route({"a": 10, "ab": 10}, {"a": ["s"], "ab": ["s", "t"]}, {"s": 5, "t": 25}, 3)
    assert flow["ab"] == 25 and flow["a"] == 5


def brute_targets(rows):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len((r[1] or "").encode().split())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, lo, hi = sum(sizes.values()), 0.0, 1e12
    for _ in range(200):  # the water level at which capped shares sum to the total
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(3 * sizes[s], mid * weight[s]) for s in names) < total else (lo, mid)
    return {s: (sizes[s], min(3 * sizes[s], hi * weight[s])) for s in names}


def check(rows, got, near):
    want, taken = brute_targets(rows), defaultdict(int)
    assert len(got) == len(rows)
    by_id = {r[0]: r for r in rows}
    for r in got:
        size, target = want[by_id[r.doc_id][3]]
        assert r.size == len((by_id[r.doc_id][1] or "").encode().split())
        assert r.source_size == size and abs(r.target - target) <= 1e-6 * max(1, target)
        assert r.taken == r.repeats * r.size and 0 <= r.repeats <= 3
        taken[by_id[r.doc_id][3]] += r.taken
    for s, (_, target) in want.items():
        assert abs(taken[s] - target) <= near(s, target)


def test_mix_awkward_rows(spark):
    rows = awkward()
    got = mixing.mix(clashing(table(spark)), key="doc_id", sources=F.array("source")).collect()
    largest = max(len((r[1] or "").split()) for r in rows)
    check(rows, got, lambda s, t: largest)
    assert mixing.mix(table(spark, []), key="doc_id", sources=F.array("source")).collect() == []


def test_mix_comes_near_and_agrees(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    first = mixing.mix(docs, key="doc_id", sources=F.array("source")).collect()
    check(rows, first, lambda s, t: max(20, 0.02 * t))
    again = mixing.mix(docs.repartition(7, "lang"), key="doc_id", sources=F.array("source")).collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, again))


def test_mix_overlapping_sources(spark):
    rows = [(i, "w " * (i % 9 + 1), "en", "x", 0) for i in range(300)]
    docs = table(spark, rows).withColumn("sources", F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).when(F.col("doc_id") % 3 == 1, F.array(F.lit("a"))).otherwise(F.array(F.lit("b"))))
    got = mixing.mix(docs, key="doc_id", sources=F.col("sources"), weight=lambda i, s: 1.0).collect()
    assert {r.pattern for r in got} == {'["a"]', '["b"]', '["a","b"]'}
    total = sum(r.size for r in got)
    assert abs(sum(r.taken for r in got) - total) <= 30


def test_rest_is_filled_past_a_long_document(spark):
    # cells whose greedy part meets a document larger than what is left, among far more short ones than a round looks at
    rows = spark.range(30_000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', if(id < 3, 60000, 10))").alias("text"), F.lit("a").alias("source"))
    for seed in range(4):
        got = mixing.mix(rows, key="doc_id", sources=F.array("source"), budget=0.3, seed=seed).agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).first()
        assert 0 <= got.target - got.taken <= 10, (seed, got)
