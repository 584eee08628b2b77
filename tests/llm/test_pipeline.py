from collections import Counter

import corpus_pipeline
from cueline.llm import toxicity as X
from pyspark.sql import functions as F
from rows import awkward, table
from test_decontaminate import brute as hit
from test_jaccard import brute as groups
from test_mixing import brute_targets
from test_tokens import expected_output


def test_stages_against_plain_code(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = {r.doc_id: tuple(r) for r in docs.collect()}
    columns = docs.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.Staged(stage(spark, docs, sf), name).df
        kept.append((docs.columns, [tuple(r) for r in docs.collect()]))
    assert all(c == columns for c, _ in kept[:-1])
    assert all(r == rows[r[0]] for _, part in kept[:-1] for r in part)

    scorer = X.Scorer(X.train(X.training_rows(spark.read.parquet(f"{sf}/documents.parquet"), labels)))
    want = sorted(r for r in rows.values() if scorer.document(r[1])[0] < 0.7)
    assert sorted(kept[0][1]) == want
    want = sorted(r for r, (i, _, c) in zip(want, groups(want), strict=True) if i == c)
    assert sorted(kept[1][1]) == want
    want = [r for r in want if not hit(r[1], bench)[-1]]
    assert sorted(kept[2][1]) == want

    times = Counter(r[0] for r in kept[3][1])
    assert set(times) <= {r[0] for r in want} and max(times.values()) <= 3
    size = {r[0]: len(r[1].encode().split()) for r in want}
    for s, (_, target) in brute_targets(want).items():
        mine = [r for r in want if r[3] == s]
        taken = sum(times[r[0]] * size[r[0]] for r in mine)
        assert abs(taken - target) <= max(size[r[0]] for r in mine)
    assert sorted(kept[4][1], key=lambda r: r[1]) == sorted(expected_output(kept[3][1]), key=lambda r: r[1])


def test_pipeline_of_nothing(spark, sf):
    docs = table(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0


def test_rows_of_null_and_shared_ids(spark, sf):
    words = lambda a, n=40: " ".join(f"{a}{i}" for i in range(n))
    bench = next(r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if len(r.text.split()) > 20)
    near = words("n") + " end"
    rows = [(None, words("a"), "en", "s", 0), (None, words("b"), "en", "s", 0), (7, words("c"), "en", "s", 0), (7, words("d"), "en", "s", 0), (7, "", "en", "s", 0), (7, "", "en", "s", 0), (None, None, "en", "s", 0)]
    extra = [(None, words("n"), "en", "s", 0), (3, near, "en", "s", 0), (2, words("n"), "en", "s", 0), (2, words("n"), "en", "s", 0)]
    got = corpus_pipeline.remove_near_duplicates(spark, table(spark, rows + extra), sf).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([*rows, extra[2]], key=repr)

    dirty = [(None, f"{words('x')} {bench}", "en", "s", 0), (7, bench, "en", "s", 0)]
    got = corpus_pipeline.remove_contaminated(spark, table(spark, rows + dirty), sf).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(rows, key=repr)

    many = [(None if i % 2 else 7, words(f"m{i}x", 20), "en", f"s{i % 3}", 0) for i in range(90)]
    docs = table(spark, many)
    got = Counter(tuple(r) for r in corpus_pipeline.mix_sources(spark, docs, sf).collect())
    # targets are 300, 600 and 900 of 600 words each: rows of 20 words, 15, 30 and 45 of 30, none more than once above the least
    for s, n in (("s0", 15), ("s1", 30), ("s2", 45)):
        mine = [got[r] for r in many if r[3] == s]
        assert sum(mine) == n and max(mine) - min(mine) <= 1
    assert got == Counter(tuple(r) for r in corpus_pipeline.mix_sources(spark, docs.repartition(5, "text"), sf).collect())


def test_clashing_names_and_joins_by_exchange(spark, sf, monkeypatch):
    from cueline.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    docs = table(spark, awkward())
    for name in ("kept", "hit", "taken_id", "repeats", "row_id", "gone_row", "row", "key", "size", "full", "spans", "row_id_own"):
        docs = docs.withColumn(name, F.lit("x"))
    rows = [tuple(r) for r in docs.collect()]
    counts = []
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = corpus_pipeline.Staged(stage(spark, docs, sf), "clash").df
        got = [tuple(r) for r in docs.collect()]
        assert len(docs.columns) == 17 and set(got) <= set(rows)
        counts.append(len(got))
    assert counts[0] == len(rows) and counts[1] == counts[2] == len(rows) - 3  # a copy, a near copy and the repeated row go
    assert stage(spark, docs, sf).count() > 0


def test_run(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and got.count() > 50
