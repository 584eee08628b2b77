import random

import numpy as np
import pyarrow as pa
import pytest
from cueline.llm import jaccard as J
from cueline.llm import common, shingles
from cueline.llm.components import components
from rows import WORDS, awkward, clashing, table

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def brute_set(text):
    w = (text or "").encode().translate(LOWER).split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [brute_set(r[1]) for r in rows]
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            x, y = sets[i], sets[j]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                comp[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return [(r[0], len(s), least.get(root(i)) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets, strict=True))]


def same(spark, rows, wrap=lambda df: df):
    key = lambda r: tuple((v is None, v or 0) for v in r)
    got = J.near_duplicates(wrap(table(spark, rows).repartition(3))).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)


def edited(rng, words, rate):
    return [rng.choice(WORDS) if rng.random() < rate else w for w in words]


@pytest.mark.parametrize("chunk", [40, 1 << 20])
def test_shingles_match_python(monkeypatch, chunk):
    monkeypatch.setattr(shingles, "CHUNK", chunk)
    texts = [r[1] for r in awkward()] + [" ".join(WORDS[:200]), "UP up Up", "x" * 100, "x" * 40 + " " + "y" * 39 + " z " + "x" * 81, " " * 50 + "z"]
    got = list(shingles.shingle_sets(pa.array([None if t is None else t.encode() for t in texts], pa.binary())))
    where = {}
    for t, s in zip(texts, got, strict=True):
        want = brute_set(t)
        assert len(s) == len(want) and (np.diff(s) > 0).all() if len(s) > 1 else len(s) == len(want)
        where.setdefault(frozenset(want), set()).add(s.tobytes())
    assert all(len(v) == 1 for v in where.values()) and len({next(iter(v)) for v in where.values()}) == len(where)


def test_kept_powers_are_bounded():
    text = b"x" * (3 * shingles.CHUNK + 5)
    assert len(list(shingles.shingle_sets(pa.array([text, b"a " + text], pa.binary())))) == 2
    assert all(len(p) <= shingles.CHUNK + 2 for p in common.kept_for("shingles").values())


@pytest.mark.parametrize(("least", "slot", "bits"), [(8, 1000, 64), (2, 2, 64), (2, 5, 12)])
def test_families_against_brute_force(spark, monkeypatch, least, slot, bits):
    monkeypatch.setattr(J, "LEAST_COMMON", least)
    monkeypatch.setattr(J, "SLOT_ROWS", slot)
    monkeypatch.setattr(J, "NODE_BITS", bits)
    rng = random.Random(least)
    line = [rng.choice(WORDS) for _ in range(25)]
    rows = []
    for _ in range(12):
        base = [rng.choice(WORDS) for _ in range(rng.choice([6, 30, 80]))]
        for _ in range(rng.choice([1, 2, 9, 14])):
            words = edited(rng, base, rng.choice([0, 0, 0.01, 0.02, 0.04]))
            if rng.random() < 0.4:
                words = words[: rng.randrange(len(words), len(words) + 1)] + line[: rng.randrange(26)]
            rows.append((len(rows) * 7 % 1009, " ".join(words).replace("w1", "W1") + rng.choice(["", "\n"]), "en", "s", 0))
    same(spark, rows)


def test_chain_of_edits_is_one_component(spark):
    words, rows = list(WORDS[:200]), []
    for i in range(12):  # neighbours are near, ends share nothing
        rows.append((100 - i, " ".join(words), "en", "s", 0))
        words = words[8:] + [f"n{i}x{j}" for j in range(8)]
    same(spark, rows)


def test_awkward_rows(spark):
    same(spark, awkward(), clashing)
    assert J.near_duplicates(table(spark, [])).collect() == []


def test_class_numbers_are_distinct(spark, monkeypatch):
    monkeypatch.setattr(J, "NODE_BITS", 14)  # some three clashes
    classes = spark.createDataFrame([(bytes([i % 256, i // 256]),) for i in range(300)] * 2, "cls binary")
    assert classes.select(J._node(classes).alias("node")).distinct().count() == 300


def test_keys_of_any_type(spark):
    rows = [(str(i), f"{base} {i % 2}", "en", "s", 0) for i, base in enumerate([" ".join(WORDS[:50])] * 3 + ["lone words"])]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string, source string, n long").selectExpr("struct(doc_id AS a, length(text) AS b) AS id", "text")
    got = {r.id.a: r.component_id.a for r in J.near_duplicates(docs, key="id").collect()}
    assert got == {"0": "0", "1": "0", "2": "0", "3": "3"}


def test_text_lookup_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(J, "BROADCAST_KEYS", 0)
    rng = random.Random(2)
    base = [rng.choice(WORDS) for _ in range(60)]
    same(spark, [(i, " ".join(edited(rng, base, 0.01)), "en", "s", 0) for i in range(20)])


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).df.collect()))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}
    assert components(spark.createDataFrame([], "a long, b long")).df.count() == 0
