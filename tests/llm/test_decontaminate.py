import hashlib
import random
import re

import pytest
from cueline.llm import decontaminate as D
from rows import awkward, clashing, long_text, table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(text, bench, span=10):
    w = words(text)
    hit, items = set(), set()
    where = {}
    for n in range(1, span + 1):
        for i in range(len(w) - n + 1):
            where.setdefault(tuple(w[i : i + n]), []).append(i)
    for item, t in bench:
        b = words(t)
        n = min(len(b), span)
        for j in range(len(b) - n + 1) if n else ():
            for i in where.get(tuple(b[j : j + n]), ()):
                hit.update(range(i, i + n))
                items.add(item)
    names = sorted(str(i) for i in items if i is not None)
    return len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)


def run(spark, rows, bench, wrap=lambda df: df):
    items = spark.createDataFrame(bench, "item_id long, text string")
    got = D.decontaminate(wrap(table(spark, rows)), wrap(items)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted([(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got], key=key) == sorted(
        [(r[0], *brute(r[1], bench)) for r in rows], key=key
    )
    for r in got:
        assert sum(s.b - s.a + 1 for s in r.spans) == r.n_hit


@pytest.mark.parametrize("limit", [100_000, 0])
def test_random_spans_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(D, "BROADCAST_WINDOWS", limit)
    rng = random.Random(5)
    vocab = ["the", "The", "a", "is", "É", "é", "x1", "漢", "of", "To"]
    make = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(n))
    bench = [(i, make(rng.choice([10, 11, 14, 25]))) for i in range(30)] + [(31, None), (32, ""), (None, make(12)), (3, make(12))]
    rows = []
    for i in range(120):
        parts = [make(rng.randrange(15))]
        for _ in range(rng.randrange(3)):
            b = words(rng.choice(bench)[1])
            a = rng.randrange(len(b) + 1)
            parts += [" ".join(b[a : a + rng.randrange(8, 14)]).upper(), make(rng.randrange(4))]
        rows.append((i, " ".join(parts), "en", "s", 0))
    run(spark, rows, bench)


def test_short_items_awkward_rows_and_clashes(spark):
    b = awkward()
    bench = [(1, "w3 w4"), (2, "One"), (3, "漢字"), (4, " ".join(f"w{i}" for i in range(20, 35))), (5, "three, FOUR!"), (6, "a b c d"), (10, "w5 w6 w7 w8 w9 w10"), (7, "   "), (8, long_text(40))]
    run(spark, b, bench, clashing)


def test_repeated_words_keep_the_guarantee(spark):
    rows = [(0, "a " * 50, "en", "s", 0), (1, "x a b a b a b a b a b a b y", "en", "s", 0), (2, "a " * 9, "en", "s", 0)]
    run(spark, rows, [(1, "a " * 12), (2, "a b " * 5), (3, "b a " * 5)])


def test_empty_tables(spark):
    run(spark, [], [(1, "a b c")])
    run(spark, awkward(), [])
