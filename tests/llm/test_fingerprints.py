import hashlib
import random

import pytest
from cueline.llm import fingerprints as P
from pyspark.sql import functions as F
from rows import WORDS, awkward, clashing, table


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))


def edited(text, after):
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


@pytest.mark.parametrize("bucket_rows,bounds", [(2000, 512), (3, 512), (2, 3), (1, 512)])
def test_edited_texts_follow_the_order(spark, monkeypatch, bucket_rows, bounds):
    monkeypatch.setattr(P, "BUCKET_ROWS", bucket_rows)
    monkeypatch.setattr(P, "BOUNDS", bounds)
    rows = ordered(awkward())
    got = P.fingerprints(clashing(table(spark, awkward()))).collect()
    want = []
    for i, r in enumerate(rows):
        text, after = r[1] or "", rows[(i + 1) % len(rows)][1] or ""
        want.append((r[0], len(text), hashlib.sha256(edited(text, after).encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted([(r.doc_id, r.n_chars, r.edited_sha256) for r in got], key=key) == sorted(want, key=key)
    prints = {}
    for r in got:
        text = next(x[1] or "" for x in rows if x[0] == r.doc_id)
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint  # equal texts, equal fingerprints
        assert len(r.fingerprint) == (2 * P.BINS if text.split() else 0) and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1


def brute_print(spark, text):
    """The fingerprint by a plain loop over the same hashes."""
    words = text.lower().split()
    if not words:
        return ""
    shingles = [words[i : i + 5] for i in range(max(1, len(words) - 4))]
    df = spark.createDataFrame([(s,) for s in shingles], "s array<string>")
    hashes = [r[0] for r in df.select(F.expr("shiftrightunsigned(xxhash64(s), 1)")).collect()]
    least = {}
    for h in hashes:
        least[h >> 56] = min(h, least.get(h >> 56, h))
    order = {}
    for bin_, own, p in spark.range(P.BINS).selectExpr("int(id) AS a").crossJoin(spark.range(P.BINS)).selectExpr("a", "id", "xxhash64(a, id) & -256L").collect():
        order[bin_, own] = p
    values = []
    for b in range(P.BINS):
        own = b if b in least else min(least, key=lambda o: (order[b, o], least[o] & 255))
        values.append(least[own] & 255)
    return bytes(values).hex()


def test_fingerprint_against_plain_loop(spark):
    for text in (" ".join(WORDS[:3]), " ".join(WORDS[:40]), "  \n ", " ".join(WORDS * 3)):
        got = spark.createDataFrame([(text,)], "t string").select(P.packed_fingerprint("t")).first()[0]
        assert got == brute_print(spark, text)


def test_likeness_is_near_jaccard(spark):
    rng = random.Random(1)
    pairs, want = [], []
    for n in (30, 120, 600):
        for share in (0.0, 0.5, 0.9, 1.0):
            for _ in range(15):
                a = [rng.choice(WORDS) for _ in range(n)]
                b = a[: int(n * share)] + [rng.choice(WORDS) for _ in range(n - int(n * share))]
                x, y = ({tuple(w[i : i + 5]) for i in range(n - 4)} for w in (a, b))
                pairs.append((" ".join(a), " ".join(b)))
                want.append(len(x & y) / len(x | y))
    df = spark.createDataFrame(pairs, "a string, b string")
    df = df.select(P.packed_fingerprint("a").alias("a"), P.packed_fingerprint("b").alias("b"))
    got = [r[0] for r in df.select(P.likeness("a", "b")).collect()]
    off = [g - w for g, w in zip(got, want, strict=True)]
    assert abs(sum(off) / len(off)) < 0.02 and max(map(abs, off)) < 0.25


def test_empty_and_single(spark):
    assert P.fingerprints(table(spark, [])).collect() == []
    r = P.fingerprints(table(spark, [(5, "abcdef", None, None, None)])).first()
    assert r.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and r.near_next == 1.0
