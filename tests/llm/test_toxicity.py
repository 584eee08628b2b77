import zlib

import pytest
from cueline.llm import toxicity as X
from rows import awkward, clashing, long_text, table


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    return docs, labels, X.train(X.training_rows(docs, labels))


def test_held_out_accuracy(spark, model):
    docs, labels, m = model
    got = X.score_documents(docs, m).join(labels, "doc_id").filter("held_out").collect()
    tp = sum(r.predicted and r.toxic for r in got)
    assert tp >= 0.98 * sum(r.predicted for r in got)  # clean documents stay
    assert tp >= 0.7 * sum(r.toxic for r in got)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)


def test_offending_sentences_are_located(spark, model):
    _, _, m = model
    clean = "Anat with by of nteres atre are. Thnt eringing onheed of the."
    bad = "Or the, idiot thaninw thheer pathetic scum."
    text = f"{clean} {bad} {clean}"
    r = X.score_documents(table(spark, [(1, text, "en", "s", 0), (2, clean, "en", "s", 0)]), m).orderBy("doc_id").collect()
    assert [x.predicted for x in r] == [1, 0]
    assert [text[s.start : s.end].strip() for s in r[0].offending] == [bad] and r[1].offending == []


def plain_score(m, text):
    chances = set()
    for part in X.SENTENCE.findall(text):
        f = {f for w in X.WORD.findall(part.lower()) for f in X.word_features(w)} & set(m.weights)
        if f:
            z = m.bias + sum(m.weights[x] for x in sorted(f))
            chances.add(1 / (1 + 2.718281828459045**-z))
    clean = (1 - m.leak) * (1 - 1 / (1 + 2.718281828459045**-m.bias) if text.strip() else 1)
    for p in chances:
        clean *= 1 - p
    return 1 - clean


def test_scores_against_plain_code_on_awkward_rows(spark, model):
    _, _, m = model
    rows = awkward() + [(99, "Idiot! " * 500 + long_text(50), "en", "s", 0), (98, "IDIOT moron\nclown", "en", "s", 0)]
    got = X.score_documents(clashing(table(spark, rows)), m).collect()
    assert len(got) == len(rows)
    by_id = {r[0]: r[1] or "" for r in rows}
    for r in got:
        assert abs(r.score - plain_score(m, by_id[r.doc_id])) < 1e-9
    assert {r.doc_id: r.predicted for r in got}[99] == 1
    assert X.score_documents(table(spark, []), m).collect() == []


def test_training_is_bounded_and_ignores_held_out_rows(spark, monkeypatch):
    monkeypatch.setattr(X, "MAX_TOXIC", 5)
    monkeypatch.setattr(X, "MAX_CLEAN", 7)
    docs = table(spark, [(i, f"text {i}", "en", "s", 0) for i in range(100)] + [(None, "x", None, None, None)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(None, 1), (3, None), (4, 1)], "doc_id long, toxic int")
    rows = X.training_rows(docs, labels)
    assert sum(y for _, y in rows) == 5 and len(rows) == 12
    assert all(zlib.crc32(t.split()[1].encode()) % 3 != 1 for t, _ in rows)
    assert rows == X.training_rows(docs.repartition(5), labels.repartition(3))


def test_no_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    got = X.toxicity(table(spark), labels).collect()
    assert len(got) == len(awkward()) and all(r.predicted == 0 and r.score < 0.01 for r in got)
