import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from cueline.llm import token_counts, tokenizing, wavelet

from rows import awkward, clashing, table


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizing.vocabulary_path(name))


@pytest.mark.parametrize("n,top", [(0, 1), (1, 1), (5, 3), (4096, 2), (10_000, 50_257), (9_000, 70_000)])
def test_wavelet_matrix_against_array(n, top):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, top, n).astype(np.uint32 if top > 65_536 else np.uint16)
    m = wavelet.WaveletMatrix(wavelet.WaveletMatrix.build(ids, [n], [None]))
    assert m.decode().tolist() == ids.tolist()
    for i in rng.integers(0, n, 20).tolist() if n else []:
        assert m.access(i) == ids[i]
        s = int(ids[i])
        assert m.rank(s, i) == int((ids[:i] == s).sum())
        assert m.count(s, i // 2, i) == int((ids[i // 2 : i] == s).sum())
        where = np.flatnonzero(ids == s).tolist()
        assert m.select(s, len(where) // 2) == where[len(where) // 2]
        assert m.count(s) == len(where)
    if n:
        s = int(ids[-1])
        some = m.occurrences(s) if (ids == s).sum() < 200 else None
        assert some is None or some == np.flatnonzero(ids == s).tolist()
    assert m.count(top + 5) == 0
    with pytest.raises(IndexError):
        m.access(n)


def test_wavelet_ranks_cross_blocks():
    ids = (np.arange(600_000) % 3).astype(np.uint16)
    m = wavelet.WaveletMatrix(wavelet.WaveletMatrix.build(ids, [600_000], [1]))
    assert m.access(599_999) == ids[-1] and m.select(1, 199_000) == 199_000 * 3 + 1 and m.rank(2, 600_000) == 200_000


def expected_output(rows):
    tk = library("byte_bpe_50k.json")
    out, at = [], 0
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*tk.encode(r[1] or "", add_special_tokens=False).ids, 0]
        out.append((r[0], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("shard_tokens", [50, 6_000_000])
def test_token_output_round_trip(spark, monkeypatch, shard_tokens):
    monkeypatch.setattr(wavelet, "SHARD_TOKENS", shard_tokens)
    monkeypatch.setattr(wavelet, "TASK_BYTES", 60_000)
    got = wavelet.token_output(clashing(table(spark)), tokenizer=tokenizing.vocabulary_path("byte_bpe_50k.json"))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(expected_output(awkward()), key=key)


def test_token_output_of_nothing(spark):
    got = wavelet.token_output(table(spark, []), tokenizer=tokenizing.vocabulary_path("byte_bpe_50k.json"))
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and got.collect() == []


def random_text(rng):
    alphabet = ["a", "B", "é", "'s", "'re", " ", "  ", "\n", "\t", "1", "23", ".", "!!", "漢", "😀", "<|endoftext|>", "<|startoftext|>", "\u0301", "\xa0", "\x1c", "\u3000", "word", "İ", "Σ"]
    return "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))


def test_pieces_give_the_library_ids():
    rng, ids, words = random.Random(3), library("byte_bpe_50k.json"), library("word_bpe_49k.json")
    enc = tokenizing.IdEncoder(tokenizing.vocabulary_path("byte_bpe_50k.json"))
    cnt = tokenizing.CountEncoder(tokenizing.vocabulary_path("word_bpe_49k.json"))
    texts = [random_text(rng) for _ in range(3000)] + [r[1] or "" for r in awkward()]
    texts += [" ".join(random_text(rng).replace(" ", "") or "x" for _ in range(40)) for _ in range(200)] + ["one two,\nThree four.\nfive\nsix's 7"]
    for _ in range(2):  # the second time from the cache
        flat, lengths = enc.encode(pa.array(texts, pa.string()), 7)
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        assert len(flat) == bounds[-1]
        for t, a, b, n in zip(texts, bounds, bounds[1:], cnt.count(pa.array(texts, pa.string())), strict=False):
            assert flat[a:b].tolist() == [*ids.encode(t, add_special_tokens=False).ids, 7], repr(t)
            assert n == len(words.encode(t, add_special_tokens=False).ids), repr(t)
    assert [len(x) for x in enc.encode(pa.array([], pa.string()), 7)] == [0, 0] and not len(cnt.count(pa.array([], pa.string())))
    flat, lengths = enc.encode(pa.array(texts, pa.string()).slice(100, 50))
    assert flat.tolist() == [i for t in texts[100:150] for i in ids.encode(t, add_special_tokens=False).ids] and lengths.sum() == len(flat)


def test_token_counts_and_cache(spark, tmp_path):
    path, tk = tokenizing.vocabulary_path("word_bpe_49k.json"), library("word_bpe_49k.json")
    cache = f"file://{tmp_path}/cache"
    expect = sorted(((r[0] is None, r[0] or 0, len((r[1] or "").encode()), n := len(tk.encode(r[1] or "", add_special_tokens=False).ids), n > 20)) for r in awkward())
    for _ in range(2):
        got = token_counts.token_counts(clashing(table(spark)), tokenizer=path, limit=20, cache=cache).collect()
        assert sorted((r[0] is None, r[0] or 0, *r[1:]) for r in got) == expect
        stored = spark.read.parquet(cache)
        assert stored.count() == stored.select("digest").distinct().count()  # the second run encoded nothing
    assert token_counts.token_counts(table(spark, []), tokenizer=path, limit=20).collect() == []


def test_cache_is_used_and_kept_by_version(spark, tmp_path):
    path, cache = tokenizing.vocabulary_path("word_bpe_49k.json"), f"file://{tmp_path}/cache"
    version = token_counts.tokenizer_version(path)
    one = table(spark, [(1, "some words here", "en", "s", 1)])
    digest = one.select(token_counts.content_digest(one.text)).first()[0]
    spark.createDataFrame([(version, digest, 777), ("other", digest, 5)], token_counts.CACHE_SCHEMA).write.parquet(cache)
    assert token_counts.token_counts(one, tokenizer=path, limit=1, cache=cache).first()["n_tokens"] == 777


def test_encoder_keeps_the_pieces_used_most(monkeypatch):
    """Words of many batches outlast batches of other words, and ids stay those of the library."""
    learned = []
    learn = tokenizing.IdEncoder._learn
    monkeypatch.setattr(tokenizing, "CACHE_PIECES", 100)
    monkeypatch.setattr(tokenizing.IdEncoder, "_learn", lambda self, some: learned.extend(some) or learn(self, some))
    path = tokenizing.vocabulary_path("byte_bpe_50k.json")
    enc, plain = tokenizing.IdEncoder(path), tokenizing.load(path)
    common = "a " + " ".join(f"w{k}x word, other. x{k}" for k in range(20))
    rare = ["b " + " ".join(f"r{n}q{k}" for k in range(250)) + f" long{'g' * 70} end{n}, é{n}.\nline 今天" for n in range(4)]
    for text in [common] * 8 + rare + [common]:
        ids, n = enc.encode(pa.array([text, "", "z " + text]), 0)
        want = [plain.encode(t, add_special_tokens=False).ids + [0] for t in (text, "", "z " + text)]
        assert ids.tolist() == sum(want, []) and n.tolist() == [len(w) for w in want]
    assert learned.count("w3x") == learned.count("word") == 1


def test_a_word_is_learned_once_whatever_marks_follow(monkeypatch):
    learned = []
    learn = tokenizing.IdEncoder._learn
    monkeypatch.setattr(tokenizing.IdEncoder, "_learn", lambda self, some: learned.extend(some) or learn(self, some))
    path = tokenizing.vocabulary_path("byte_bpe_50k.json")
    enc, plain = tokenizing.IdEncoder(path), tokenizing.load(path)
    texts = ["So word!! Größe... word, word?\nword\nword*** word's word'", "x " + " ".join(["Größe$$$", "word!!,", "Größe", "!!", "7!!", "é́!!", "word<|endoftext|>", "漢字:)"]), "a word" + "!" * 90 + " b"]
    for _ in range(2):
        ids, n = enc.encode(pa.array(texts), 0)
        want = [[*plain.encode(t, add_special_tokens=False).ids, 0] for t in texts]
        assert ids.tolist() == sum(want, []) and n.tolist() == [len(w) for w in want]
    assert sorted(learned) == sorted(["word", "Größe", "\nword", "word's", "!!", "7!!", "é́!!", "word<|endoftext|>", "漢字", "b"])


def test_pieces_are_learned_as_one_text_only_if_each_begins_with_its_own_space():
    path = tokenizing.vocabulary_path("byte_bpe_50k.json")
    enc, plain = tokenizing.IdEncoder(path), tokenizing.load(path)
    for some in (["a", "\nb", "c!"], ["a\nb", "", "c"], ["a\tb", "", "c"], ["", "", "d"], ["\n", "e"], ["f ", "g"], ["\xa0", "h\x1c"]):
        want = [plain.encode(p if p[:1] == "\n" else f" {p}", add_special_tokens=False).ids for p in some]
        assert [np.frombuffer(v, enc.dtype).tolist() for v in enc._learn(some).to_pylist()] == want, some


def test_planes_are_parted_and_undone_in_stretches():
    """Beside the ids before and after a plane, no array of positions for all of them is held: those take eight bytes an id."""
    n = 2_000_000
    ids = np.random.default_rng(5).integers(0, 50_257, n).astype(np.uint16)
    tracemalloc.start()
    blob = wavelet.WaveletMatrix.build(ids, [n], [1])
    built = tracemalloc.get_traced_memory()[1]
    matrix = wavelet.WaveletMatrix(blob)
    tracemalloc.reset_peak()
    held = tracemalloc.get_traced_memory()[0]
    got = matrix.decode()
    undone = tracemalloc.get_traced_memory()[1] - held
    tracemalloc.stop()
    assert (got == ids).all()
    assert built < 10 * n and undone < 8 * n, (built / n, undone / n)
