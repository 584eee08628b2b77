"""Whole-text tokenization through a bounded cache of space-separated pieces.

Both tokenizers here split a text before every single space (or line end) between two other characters, so parts can be encoded each on its own, so a text's ids are the ids of its pieces one after another. Pieces repeat; the
library encodes each new one once per worker.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from itertools import batched, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import kept_for, single_threaded

#: Pieces in one generation of a worker's cache; two generations are kept. A table keeps as many pieces as two, those used most.
CACHE_PIECES = 300_000
#: A piece of more characters than this is not kept.
LONG_PIECE = 64
#: Marks that may end a piece of letters; they are tokens of their own.
_MARKS = frozenset(",.;:!?|")

#: ASCII marks that may follow a word in a piece, also many of them.
_TAIL_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: A word, after a line end or none, of letters that every version of Unicode in use calls so; pieces of others are learned whole.
_LETTERS = (
    "^\n?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0388-\u038a\u038e-\u03a1\u03a3-\u03ce\u0410-\u044f\u0451-\u045f"
    "\u05d0-\u05ea\u0621-\u063a\u0641-\u064a\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]+$"
)

_ODD_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0                　"
_SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: Texts of which not every space and line end stands alone between two other characters.
_NOT_PLAIN = f"^[ \n]|[ \n]$|[ \n][ \n]|[{_ODD_SPACE}]"


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    """The tokenizer of a .json file, once per process."""
    loaded = kept_for("tokenizing")
    if path not in loaded:
        single_threaded()
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        loaded[path] = t
    return loaded[path]


class PieceCache:
    """piece -> value, for the pieces used last. ``learn`` gives the values of pieces that neither generation holds; a mark after a word has a value of its own."""

    def __init__(self, learn: Callable[[Sequence[str]], list], marks: list):
        self.young: dict = {}
        self.old: dict = {}
        self.learn = learn
        self.marks = dict(zip(sorted(_MARKS), marks, strict=True))

    @contextmanager
    def holding(self, pieces: list[str]) -> Iterator[dict]:
        """The young generation with all these pieces in it, for as long as a batch needs them."""
        if len(self.young) > CACHE_PIECES:
            self.old, self.young = self.young, {}
        young, old, parted = self.young, self.old, []
        whole: set[str] = set()
        for p in [p for p in pieces if p not in young]:
            v = old.get(p)
            if v is not None:
                young[p] = v
            elif p[-1:] in _MARKS and _letters_and_mark(p):
                parted.append(p)
                if (base := p[:-1]) not in young:
                    v = old.get(base)
                    if v is None:
                        whole.add(base)
                    else:
                        young[base] = v
            else:
                whole.add(p)
        for some in batched(sorted(whole), 4096):
            young.update(zip(some, self.learn(some), strict=True))
        for p in parted:
            young[p] = young[p[:-1]] + self.marks[p[-1]]
        yield young
        for p in [p for p in chain(whole, parted) if len(p) > LONG_PIECE]:
            del young[p]


class PieceTable:
    """piece -> bytes as two Arrow columns, for the pieces that most batches use: all pieces of a batch are looked up at once, without a Python object each.

    Marks after a word have a value of their own, so that a word is held once whatever follows it. ``learn`` gives the values of
    pieces, ``learn_marks`` those of marks.
    """

    def __init__(self, learn: Callable[[Sequence[str]], pa.Array], learn_marks: Callable[[Sequence[str]], list[bytes]]):
        self.pieces, self.values, self.uses = pa.array([], pa.string()), pa.array([], pa.large_binary()), np.zeros(0, np.int64)
        self.floor = 0
        self.learn, self.learn_marks = learn, learn_marks
        self.marks: dict[str, bytes] = {}

    def look_up(self, wanted: pa.Array) -> pa.Array:
        """The values of distinct pieces; those that the table lacks are learned and kept in it."""
        trimmed = pc.ascii_rtrim(wanted, characters=_TAIL_MARKS)
        ends = np.flatnonzero(pc.less(pc.binary_length(trimmed), pc.binary_length(wanted)).to_numpy(zero_copy_only=False))
        ends = ends[pc.match_substring_regex(trimmed.take(pa.array(ends)), _LETTERS).to_numpy(zero_copy_only=False)]
        if not len(ends):
            return self._values(wanted)
        is_word = np.zeros(len(wanted), bool)
        is_word[ends] = True
        coded = pc.if_else(pa.array(is_word), trimmed, wanted).dictionary_encode()
        values = self._values(coded.dictionary).take(coded.indices)
        marks = _ends(wanted.take(pa.array(ends)), trimmed.take(pa.array(ends))).dictionary_encode()
        marked = pc.binary_join_element_wise(values.take(pa.array(ends)), self._mark_values(marks.dictionary.to_pylist()).take(marks.indices), pa.scalar(b"", pa.large_binary()))
        at = np.arange(len(wanted))
        at[ends] = len(wanted) + np.arange(len(ends))
        return pa.concat_arrays([values, marked]).take(pa.array(at))

    def _mark_values(self, marks: list[str]) -> pa.Array:
        new = [m for m in marks if m not in self.marks]
        learned = dict(zip(new, self.learn_marks(new), strict=True))
        values = pa.array([learned.get(m) or self.marks[m] for m in marks], pa.large_binary())
        if len(self.marks) > CACHE_PIECES // 10:
            self.marks = {}
        self.marks |= {m: v for m, v in learned.items() if len(m) <= LONG_PIECE}
        return values

    def _values(self, wanted: pa.Array) -> pa.Array:
        # the batch's pieces are hashed and the table's looked up among them: hashing is the dearer part, and the table is the longer one
        found = pc.index_in(self.pieces, value_set=wanted)
        held = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
        self.uses[held] += 1
        at = np.full(len(wanted), -1, np.int64)
        at[found.drop_null().to_numpy()] = held
        lacks = np.flatnonzero(at < 0)
        if not len(lacks):
            return self.values.take(pa.array(at))
        new = wanted.take(pa.array(lacks))
        values = pa.concat_arrays([self.learn(some) for some in batched(new.to_pylist(), 4096)])
        at[lacks] = len(self.values) + np.arange(len(new))
        out = pa.concat_arrays([self.values, values]).take(pa.array(at))
        short = pc.less_equal(pc.utf8_length(new), LONG_PIECE)
        self.pieces, self.values = pa.concat_arrays([self.pieces, new.filter(short)]), pa.concat_arrays([self.values, values.filter(short)])
        self.uses = np.concatenate([self.uses, np.full(len(self.pieces) - len(self.uses), self.floor + 1)])
        if len(self.pieces) > 2 * CACHE_PIECES:  # a new piece counts one use more than the least used of those kept last
            kept = np.sort(np.argsort(self.uses, kind="stable")[-2 * CACHE_PIECES :])
            self.pieces, self.values, self.uses = self.pieces.take(pa.array(kept)), self.values.take(pa.array(kept)), self.uses[kept]
            self.floor = int(self.uses.min())
        return out


def _ends(strings: pa.Array, beginnings: pa.Array) -> pa.Array:
    """What each string has after its beginning."""
    whole, head = (pc.binary_length(x).to_numpy().astype(np.int64) for x in (strings, beginnings))
    sizes = whole - head
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    first = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings)] + head
    raw = np.frombuffer(strings.buffers()[2], np.uint8)[np.repeat(first - bounds[:-1], sizes) + np.arange(bounds[-1])]
    return pa.StringArray.from_buffers(len(strings), pa.py_buffer(bounds), pa.py_buffer(raw))


def space_pieces(texts: pa.Array) -> pa.ListArray:
    """Parts of each text: joined, each after the first preceded by a space unless it begins with a line end, they give the text."""
    odd = np.flatnonzero(pc.match_substring_regex(texts, _NOT_PLAIN).to_numpy(zero_copy_only=False))
    # a lone line end between two other characters is a token of its own, like the lone space
    if not len(odd):
        return pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
    plain = np.setdiff1d(np.arange(len(texts)), odd)
    parts = [pc.split_pattern(pc.replace_substring(texts.take(pa.array(plain)), "\n", " \n"), " ")]
    parts.append(pa.array([_SAFE_SPACE.split(t.as_py()) for t in texts.take(pa.array(odd))], pa.list_(pa.string())))
    return pa.concat_arrays(parts).take(pa.array(np.argsort(np.concatenate([plain, odd]))))


def _letters_and_mark(piece: str) -> bool:
    base = piece[:-1].lower()  # a capital may have a lower case of a letter and a mark that is none
    return len(piece) > 2 and base[1:].isalpha() and (base[0].isalpha() or base[0] == "\n")


class IdEncoder:
    """Texts to ids with a byte-level BPE of the tokenizers library, exactly as its encode() gives them."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.is_start = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        for token, i in self.tokenizer.get_vocab().items():  # bytes 0x20 and 0x0A are written as these letters
            self.is_start[i] = token[:1] in ("\u0120", "\u010a")
        self.table = PieceTable(self._learn, self._ids)

    def _ids(self, strings: Sequence[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]

    def _learn(self, some: Sequence[str]) -> pa.Array:
        """Ids of pieces within a text, each after a space unless it begins with a line end.

        All are encoded as one text, if its spaces and line ends are those before pieces and an id begins with each.
        """
        parts = [p if p[:1] == "\n" else f" {p}" for p in some]
        text = "".join(parts)
        if text.count(" ") + text.count("\n") == len(parts):
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
            starts = np.flatnonzero(self.is_start[ids])
            if len(starts) == len(parts) and not starts[0]:
                bounds = np.append(starts, len(ids)) * self.dtype.itemsize
                return pa.Array.from_buffers(pa.large_binary(), len(parts), [None, pa.py_buffer(bounds), pa.py_buffer(ids)])
        return pa.array(self._ids(parts), pa.large_binary())

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (none null) one after another, each text's followed by ``end`` if that is given, and the number of each text's."""
        if not len(texts):
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        pieces = space_pieces(texts)
        first = np.asarray(pieces.offsets)[:-1] - pieces.offsets[0].as_py()
        coded = pieces.flatten().dictionary_encode()
        at = np.asarray(coded.indices).astype(np.int64)
        # a text's first piece has no space before it
        heads = self._ids(pieces.flatten().take(pa.array(first)).to_pylist())
        inner = np.ones(len(at), bool)
        inner[first] = False
        used = np.zeros(len(coded.dictionary), bool)
        used[at[inner]] = True
        known = self.table.look_up(coded.dictionary.filter(pa.array(used)))
        at = (np.cumsum(used) - 1)[at]
        at[first] = len(known) + np.arange(len(first))
        if end is not None:
            heads.append(np.array([end], self.dtype).tobytes())
            at = np.insert(at, np.append(first[1:], len(at)), len(known) + len(heads) - 1)
            first = first + np.arange(len(first))
        flat = pa.concat_arrays([known, pa.array(heads, pa.large_binary())]).take(pa.array(at))
        bounds = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(at) + 1]
        ids = np.frombuffer(flat.buffers()[2] or b"", self.dtype, count=int(bounds[-1]) // self.dtype.itemsize)
        return ids, np.diff(bounds[np.append(first, len(at))]) // self.dtype.itemsize


class CountEncoder:
    """Numbers of ids, for a tokenizer that drops white space before it splits and lower-cases."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.cache = PieceCache(self._counts, self._counts(sorted(_MARKS)))

    def _counts(self, strings: Sequence[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]

    def count(self, texts: pa.Array) -> np.ndarray:
        """The number of ids of each text (none null)."""
        pieces = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        bounds = np.asarray(pieces.offsets).astype(np.int64)
        coded = pieces.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        with self.cache.holding(distinct) as known:
            counts = np.array([known[p] for p in distinct], np.int64)
        total = np.concatenate([[0], np.cumsum(counts[np.asarray(coded.indices)])])
        return np.diff(total[bounds - bounds[0]])


def encoder(kind: type, path: str):
    """One encoder per kind and file in a process, so that its cache outlives a task."""
    encoders = kept_for("tokenizing")
    if (kind, path) not in encoders:
        encoders[kind, path] = kind(path)
    return encoders[kind, path]
