"""Token-ID output as wavelet matrices: one compressed file of succinct bit-planes per shard.

File format (little-endian), one shard: magic ``WVMX1``, u32 length of a JSON header, the header, then
sections. The header holds n, levels, the zeros of each plane, and for each section its offset and length.
Sections: documents (token counts and ids), per plane the ranks before every ``RANK_BITS`` bits, and per plane its bits in
blocks of ``BLOCK_BYTES``; every section is a zstd frame, so access reads a few blocks of each plane.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path, returning, small_batches
from .tokenizing import IdEncoder, encoder

MAGIC = b"WVMX1"
RANK_BITS, BLOCK_BYTES = 4096, 1 << 16
#: Ids that are parted or put back at a time.
STRETCH = 1 << 16
#: Bytes of text that a task should get, and ids after which a task begins its next file.
TASK_BYTES, SHARD_TOKENS = 24 << 20, 6_000_000


def _halves(one: np.ndarray, zeros: int) -> Iterator[tuple[slice, slice, slice]]:
    """Stretches of a plane, each with those of the next level that its zeros and its ones go to: positions of one stretch stay in a processor's cache."""
    low, high = 0, zeros
    for k in range(0, len(one), STRETCH):
        here = slice(k, min(k + STRETCH, len(one)))
        n = int(np.count_nonzero(one[here]))
        yield here, slice(low, low + here.stop - k - n), slice(high, high + n)
        low, high = low + here.stop - k - n, high + n


class WaveletMatrix:
    """access, rank, select, count and occurrences over one shard's ids."""

    def __init__(self, blob: bytes):
        if blob[: len(MAGIC)] != MAGIC:
            raise ValueError("not a wavelet shard")
        size = struct.unpack_from("<I", blob, len(MAGIC))[0]
        base = len(MAGIC) + 4
        head = json.loads(blob[base : base + size])
        self.blob, self.at = blob, base + size
        self.n, self.levels, self.zeros, self.sections = head["n"], head["levels"], head["zeros"], head["sections"]
        self.doc_ids = head["doc_ids"]
        self.lengths = np.frombuffer(self._section("docs"), "<u8").astype(np.int64)
        self._blocks: dict[tuple[int, int], np.ndarray] = {}
        self._ranks: dict[int, np.ndarray] = {}

    @staticmethod
    def build(ids: np.ndarray, lengths: list[int], doc_ids: list) -> bytes:
        """The file of one shard. doc_ids may hold nulls; lengths sum to the number of ids."""
        squeeze = zstandard.ZstdCompressor(level=1)
        levels = max(1, int(ids.max()).bit_length() if len(ids) else 1)
        sections, chunks, at, zeros = {}, [], 0, []

        def put(name: str, raw: bytes) -> None:
            nonlocal at
            chunks.append(squeeze.compress(raw))
            sections[name] = [at, len(chunks[-1])]
            at += len(chunks[-1])

        put("docs", np.array(lengths, "<u8").tobytes())
        left = ids
        for level in range(levels):
            one = (left & left.dtype.type(1 << (levels - 1 - level))) != 0
            packed = np.packbits(one, bitorder="little")
            steps = np.zeros(-(-len(packed) // (RANK_BITS // 8)) * (RANK_BITS // 8), np.uint8)
            steps[: len(packed)] = np.bitwise_count(packed)
            ends = steps.reshape(-1, RANK_BITS // 8).sum(axis=1, dtype=np.int64)
            put(f"r{level}", np.concatenate([[0], np.cumsum(ends)]).astype("<u8").tobytes())
            for k in range(0, len(packed), BLOCK_BYTES):
                put(f"b{level}.{k // BLOCK_BYTES}", packed[k : k + BLOCK_BYTES].tobytes())
            zeros.append(len(left) - int(np.count_nonzero(one)))
            if level + 1 == levels:
                break
            parted = np.empty_like(left)
            for here, low, high in _halves(one, zeros[-1]):
                parted[high] = left[here].compress(one[here])
                parted[low] = left[here].compress(~one[here])
            left = parted
        head = json.dumps({"n": len(ids), "levels": levels, "zeros": zeros, "sections": sections, "doc_ids": doc_ids}).encode()
        return b"".join([MAGIC, struct.pack("<I", len(head)), head, *chunks])

    def _section(self, name: str) -> bytes:
        start, size = self.sections[name]
        return zstandard.ZstdDecompressor().decompress(self.blob[self.at + start : self.at + start + size], max_output_size=1 << 31)

    def _plane(self, level: int) -> np.ndarray:
        if not self.n:
            return np.zeros(0, bool)
        raw = b"".join(self._section(f"b{level}.{k}") for k in range(-(-self.n // (8 * BLOCK_BYTES))))
        return np.unpackbits(np.frombuffer(raw, np.uint8), count=self.n, bitorder="little").view(bool)

    def _bits(self, level: int, start: int, end: int) -> np.ndarray:
        """Bits start..end-1 of a plane, within one rank step."""
        k = start // (8 * BLOCK_BYTES)
        if (level, k) not in self._blocks:
            self._blocks[level, k] = np.frombuffer(self._section(f"b{level}.{k}"), np.uint8)
        off = k * 8 * BLOCK_BYTES
        a, b = (start - off) // 8, -(-(end - off) // 8)
        return np.unpackbits(self._blocks[level, k][a:b], bitorder="little")[(start - off) - 8 * a :][: end - start]

    def _rank1(self, level: int, i: int) -> int:
        if level not in self._ranks:
            self._ranks[level] = np.frombuffer(self._section(f"r{level}"), "<u8")
        step = i // RANK_BITS
        at = int(self._ranks[level][step])
        return at + int(self._bits(level, step * RANK_BITS, i).sum()) if i % RANK_BITS else at

    def _select(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) bit of this value."""
        self._rank1(level, 0)
        steps = self._ranks[level].astype(np.int64)
        if not bit:
            steps = np.minimum(np.arange(len(steps), dtype=np.int64) * RANK_BITS, self.n) - steps
        step = int(np.searchsorted(steps, k, side="right")) - 1
        start = step * RANK_BITS
        here = self._bits(level, start, min(start + RANK_BITS, self.n))
        return start + int(np.flatnonzero(here == bit)[k - int(steps[step])])

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for level in range(self.levels):
            bit = int(self._bits(level, i, i + 1)[0])
            one = self._rank1(level, i)
            i = self.zeros[level] + one if bit else i - one
            out = out << 1 | bit
        return out

    def rank(self, symbol: int, i: int) -> int:
        """Occurrences of a symbol among the first i ids."""
        return self._range(symbol, 0, min(max(i, 0), self.n))[1]

    def count(self, symbol: int, start: int = 0, end: int | None = None) -> int:
        return self._range(symbol, start, self.n if end is None else end)[1]

    def _range(self, symbol: int, a: int, b: int) -> tuple[int, int]:
        if not self.n or symbol < 0 or symbol >> self.levels or a >= b:
            return 0, 0
        for level in range(self.levels):
            bit = symbol >> (self.levels - 1 - level) & 1
            x, y = self._rank1(level, a), self._rank1(level, b)
            a, b = (self.zeros[level] + x, self.zeros[level] + y) if bit else (a - x, b - y)
        return a, b - a

    def select(self, symbol: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of a symbol."""
        start, found = self._range(symbol, 0, self.n)
        if not 0 <= k < found:
            raise IndexError(k)
        at = start + k
        for level in reversed(range(self.levels)):
            bit = symbol >> (self.levels - 1 - level) & 1
            at = self._select(level, bit, at - self.zeros[level] if bit else at)
        return at

    def occurrences(self, symbol: int) -> list[int]:
        return [self.select(symbol, k) for k in range(self.count(symbol))]

    def decode(self) -> np.ndarray:
        """All ids in order, by undoing the planes from the last one."""
        out = self._plane(self.levels - 1).astype(np.uint16 if self.levels <= 16 else np.uint32)
        for level in reversed(range(self.levels - 1)):
            one, above = self._plane(level), np.empty_like(out)
            for here, low, high in _halves(one, self.zeros[level]):
                part = above[here]
                part[np.flatnonzero(one[here])] = out[high] | out.dtype.type(1 << (self.levels - 1 - level))
                part[np.flatnonzero(~one[here])] = out[low]
            out = above
        return out


SHARD_SCHEMA = "part int, seq int, n_docs long, n_tokens long, file binary"


def write_shards(docs: DataFrame, path: str, *, key: str, text: str, tokenizer: str, end_id: int = 0) -> None:
    """Encode every text, append ``end_id`` to each, and write shards in ascending key order.

    Rows are dealt out by ranges of the key, nulls first; equal keys keep one order by text. A task begins a
    new file after ``SHARD_TOKENS`` ids, so its memory does not follow the partition. Files are the ``file`` column of a
    Parquet table with a row per shard: Spark's commit protocol keeps a file of a failed attempt out, on any store.
    """
    spark = docs.sparkSession
    small_batches(spark, 4096)
    docs = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    total = docs.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(1, -(-total // TASK_BYTES))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, seq = encoder(IdEncoder, tokenizer), TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        keys: list = []
        lengths: list[int] = []
        held = 0

        def flush() -> pa.RecordBatch:
            every = np.concatenate(ids)
            ids.clear()
            blob = WaveletMatrix.build(every, lengths, keys)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([held], pa.int64()), pa.array([blob], pa.binary())],
                ["part", "seq", "n_docs", "n_tokens", "file"],
            )

        for b in batches:
            some, n = enc.encode(b.column("t"), end_id)
            ids.append(some)
            keys += b.column("k").to_pylist()
            lengths += n.tolist()
            held += len(some)
            if held >= SHARD_TOKENS:
                yield flush()
                ids, keys, lengths, held, seq = [], [], [], 0, seq + 1
        if keys:
            yield flush()

    dealt = docs.repartitionByRange(parts, F.col("k").asc_nulls_first()).sortWithinPartitions(F.col("k").asc_nulls_first(), "t")
    dealt.mapInArrow(returning(pack), SHARD_SCHEMA).write.option("compression", "none").parquet(path)


def read_documents(shards: DataFrame, *, key: str, key_type: str = "long") -> DataFrame:
    """For each document of the files: key, start (ids before it in all shards), n_tokens, ids_crc32."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, seq, blob in zip(b.column("part").to_pylist(), b.column("seq").to_pylist(), b.column("file"), strict=True):
                shard = WaveletMatrix(blob.as_py())
                ids, ends = shard.decode().astype("<u4"), np.cumsum(shard.lengths)
                starts = ends - shard.lengths
                crc = [zlib.crc32(ids[x:y]) for x, y in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(crc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()), pa.array(shard.doc_ids).cast(pa.int64()) if n else pa.array([], pa.int64()), pa.array(starts), pa.array(shard.lengths), pa.array(crc, pa.int64())],
                    ["part", "seq", "k", "local", "n_tokens", "ids_crc32"],
                )

    rows = shards.select("part", "seq", "file").mapInArrow(returning(unpack), "part int, seq int, k long, local long, n_tokens long, ids_crc32 long")
    # ids before each shard: within groups of 1024 parts, then over the groups
    small = shards.select("part", "seq", "n_tokens", F.expr("part div 1024").alias("many"))
    inner = Window.partitionBy("many").orderBy("part", "seq")
    outer = Window.orderBy("many")
    many = small.groupBy("many").agg(F.sum("n_tokens").alias("all"))
    many = many.select("many", (F.sum("all").over(outer) - F.col("all")).alias("base"))
    small = small.withColumn("own", F.sum("n_tokens").over(inner) - F.col("n_tokens")).join(many, "many")
    rows = rows.join(small.select("part", "seq", (F.col("base") + F.col("own")).alias("before")), ["part", "seq"])
    return rows.select(F.col("k").cast(key_type).alias(key), (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, *, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 0, path: str | None = None) -> DataFrame:
    """Write a corpus as wavelet shards and return what the files hold for each document.

    Null and empty texts hold the end id alone. Equal keys, repeated rows and null keys keep a row each. An empty table writes no shard and
    returns no rows. Columns other than key and text are ignored.
    """
    spark = docs.sparkSession
    path = path or fresh_path(spark, "wavelet")
    write_shards(docs, path, key=key, text=text, tokenizer=tokenizer, end_id=end_id)
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    return read_documents(shards, key=key, key_type=docs.schema[key].dataType.simpleString())
