"""Token ids as wavelet matrices, one compressed file record per shard.

Documents are dealt by doc_id ranges, sorted, tokenised whole, and each run of about ``shard_tokens`` ids becomes one
shard: a wavelet matrix (one bit-plane per id bit, most significant first; in each plane zeros are moved stably before
ones for the next) and the table of its documents. Planes are cut into blocks of ``BLOCK`` bytes, each a zstd frame of its
own, with the ones before each block and the end of its frame in a directory: access, rank (counting) and select
(occurrence lookup) open one or two blocks a plane, not the record.

A record, all numbers little-endian::

    magic "PMWM", version u16, levels u16, tokens u64, documents u64, bytes of the document table u64
    zeros of each level u64[levels]
    per level, for each block: ones before it u64[blocks], then end of its frame after the first frame's start u64[blocks]
    the document table, a zstd frame: doc_id i64[documents], null marks u8[documents], token counts u64[documents]
    the frames of all blocks, level by level

Records are rows of a Parquet folder (one file per range of doc_id), so any store Spark writes to will do and a lost
task is written again by Spark's committer. ``WaveletMatrix`` answers from a record without restoring the ids; ``decode``
restores them all.

Cases: null and empty texts are the end id alone; rows with equal doc_id follow by the hash of their text, equal rows
side by side; null doc_ids come first; an empty table writes no record and reads back as no row; other columns are
dropped before the kernel.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmint.llm.shared import narrow_batches

MAGIC, VERSION = b"PMWM", 2
#: Bytes of a plane in one frame.
BLOCK = 4096
BITS = 8 * BLOCK
#: Open blocks a matrix keeps.
OPEN_BLOCKS = 256
_HEAD = struct.Struct("<4sHHQQQ")
SHARD_TOKENS = 1 << 21
#: Records whose places (some 30 bytes each) are broadcast; those of more are joined by shuffling.
BROADCAST_RECORDS = 200_000
RECORD = "part long, shard long, first_doc long, documents long, tokens long, record binary"
_RECORD = pa.schema([("part", pa.int64()), ("shard", pa.int64()), ("first_doc", pa.int64()), ("documents", pa.int64()), ("tokens", pa.int64()), ("record", pa.binary())])
TOKENS = "doc_id long, start long, n_tokens long, ids binary"
_TOKENS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


class WaveletMatrix:
    """Bit-planes with rank/select over a sequence of unsigned ids; ``frames[level][block]`` are compressed plane bytes."""

    def __init__(self, n: int, zeros: list[int], ones: np.ndarray, frames: list[list[bytes]]):
        self.n, self.zeros, self.ones, self.frames, self.levels = n, zeros, ones, frames, len(zeros)
        self.inflated = 0  # bytes of planes opened so far
        self._open: dict[tuple[int, int], np.ndarray] = {}

    @classmethod
    def build(cls, ids: np.ndarray, levels: int) -> WaveletMatrix:
        import zstandard

        now, pack = ids.astype(np.uint16 if levels <= 16 else np.uint32), zstandard.ZstdCompressor(level=1).compress
        blocks = -(-len(ids) // BITS)
        zeros, ones, frames = [], np.zeros((levels, blocks), "<u8"), []
        for level in range(levels):
            bit = (now >> (levels - 1 - level) & 1).astype(bool)
            plane = np.packbits(bit, bitorder="little")
            counts = np.add.reduceat(np.bitwise_count(plane), np.arange(0, len(plane), BLOCK), dtype=np.uint64) if blocks else np.zeros(0, np.uint64)
            ones[level, 1:] = np.cumsum(counts)[:-1]
            zeros.append(len(now) - int(counts.sum()))
            frames.append([pack(plane[b * BLOCK : (b + 1) * BLOCK].tobytes()) for b in range(blocks)])
            now = np.concatenate((now.compress(~bit), now.compress(bit)))
        return cls(len(ids), zeros, ones, frames)

    def _block(self, level: int, b: int) -> np.ndarray:
        found = self._open.get((level, b))
        if found is None:
            import zstandard

            found = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.frames[level][b]), np.uint8)
            self.inflated += len(found)
            if len(self._open) >= OPEN_BLOCKS:
                self._open.clear()
            self._open[level, b] = found
        return found

    def _rank(self, level: int, i: int) -> int:
        """Ones of a plane before position i."""
        if i >= self.n:
            return self.n - self.zeros[level]
        b, rest = divmod(i, BITS)
        count, plane = int(self.ones[level, b]), self._block(level, b)
        count += int(np.bitwise_count(plane[: rest // 8]).sum())
        return count + ((int(plane[rest // 8]) & ((1 << rest % 8) - 1)).bit_count() if rest % 8 else 0)

    def _bit(self, level: int, i: int) -> int:
        b, rest = divmod(i, BITS)
        return int(self._block(level, b)[rest // 8]) >> rest % 8 & 1

    def access(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.levels):
            bit, ones = self._bit(level, i), self._rank(level, i)
            value = value << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return value

    def _range(self, token: int, end: int) -> tuple[int, int]:
        """Where the occurrences of a token before ``end`` stand below the last plane."""
        start = 0
        for level in range(self.levels):
            a, b = self._rank(level, start), self._rank(level, end)
            if token >> (self.levels - 1 - level) & 1:
                start, end = self.zeros[level] + a, self.zeros[level] + b
            else:
                start, end = start - a, end - b
        return start, end

    def rank(self, token: int, end: int | None = None) -> int:
        """Occurrences of a token before position ``end`` (all by default)."""
        if token < 0 or token >> self.levels or not self.n:
            return 0
        start, stop = self._range(token, self.n if end is None else min(end, self.n))
        return stop - start

    def _find(self, level: int, bit: int, k: int) -> int:
        """The position of the k-th (from 0) such bit of a plane."""
        before = self.ones[level].astype(np.int64)
        if not bit:
            before = np.arange(len(before), dtype=np.int64) * BITS - before
        b = int(np.searchsorted(before, k, "right")) - 1
        bits = np.unpackbits(self._block(level, b), bitorder="little")
        return b * BITS + int(np.flatnonzero(bits == bit)[k - int(before[b])])

    def select(self, token: int, k: int) -> int:
        """The position of the k-th (from 0) occurrence of a token; -1 if there are fewer."""
        if k < 0 or k >= self.rank(token):
            return -1
        at = self._range(token, self.n)[0] + k
        for level in range(self.levels - 1, -1, -1):
            bit = token >> (self.levels - 1 - level) & 1
            at = self._find(level, bit, at - self.zeros[level] if bit else at)
        return at

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.rank(token))]

    def decode(self) -> np.ndarray:
        """All ids, from the last plane up: each plane tells which of the values below were zeros and which ones."""
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        now = np.zeros(self.n, np.uint16 if self.levels <= 16 else np.uint32)
        for level in range(self.levels - 1, -1, -1):
            plane = np.frombuffer(b"".join(map(unpack, self.frames[level])), np.uint8)
            bit = np.unpackbits(plane, count=self.n, bitorder="little").astype(bool)
            up, z = np.empty_like(now), self.zeros[level]
            up[np.flatnonzero(~bit)] = now[:z]
            up[np.flatnonzero(bit)] = now[z:] | np.asarray(1 << (self.levels - 1 - level), now.dtype)
            now = up
        return now.astype("<u4")


def write_record(doc_ids: list[int | None], counts: list[int], ids: np.ndarray, levels: int) -> bytes:
    import zstandard

    w = WaveletMatrix.build(ids, levels)
    table = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array([d is None for d in doc_ids], "u1").tobytes() + np.array(counts, "<u8").tobytes()
    table = zstandard.ZstdCompressor(level=1).compress(table)
    ends = np.cumsum([len(f) for level in w.frames for f in level]).astype("<u8").reshape(w.ones.shape)
    body = [_HEAD.pack(MAGIC, VERSION, levels, len(ids), len(doc_ids), len(table)), np.array(w.zeros, "<u8").tobytes()]
    body += [x.tobytes() for level in range(levels) for x in (w.ones[level], ends[level])]
    return b"".join([*body, table, *(f for level in w.frames for f in level)])


def read_record(record: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """The documents of a record, their token counts, and the wavelet matrix of their ids, its blocks still compressed."""
    import zstandard

    magic, version, levels, n, docs, table_size = _HEAD.unpack_from(record)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a token shard of this version")
    blocks, at = -(-n // BITS), _HEAD.size
    zeros = np.frombuffer(record, "<u8", levels, at).tolist()
    at += 8 * levels
    directory = np.frombuffer(record, "<u8", 2 * levels * blocks, at).reshape(levels, 2, blocks)
    at += directory.nbytes
    table = zstandard.ZstdDecompressor().decompress(record[at : at + table_size])
    names, nulls, counts = np.frombuffer(table, "<i8", docs), np.frombuffer(table, "u1", docs, 8 * docs), np.frombuffer(table, "<u8", docs, 9 * docs)
    at += table_size
    ends = [at, *(at + directory[:, 1].reshape(-1).astype(np.int64)).tolist()]
    frames = [[record[ends[i] : ends[i + 1]] for i in range(level * blocks, (level + 1) * blocks)] for level in range(levels)]
    doc_ids = [None if null else d for d, null in zip(names.tolist(), nulls.tolist(), strict=True)]
    return doc_ids, counts.astype(np.int64), WaveletMatrix(n, zeros, directory[:, 0], frames)


def _encode(batches: Iterator[pa.RecordBatch], path: str, end_id: int, levels: int, shard_tokens: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    from parchmint.llm.shared import sliced
    from parchmint.llm.tokens import tokenizer

    encode, part, shard = tokenizer(path).encode, TaskContext.get().partitionId(), 0
    docs, pieces, held = [], [], 0

    def flush() -> pa.RecordBatch:
        nonlocal docs, pieces, held, shard
        ids = np.frombuffer(b"".join(pieces), "<u4")
        if len(ids) and int(ids.max()) >> levels:
            raise ValueError(f"a token id needs more than {levels} bits")
        record = write_record(docs, [len(p) // 4 for p in pieces], ids, levels)
        row = [part, shard, docs[0], len(docs), len(ids), record]
        docs, pieces, held, shard = [], [], 0, shard + 1
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _RECORD, strict=True)], schema=_RECORD)

    for batch in sliced(batches, 1):
        for doc, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist(), end_id), strict=True):
            if pieces and held + len(ids) // 4 > shard_tokens:
                yield flush()
            docs.append(doc)
            pieces.append(ids)
            held += len(ids) // 4
    if pieces:
        yield flush()


def write_token_shards(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, levels: int = 16, shard_tokens: int = SHARD_TOKENS) -> None:
    """Writes the records of all documents, in ascending doc_id order over parts and shards."""
    spark = docs.sparkSession
    narrow_batches(spark)
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    tie = F.xxhash64("text")
    dealt = rows.repartitionByRange(n, "doc_id", tie).sortWithinPartitions("doc_id", tie)
    kernel = partial(_encode, path=tokenizer_path, end_id=end_id, levels=levels, shard_tokens=shard_tokens)
    dealt.mapInArrow(kernel, RECORD).write.option("compression", "none").parquet(path)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for base, record in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            doc_ids, counts, matrix = read_record(record.as_py())
            ids, ends = matrix.decode().tobytes(), np.cumsum(counts)
            starts = ends - counts
            pieces = [ids[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            columns = [pa.array(doc_ids, pa.int64()), pa.array(starts + base), pa.array(counts), pa.array(pieces, pa.binary())]
            out = pa.RecordBatch.from_arrays(columns, schema=_TOKENS)
            for i in range(0, len(out), 2000):
                yield out.slice(i, 2000)


def read_token_shards(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the records: its ids and how many ids all documents before it have.

    The ids before each record are summed from the records' counts: over parts (one row each) and within a part.
    """
    from pyspark.sql import Window

    records = spark.read.schema(RECORD).parquet(path)
    parts = records.groupBy("part").agg(F.sum("tokens").alias("in_part"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("in_part").over(before), F.lit(0)).alias("before_part"))
    earlier = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sizes = records.select("part", "shard", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("in_part_before"))
    # a row per record of a few megabytes, without its bytes: the count is the input over the shard size
    bases = sizes.join(parts, "part").select("part", "shard", (F.col("before_part") + F.col("in_part_before")).alias("base"))
    if records.count() <= BROADCAST_RECORDS:
        bases = F.broadcast(bases)  # the records needn't be dealt a second time
    return records.join(bases, ["part", "shard"]).select("base", "record").mapInArrow(_decode, TOKENS)
