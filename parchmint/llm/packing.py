"""Packing token sequences into windows by Karmarkar-Karp multiway differencing.

Every document is tokenised whole and ends with ``end_id``. Stretches of a full window go to windows of their own; what
is left of each document is cut into parts of at most an eighth of a window, and a block of parts is dealt to k windows by
differencing: partial partitions (k sums each) wait in a heap by their imbalance, the two most imbalanced are merged
with opposing order (largest sum onto smallest), until one partition with nearly equal sums is left. Where a sum exceeds
the capacity the window count k rises by one and the block is dealt again.

A block holds ``block_windows`` windows; its last part is cut so that the parts fill them up to ``slack`` ids a window,
and the rest opens the next block. Each partition packs its own rows, so nothing is shuffled, a lost partition is packed
again by itself, and memory is that of one block and one document.

Cases: a null or empty text is the end id alone; repeated rows are packed one by one; rows with a null doc_id keep it;
an empty table gives an empty result; other columns are dropped before the kernel.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame

from parchmint.llm.shared import narrow_batches

CAPACITY = 2048
BLOCK_WINDOWS = 64
#: Ids left free in each window of a full block, which the differencing may use up for unequal sums.
SLACK = 14
#: Pieces (some 1 to 8 KB each) that leave a task at a time.
OUT_ROWS = 500
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(n, pa.binary() if n == "ids" else pa.int64()) for n in ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")])


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp k-way differencing: indices of ``sizes`` in k groups of nearly equal sum.

    Ties are broken by the order in which partitions were made, so the result depends on the input order only.
    """
    if k == 1:
        return [list(range(len(sizes)))]
    # an entry: (-imbalance, made, sums from the largest down less the smallest, members of each sum)
    heap = [(-s, i, [s] + [0] * (k - 1), [[i]] + [[] for _ in range(k - 1)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    made = len(heap)
    while len(heap) > 1:
        _, _, a, in_a = heapq.heappop(heap)
        _, _, b, in_b = heapq.heappop(heap)
        b.reverse()
        in_b.reverse()
        sums = [x + y for x, y in zip(a, b, strict=True)]
        order = sorted(range(k), key=sums.__getitem__, reverse=True)
        low = sums[order[-1]]
        merged = [in_a[j] + in_b[j] for j in order]
        heapq.heappush(heap, (low - sums[order[0]], made, [sums[j] - low for j in order], merged))
        made += 1
    return heap[0][3] if heap else [[] for _ in range(k)]


def deal(sizes: list[int], capacity: int) -> list[list[int]]:
    """Groups of indices whose sums stay within ``capacity``; the count starts at the least possible and rises."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        groups = difference(sizes, k)
        if all(sum(sizes[i] for i in g) <= capacity for g in groups):
            return [g for g in groups if g]
        k += 1


class _Packer:
    def __init__(self, capacity: int, block_windows: int, slack: int, first_id: int):
        self.capacity, self.part = capacity, max(1, capacity // 8)
        self.room = block_windows * max(1, capacity - slack)
        self.next_id, self.parts, self.held = first_id, [], 0
        self.out: list[tuple] = []

    def _emit(self, doc, start: int, ids: bytes, total: int, sequence: int, offset: int) -> None:
        self.out.append((doc, start, len(ids) // 4, ids, total, sequence, offset))

    def add(self, doc, ids: bytes) -> None:
        total, at, step = len(ids) // 4, 0, self.capacity
        while total - at >= step:
            self._emit(doc, at, ids[4 * at : 4 * (at + step)], total, self.next_id, 0)
            self.next_id += 1
            at += step
        while at < total:
            n = min(self.part, total - at, self.room - self.held)
            self.parts.append((doc, at, ids[4 * at : 4 * (at + n)], total))
            self.held += n
            at += n
            if self.held == self.room:
                self.flush()

    def flush(self) -> None:
        for group in deal([len(p[2]) // 4 for p in self.parts], self.capacity) if self.parts else ():
            offset = 0
            for i in sorted(group):
                doc, start, ids, total = self.parts[i]
                self._emit(doc, start, ids, total, self.next_id, offset)
                offset += len(ids) // 4
            self.next_id += 1
        self.parts, self.held = [], 0

    def drain(self) -> pa.RecordBatch:
        rows, self.out = self.out, []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def _kernel(batches: Iterator[pa.RecordBatch], path: str, end_id: int, capacity: int, block_windows: int, slack: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    from parchmint.llm.shared import sliced
    from parchmint.llm.tokens import tokenizer

    encode = tokenizer(path).encode
    packer = _Packer(capacity, block_windows, slack, TaskContext.get().partitionId() << 40)
    for batch in sliced(batches, 1):
        for doc, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist(), end_id), strict=True):
            packer.add(doc, ids)
            if len(packer.out) >= OUT_ROWS:
                yield packer.drain()
    packer.flush()
    if packer.out:
        yield packer.drain()


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY, block_windows: int = BLOCK_WINDOWS, slack: int = SLACK) -> DataFrame:
    """One row per piece: its document, its place there, its ids (little-endian unsigned 32-bit), its window and offset.

    ``sequence_id`` is the partition's number times 2^40 plus a count, so it is unique without any exchange.
    """
    narrow_batches(docs.sparkSession)
    kernel = partial(_kernel, path=tokenizer_path, end_id=end_id, capacity=capacity, block_windows=block_windows, slack=slack)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(kernel, SCHEMA)
