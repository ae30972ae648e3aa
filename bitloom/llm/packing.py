"""Packing of tokenized documents into sequences of bounded length with balanced attention cost.

The cost of a piece of n tokens is LINEAR * n + QUADRATIC * n * n, for what a transformer layer does with a document
that attends to itself only. Pieces go in descending order of cost to the sequence of the lowest cost that has room. A
piece that no sequence has room for is cut, so that sequences fill up; what is left at the end of a partition becomes
sequences whose lengths are powers of two, which need no padding.

Nothing is shuffled: each task packs its own rows, in windows of WINDOW tokens, and carries what is left to the next.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm import common
from bitloom.llm.words import shared

CAPACITY = 4096
END_ID = 2
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
#: Tokens that a task holds before it packs them.
WINDOW = 1 << 21
#: Texts that are split into words at once, and words whose ids a worker keeps.
TEXTS, CACHED = 64, 1_000_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, sequence_cost double"


class Packer:
    """Packs pieces (doc_id, start, ids, doc_tokens) of one task."""

    def __init__(self, task: int, capacity: int = CAPACITY):
        self.capacity, self.next, self.held, self.tokens = capacity, task << 33, [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.held.append((doc_id, 0, ids, len(ids)))
        self.tokens += len(ids)

    def pack(self, last: bool = False) -> list[tuple]:
        """Rows of the sequences that are full; with last, of all."""
        rows, rest = [], []
        for doc_id, start, ids, total in self.held:
            at = 0
            while len(ids) - at >= self.capacity:
                self._emit([(doc_id, start + at, ids[at : at + self.capacity], total)], rows)
                at += self.capacity
            if at < len(ids):
                rest.append((doc_id, start + at, ids[at:], total))
        rest.sort(key=lambda p: (-len(p[2]), p[0] is None, p[0] or 0, p[1]))
        sizes = np.array([len(p[2]) for p in rest], np.int64)
        n = int(sizes.sum()) // self.capacity
        sequences, cost, room = [[] for _ in range(n)], [0.0] * n, [self.capacity] * n
        open_, wait = [(0.0, k) for k in range(n)], []  # heaps: sequences by cost, and those without room by their room

        def put(k: int, piece: tuple) -> None:
            sequences[k].append(piece)
            cost[k] += _cost(len(piece[2]))
            room[k] -= len(piece[2])
            if room[k]:
                heapq.heappush(open_, (cost[k], k))

        cut = []
        for piece in rest:
            size = len(piece[2])
            while wait and -wait[0][0] >= size:  # pieces get shorter, so that sequences have room again
                k = heapq.heappop(wait)[1]
                heapq.heappush(open_, (cost[k], k))
            while open_ and room[open_[0][1]] < size:
                k = heapq.heappop(open_)[1]
                heapq.heappush(wait, (-room[k], k))
            if open_:
                put(heapq.heappop(open_)[1], piece)
            else:
                cut.append(piece)
        for _, k in wait:
            heapq.heappush(open_, (cost[k], k))
        left = []
        for doc_id, start, ids, total in cut:
            while len(ids) and open_:
                k = heapq.heappop(open_)[1]
                m = min(room[k], len(ids))
                put(k, (doc_id, start, ids[:m], total))
                start, ids = start + m, ids[m:]
            if len(ids):
                left.append((doc_id, start, ids, total))
        for pieces in sequences:
            self._emit(pieces, rows)
        self.held, self.tokens = left, sum(len(p[2]) for p in left)
        if last:
            self._tail(rows)
        return rows

    def _tail(self, rows: list[tuple]) -> None:
        """What is left, under one capacity, as sequences of the powers of two of its length."""
        for bit in reversed(range(self.tokens.bit_length())):
            if not self.tokens >> bit & 1:
                continue
            pieces, room = [], 1 << bit
            while room:
                doc_id, start, ids, total = self.held.pop(0)
                m = min(room, len(ids))
                pieces.append((doc_id, start, ids[:m], total))
                room -= m
                if m < len(ids):
                    self.held.insert(0, (doc_id, start + m, ids[m:], total))
            self._emit(pieces, rows)
        self.held, self.tokens = [], 0

    def _emit(self, pieces: list[tuple], rows: list[tuple]) -> None:
        offset, cost, total = 0, sum(_cost(len(p[2])) for p in pieces), sum(len(p[2]) for p in pieces)
        for doc_id, start, ids, doc_tokens in pieces:
            rows.append((doc_id, start, len(ids), zlib.crc32(ids), doc_tokens, self.next, offset, total, cost))
            offset += len(ids)
        self.next += 1


def _cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the
    tokens and the cost of its sequence.

    A document is its tokenizer ids, then END_ID; each id is in one piece. A null or empty text is END_ID alone. Repeated
    rows are packed as often as they stand there; a null id stays null; other columns are not read. An empty table gives
    no rows. capacity is a power of two.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity is a power of two")
    common.small_batches(docs.sparkSession)
    schema = common.arrow_schema(SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer, end = shared(tokenizer, True, CACHED), Packer(TaskContext.get().partitionId(), capacity), np.array([END_ID], "<u4").tobytes()

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                doc_ids, texts = (batch.column(c).slice(at, TEXTS).to_pylist() for c in (0, 1))
                # the tokenizer drops white space and never joins what it separates
                for doc_id, ids in zip(doc_ids, words.ids([(t or "").encode("utf-8").split() for t in texts]), strict=True):
                    packer.add(doc_id, np.frombuffer(ids + end, "<u4"))
                if packer.tokens >= WINDOW and (rows := packer.pack()):
                    yield out(rows)
        if rows := packer.pack(last=True):
            yield out(rows)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)
