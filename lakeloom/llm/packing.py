"""Harmonic packing of token sequences.

Class k holds the lengths in (C/(k+1), C/k] of the capacity C, and a bin of class k takes exactly k documents, whole. Each
task fills its bins by itself: nothing is shuffled. Of a document of more than C tokens, whole sequences are cut off first.

A full bin of class k still has room for less than one document more. That room is closed with tokens of one document
at a time, which is cut for it (the filler): the rest of a document that was cut anyway, else the next one that comes.
So most documents stay whole, and bins have no padding. What is left at a task's end goes, longest first, to the first
bin with room; then the emptiest bins fill the fullest. One sequence of a task at most is padded."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm._util import prepare
from lakeloom.llm.tok import encoder

CAPACITY = 4096


class Bins:
    """The bins of one task. A piece is (id, start, ids, doc_tokens); `put` and `close` return finished rows: (piece, sequence, offset)."""

    def __init__(self, task: int, capacity: int = CAPACITY):
        self.capacity, self.next = capacity, task << 38
        self.open: dict[int, list] = {}
        self.waiting: list[list] = []  # bins with all their documents whose room is not closed
        self.filler = None

    def put(self, i, ids: bytes) -> list:
        """One document."""
        out, at, n = [], 0, len(ids) // 4
        while n - at >= self.capacity:
            out += self._bin([(i, at, ids[4 * at : 4 * (at + self.capacity)], n)])
            at += self.capacity
        if at == n:
            return out
        piece = (i, at, ids[4 * at :], n)
        if self.waiting or at and self.filler is None:
            self.filler = piece
        else:
            k = self.capacity // (n - at)
            held = self.open.setdefault(k, [])
            held.append(piece)
            if len(held) == k:
                self.waiting.append(self.open.pop(k))
        while self.waiting and (self.filler is not None or self._room(self.waiting[0]) == 0):
            self._fill(self.waiting[0])
            if self._room(self.waiting[0]):
                break
            out += self._bin(self.waiting.pop(0))
        return out

    def _room(self, held: list) -> int:
        return self.capacity - sum(len(p[2]) for p in held) // 4

    def _fill(self, held: list) -> None:
        """Moves tokens of the filler into the room of a bin."""
        room = self._room(held)
        if self.filler is not None and room:
            now, self.filler = cut_piece(self.filler, room)
            held.append(now)

    def _bin(self, held: list) -> list:
        at, out = 0, []
        for p in held:
            out.append((p, self.next, at))
            at += len(p[2]) // 4
        self.next += 1
        return out

    def close(self) -> list:
        bins = self.waiting
        pieces = [p for held in self.open.values() for p in held] + [self.filler] * (self.filler is not None)
        room = [self._room(b) for b in bins]
        for p in sorted(pieces, key=lambda p: -len(p[2])):
            n = len(p[2]) // 4
            k = next((k for k, r in enumerate(room) if r >= n), len(bins))
            if k == len(bins):
                bins.append([])
                room.append(self.capacity)
            bins[k].append(p)
            room[k] -= n
        order = sorted(range(len(bins)), key=lambda k: room[k])
        bins, out = [bins[k] for k in order], []
        while bins:
            now = bins.pop(0)
            while bins and (room_now := self._room(now)):
                last = bins[-1]
                first, rest = cut_piece(last.pop(), room_now)
                now.append(first)
                last += [rest] * (rest is not None)
                if not last:
                    bins.pop()
            out += self._bin(now)
        self.open, self.waiting, self.filler = {}, [], None
        return out


def cut_piece(p: tuple, most: int) -> tuple:
    """The first `most` tokens of a piece, and the rest or None."""
    i, at, ids, n = p
    return (i, at, ids[: 4 * most], n), ((i, at + most, ids[4 * most :], n) if len(ids) > 4 * most else None)


def pack_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece: <id_col>, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id and offset.

    A document is its ids and `end_id`; a null or empty text is the end alone. Each row of df is a document of its own,
    ids may be null or repeat; other columns are not read. Sequences have `capacity` tokens, a power of two; the last of a
    task may have fewer and is to be padded."""
    import pyarrow as pa

    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    prepare(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    names = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext

        enc, bins = encoder(path), Bins(TaskContext.get().partitionId(), capacity)
        kind_of = None

        def rows(done):
            for i in range(0, len(done), 4096):
                x = done[i : i + 4096]
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p, _, _ in x], kind_of), pa.array([p[1] for p, _, _ in x], pa.int64()), pa.array([len(p[2]) // 4 for p, _, _ in x], pa.int64()), pa.array([p[2] for p, _, _ in x], pa.binary()), pa.array([p[3] for p, _, _ in x], pa.int64()), pa.array([s for _, s, _ in x], pa.int64()), pa.array([o for _, _, o in x], pa.int64())], names=names)

        for b in batches:
            kind_of, done = b.column(0).type, []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                done += bins.put(i, enc.encode(text) + end)
            yield from rows(done)
        yield from rows(bins.close())

    schema = f"id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
