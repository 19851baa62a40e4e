"""Token-id output: documents packed into rows of one length by best-fit-decreasing.

Documents are encoded and cut into pieces of a row's length at most, nothing is lost. A task
gathers pieces up to a bounded number of tokens, sorts them by falling length and puts each
into the open row with the least room that still holds it; a segment tree over the amounts
of room finds that row in a logarithmic number of steps. Rows never mix the pieces of two
such blocks, so packing needs no shuffle and a block's memory is bounded.

A packed row has its ids as a little-endian binary matrix row, padded at the end, the
cumulative lengths of its segments, and the places where positions start again from 0.
Segments name their document, the row of the input (as ids may repeat) and the number of
the piece. Null and empty texts have no tokens and no segment; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subsumo.llm.bpe import VOCABULARY, codec
from subsumo.llm.common import Query, pieces, table, text_bytes

#: Tokens of a packed row; tokens that a task packs at a time; id of the padding.
LENGTH, BLOCK_TOKENS, PAD = 2048, 2_000_000, 0


class Room:
    """Open rows by the room they have left: a segment tree of counts over 0 .. length."""

    def __init__(self, length: int):
        self.leaves = 1 << length.bit_length()
        self.counts = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._change(room, 1)

    def _change(self, room: int, by: int) -> None:
        at = self.leaves + room
        while at:
            self.counts[at] += by
            at >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """Room and row of the open row with the least room of at least `size`, which is removed."""
        at = self.leaves + size
        if not self.counts[at]:
            # Up to the first ancestor that is a left child with something to its right, then down on the left.
            while at > 1 and (at & 1 or not self.counts[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.counts[2 * at] else 2 * at + 1
        room = at - self.leaves
        self._change(room, -1)
        return room, self.rows[room].pop()


def best_fit_decreasing(sizes: Sequence[int], length: int = LENGTH) -> list[list[int]]:
    """Rows of indexes into sizes (1 .. length), each of at most `length` in sum."""
    rows: list[list[int]] = []
    open_rows = Room(length)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = open_rows.take(sizes[i])
        room, row = found if found else (length, len(rows))
        if not found:
            rows.append([])
        rows[row].append(i)
        if room > sizes[i]:
            open_rows.add(room - sizes[i], row)
    return rows


def pack_documents(
    documents: DataFrame, *, length: int = LENGTH, block_tokens: int = BLOCK_TOKENS, vocabulary: str = VOCABULARY, pad: int = PAD,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """Packed rows: pack_id, ids (binary), cu_seqlens, resets, doc_ids, doc_rows, parts."""
    id_type = documents.schema[id_column].dataType.simpleString()
    schema = (
        f"pack_id bigint, ids binary, cu_seqlens array<int>, resets array<int>, doc_ids array<{id_type}>, "
        "doc_rows array<bigint>, parts array<int>"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        kind = np.dtype("<u2" if own.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        # Packed rows of a partition follow its number.
        number = TaskContext.get().partitionId() << 33
        waiting: list[tuple] = []
        held, id_arrow = 0, None

        def packed() -> pa.RecordBatch:
            nonlocal number
            rows = best_fit_decreasing([len(ids) for _, _, _, ids in waiting], length)
            columns: list[list] = [[] for _ in range(7)]
            for row in rows:
                segments = [waiting[i] for i in row]
                ends = np.cumsum([len(ids) for *_, ids in segments], dtype=np.int32)
                matrix = np.full(length, pad, kind)
                matrix[: ends[-1]] = np.concatenate([ids for *_, ids in segments])
                cumulative = np.concatenate([np.zeros(1, np.int32), ends])
                doc_ids, doc_rows, parts, _ = zip(*segments)
                for column, value in zip(columns, (number, matrix.tobytes(), cumulative, cumulative[:-1], doc_ids, doc_rows, parts)):
                    column.append(value)
                number += 1
            kinds = [pa.int64(), pa.binary(), *[pa.list_(pa.int32())] * 2, pa.list_(id_arrow), pa.list_(pa.int64()), pa.list_(pa.int32())]
            names = ["pack_id", "ids", "cu_seqlens", "resets", "doc_ids", "doc_rows", "parts"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for batch in pieces(batches):
            id_arrow = batch.schema.field(0).type
            for doc_id, row, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                ids = np.asarray(own.encode(text.decode("utf-8", "replace")), kind)
                for part, start in enumerate(range(0, len(ids), length)):
                    waiting.append((doc_id, row, part, ids[start : start + length]))
                held += len(ids)
                if held >= block_tokens:
                    yield packed()
                    waiting, held = [], 0
        if waiting:
            yield packed()

    columns = [F.col(id_column).alias("doc_id"), F.monotonically_increasing_id().alias("row"), text_bytes(text_column).alias("text")]
    return documents.select(*columns).mapInArrow(run, schema)


def position_ids(resets: Sequence[int], length: int = LENGTH) -> np.ndarray:
    """Positions of a packed row: from 0 again at every reset."""
    starts = np.zeros(length, np.int64)
    starts[list(resets)] = list(resets)
    return np.arange(length) - np.maximum.accumulate(starts)


QUERIES = {"op8_packed_tokens": Query(lambda spark, sf: pack_documents(table(spark, sf, "documents")))}
