"""Packing: best-fit decreasing into windows of a fixed number of tokens."""

from __future__ import annotations

import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import written
from .tokens import WordMemoTokenizer, loaded
from .words import give_back

WINDOW = 2048
EOS = 1
#: Pieces that one task packs; the number of tasks follows the number of pieces.
PIECES_A_TASK = 65_536
#: A sequence number holds its task's bucket above so many bits.
BUCKET_BITS = 24

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class TightestWindow:
    """A segment tree over remaining capacities 0..window; a leaf holds the open windows with that much room.

    A node tells whether any leaf under it has a window, so the tightest open window that fits a piece is found by one climb
    and one descent.
    """

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.any = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def _mark(self, room: int, by: int) -> None:
        node = room + self.size
        while node:
            self.any[node] += by
            node >>= 1

    def add(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        self._mark(room, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """Removes and returns (room, sequence) of the tightest window with at least this room, or None."""
        node = length + self.size
        if not self.any[node]:
            while node > 1 and not (node % 2 == 0 and self.any[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.any[2 * node] else 2 * node + 1
        room = node - self.size
        self._mark(room, -1)
        return room, self.open[room].pop()


def best_fit_decreasing(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """For lengths in decreasing order, each piece's sequence (0, 1, ...) and offset."""
    tree, sequences, offsets, made = TightestWindow(window), [], [], 0
    for length in lengths:
        room, sequence = tree.take(length) or (window, made)
        made += sequence == made
        sequences.append(sequence)
        offsets.append(window - room)
        if room > length:
            tree.add(room - length, sequence)
    return sequences, offsets


def cut_pieces(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, eos: int = EOS) -> DataFrame:
    """One row for each piece of a document: whole windows first, then what remains; every id lies in one piece."""

    def cut(batches):
        t = loaded(WordMemoTokenizer, tokenizer)
        give_back()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows: list[tuple] = []
                for key, ids in zip(part.column(0).to_pylist(), t.encode(part.column(1).to_pylist()), strict=True):
                    ids += eos.to_bytes(4, "little")
                    n = len(ids) // 4
                    rows += [(key, s, min(window, n - s), zlib.crc32(ids[4 * s : 4 * (s + window)]), n) for s in range(0, n, window)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        t.memo.clear()  # the worker process may go on to other tasks
        give_back()

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(cut, PIECES)


def pack_pieces(pieces: DataFrame, window: int = WINDOW, pieces_a_task: int = PIECES_A_TASK) -> DataFrame:
    """Adds sequence_id and offset: best-fit decreasing inside buckets of a bounded number of pieces, dealt by hash.

    Buckets are balanced whatever the documents, and the result depends only on the rows. A bucket's last, emptiest sequence
    is the only one that a larger bucket could have filled better.
    """
    buckets = max(1, -(-pieces.count() // pieces_a_task))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        sequences, offsets = best_fit_decreasing(pdf["length"].tolist(), window)
        base = int(pdf["bucket"].iloc[0]) << BUCKET_BITS
        return pdf.drop(columns="bucket").assign(sequence_id=[base + s for s in sequences], offset=offsets)

    bucket = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets))
    return pieces.withColumn("bucket", bucket).groupBy("bucket").applyInPandas(pack, f"{PIECES}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, eos: int = EOS, pieces_a_task: int = PIECES_A_TASK) -> DataFrame:
    """Packs all documents into sequences of at most `window` tokens by best-fit decreasing.

    A document is its text's ids followed by `eos`. Documents longer than a window are first cut into full windows; what
    remains of each is one piece, and goes to the open window with the least room that still holds it. Only the pieces'
    numbers are shuffled, never texts or ids.

    A null or empty text is the one id `eos`. A null doc_id stays null; ids are whole numbers, and a text that is none stops the run. Repeated rows are packed once each. Pieces of equal
    length are taken in order of doc_id and start. An empty table gives no rows. Other columns are not read.
    """
    return pack_pieces(written(cut_pieces(docs, tokenizer, doc_id, text, window, eos), "pieces"), window, pieces_a_task)
