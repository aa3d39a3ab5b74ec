"""Hierarchical multi-length packing of tokenised documents.

The result holds the token ids of every piece, so the sequences can be trained on as they are.  Every task packs
the documents of its own partition, so no text or id is shuffled and an executor's loss costs only its own
partitions' work.  A document's full windows are sequences of their own.  Its tail is routed
to the smallest context size (tier) that holds it.  The longest waiting tail opens a window of its tier;
shorter tails fill the gap, largest first, and the last one is cut where the window ends.  So windows of
all tiers are full; at most one sequence a partition, under the smallest tier, needs padding.  The
written windows of one tier are numbered over all partitions, from counts, and dealt in that order to step groups of
`step_tokens` tokens; only the last group of each tier is short, by less than that.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_arrow_batches, raw_bytes, written
from .word_bpe import shared_pieces

TIERS = (256, 512, 1024, 2048)
#: `ids` are the piece's token ids, four bytes each, little-endian: np.frombuffer(ids, "<u4").
SCHEMA = "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
#: What the tasks give out: `part` is their partition, `at` a sequence's number in its partition and tier.
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, part int, at long"


class Packer:
    """Packs (doc_id, start, doc_tokens, ids) pieces; `out` collects rows of PIECES."""

    def __init__(self, part: int, tiers: tuple[int, ...], waiting: int):
        self.part, self.tiers, self.limit = part, tiers, waiting
        self.window, self.sequences, self.number = tiers[-1], 0, 0
        self.steps = dict.fromkeys(tiers, 0)
        self.waiting: list[tuple[int, int]] = []  # (length, key), sorted
        self.pieces: dict[int, tuple] = {}
        self.tokens = 0
        self.out: list[tuple] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        total, at = len(ids) // 4, 0
        while total - at >= self.window:
            self.emit([(doc_id, at, total, ids[4 * at : 4 * (at + self.window)])], self.window)
            at += self.window
        if at < total:
            self.wait((doc_id, at, total, ids[4 * at :]))
        if len(self.waiting) >= self.limit:
            self.pack()

    def wait(self, piece: tuple) -> None:
        self.pieces[self.number] = piece
        insort(self.waiting, (len(piece[3]) // 4, self.number))
        self.tokens += len(piece[3]) // 4
        self.number += 1

    def take(self, index: int) -> tuple:
        length, key = self.waiting.pop(index)
        self.tokens -= length
        return self.pieces.pop(key)

    def tier(self, length: int) -> int:
        return self.tiers[bisect_left(self.tiers, length)]

    def fill(self, chosen: list[tuple], gap: int) -> None:
        """Add waiting pieces to `chosen` until the gap is closed; enough tokens must be waiting."""
        while gap:
            fits = bisect_right(self.waiting, (gap, float("inf")))
            piece = self.take(fits - 1 if fits else 0)
            length = len(piece[3]) // 4
            if length > gap:
                doc_id, start, total, ids = piece
                piece = (doc_id, start, total, ids[: 4 * gap])
                self.wait((doc_id, start + gap, total, ids[4 * gap :]))
                length = gap
            chosen.append(piece)
            gap -= length

    def pack(self) -> None:
        while self.waiting:
            longest = self.waiting[-1][0]
            tier = self.tier(longest)
            if self.tokens < tier:
                return
            chosen = [self.take(-1)]
            self.fill(chosen, tier - longest)
            self.emit(chosen, tier)

    def finish(self) -> None:
        self.pack()
        for tier in reversed(self.tiers):
            while self.tokens >= tier:
                chosen: list[tuple] = []
                self.fill(chosen, tier)
                self.emit(chosen, tier)
        if self.tokens:
            chosen = []
            self.fill(chosen, self.tokens)
            self.emit(chosen, self.window)

    def emit(self, chosen: list[tuple], tier: int) -> None:
        sequence, offset = (self.part << 33) + self.sequences, 0
        for doc_id, start, total, ids in chosen:
            length = len(ids) // 4
            self.out.append((doc_id, start, length, ids, total, sequence, offset, tier, self.part, self.steps[tier]))
            offset += length
        self.sequences += 1
        self.steps[tier] += 1


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    tiers: tuple[int, ...] = TIERS,
    end_id: int = 1,
    step_tokens: int = 65536,
    waiting: int = 2048,
) -> DataFrame:
    """One row per piece of a document in a packed sequence (SCHEMA).

    A null text is empty and yields the end id alone.  Repeated rows are packed once each; a null doc_id
    stays null.  Texts of any length are cut into windows.  Columns besides doc_id and text are ignored.
    An empty table gives no rows.  Sequence and step-group ids are unique over partitions.  `tiers` are
    ascending powers of two; `step_tokens` is a multiple of the largest; `waiting` bounds the tails a task
    holds.  The tokenizer file must be readable by that path on every machine.
    """
    bounded_arrow_batches(docs.sparkSession)
    types = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.int64()]
    names = [x.split()[0] for x in PIECES.split(", ")]
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, pieces = Packer(TaskContext.get().partitionId(), tiers, waiting), shared_pieces(tokenizer_path)

        def rows() -> Iterator[pa.RecordBatch]:
            """What has been packed, at most 4,096 pieces (32 MiB of ids for windows of 2,048) to a batch."""
            for at in range(0, len(packer.out), 4096):
                columns = zip(*packer.out[at : at + 4096], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=names)
            packer.out.clear()

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), raw_bytes(batch.column(1)), strict=True):
                packer.add(doc_id, pieces.encode(text) + end)
                if len(packer.out) >= 4096:
                    yield from rows()
            yield from rows()
        packer.finish()
        yield from rows()

    packed = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, PIECES)
    return step_groups(written(packed, "packed"), tiers, step_tokens)


def step_groups(packed: DataFrame, tiers: tuple[int, ...], step_tokens: int) -> DataFrame:
    """SCHEMA of written PIECES.  Only counts, one row a partition and tier, are exchanged and broadcast."""
    before = Window.partitionBy("tier").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = packed.groupBy("tier", "part").agg((F.max("at") + 1).alias("n"))
    first = counts.select("tier", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    step = F.floor((F.col("first") + F.col("at")) * F.col("tier") / step_tokens).cast("long")
    group = step * len(tiers) + F.array_position(F.array(*map(F.lit, tiers)), F.col("tier")) - 1
    named = packed.join(F.broadcast(first), ["tier", "part"]).withColumns({"step_group": group, "ids_crc32": F.crc32("ids")})
    return named.select([x.split()[0] for x in SCHEMA.split(", ")])
