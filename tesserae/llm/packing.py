"""Best-fit packing of token sequences by exact-complement hashing.

Documents become token pieces of at most ``capacity`` ids. Only the number of pieces
of each length (at most ``capacity`` numbers, whatever the corpus holds) decides the
plan, so the plan is made on the driver:

1. sums of one, two and three lengths are kept in hash tables, under the numbers of pieces
   that are still there; going down from the longest length, what exactly fills the gap is
   looked up and used up in bulk;
2. the rest is packed best-fit decreasing, in bulk as well.

A plan is a list of bin contents with a number of copies. Each piece finds its place
by its rank among the pieces of its length. Ranks are counted in two levels (length
and salt, then rows), so that a length which a third of all pieces share is spread
over ``SALTS`` tasks.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm.common import materialise, narrowed
from tesserae.llm.tokens import word_tokenizer

CAPACITY = 2048
#: Parts of one length class; the driver reads at most CAPACITY * SALTS counts.
SALTS = 128

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every whole document: its ids and then ``end_id``, cut every ``capacity`` ids.

    A null or empty text gives one piece that holds ``end_id`` alone. Rows that are
    repeated, or have a null id, give pieces of their own. One row per piece: doc_id,
    piece, start, length and the CRC-32 of its ids as little-endian 32-bit numbers.
    """

    def pieces(batches):
        tok = word_tokenizer(tokenizer)
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), ([], [], [], [], [])
            for doc_id, text in zip(ids, batch.column(1), strict=True):
                data = tok.ids(text.as_py() or b"") + end
                for n, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    for column, value in zip(out, (doc_id, n, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(out, kinds, strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = narrowed(docs, doc_id=id_col, text=text_col)
    return rows.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(pieces, PIECES)


class Sums:
    """Hash tables from a sum to the pairs and triples of lengths that make it, under ``left[length]`` pieces.

    A pair is kept as its smaller length, ascending, a triple as its longest, descending; what
    remains is a pair. ``left`` only falls, so an entry whose lengths have run out is passed over
    for good. The tables are arrays: some 8 MB at a capacity of 2048.
    """

    def __init__(self, left: np.ndarray, capacity: int):
        self.left = left
        there = left > 0
        lengths = np.flatnonzero(there)
        self.pairs: dict[int, np.ndarray] = {}
        self.triples: dict[int, np.ndarray] = {}
        paired = np.zeros(capacity + 1, bool)
        for total in range(2, capacity + 1):
            small = lengths[: np.searchsorted(lengths, total // 2, "right")]
            small = small[there[total - small]]
            if len(small):
                self.pairs[total], paired[total] = small.astype(np.int32), True
        for total in range(3, capacity + 1):
            # The longest of three is a third of their sum at least.
            longest = lengths[np.searchsorted(lengths, -(-total // 3)) : np.searchsorted(lengths, total - 2, "right")]
            longest = longest[paired[total - longest]]
            if len(longest):
                self.triples[total] = longest[::-1].astype(np.int32)
        self.passed: dict[tuple[int, int], int] = defaultdict(int)

    def _fits(self, *lengths: int) -> bool:
        return all(self.left[x] >= lengths.count(x) for x in lengths)

    def _pair(self, total: int, *others: int, most: int) -> tuple[int, int] | None:
        """The most unequal two lengths of that sum, none above ``most``, that are there beside the others."""
        held, key = self.pairs.get(total, ()), (2, total)
        for i in range(self.passed[key], len(held)):
            small = int(held[i])
            if not self._fits(total - small, small):
                self.passed[key] += i == self.passed[key]
            elif total - small <= most and self._fits(total - small, small, *others):
                return total - small, small
        return None

    def fill(self, gap: int, length: int) -> tuple[int, ...] | None:
        """The fewest lengths, three at most, that fill ``gap`` beside a piece of ``length``."""
        if gap == 0:
            return ()
        if self._fits(gap, length):
            return (gap,)
        found = self._pair(gap, length, most=gap)
        if found:
            return found
        held, key = self.triples.get(gap, ()), (3, gap)
        for i in range(self.passed[key], len(held)):
            longest = int(held[i])
            if not self.left[longest]:
                self.passed[key] += i == self.passed[key]
            elif self._fits(longest, length):
                found = self._pair(gap - longest, longest, length, most=longest)
                if found:
                    return (longest, *found)
        return None


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Bins for ``counts[length]`` pieces of each length: [(lengths in a bin, copies)].

    Every piece is in exactly one bin and no bin is over ``capacity``.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is not in 1..{capacity}")
        left[length] += n
    bins: list[tuple[tuple[int, ...], int]] = []
    sums = Sums(left, capacity)
    for length in range(capacity, 0, -1):
        while left[length] > 0:
            found = sums.fill(capacity - length, length)
            if found is None:
                break
            need = defaultdict(int)
            for x in (length, *found):
                need[x] += 1
            copies = min(int(left[x]) // n for x, n in need.items())
            for x, n in need.items():
                left[x] -= n * copies
            bins.append(((length, *found), copies))

    open_bins: dict[int, list[list]] = defaultdict(list)
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            room = next((r for r in range(length, capacity) if open_bins.get(r)), None)
            if room is not None:
                held = open_bins[room][-1]
                m = min(n, held[1])
                held[1] -= m
                if not held[1]:
                    open_bins[room].pop()
                open_bins[room - length].append([(*held[0], length), m])
                n -= m
                continue
            each = capacity // length
            if n >= each:
                full = n // each
                open_bins[capacity - each * length].append([(length,) * each, full])
                n -= full * each
            else:
                open_bins[capacity - n * length].append([(length,) * n, 1])
                n = 0
    bins += [(tuple(lengths), copies) for rest in open_bins.values() for lengths, copies in rest]
    return bins


def placements(bins: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted: where the pieces of a length go.

    The piece of rank r goes to the last row of its length with first rank <= r, to the
    sequence ``first sequence + r - first rank``.
    """
    rows, taken, sequence = [], defaultdict(int), 0
    for lengths, copies in bins:
        offset = 0
        for length in lengths:
            rows.append((length, taken[length], sequence, offset))
            taken[length] += copies
            offset += length
        sequence += copies
    rows.sort()
    return np.array(rows, dtype=np.int64).reshape(-1, 4)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0,
         id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """Pack every document into sequences of at most ``capacity`` tokens.

    Returns one row per piece: doc_id, piece, start, length, ids_crc32, sequence_id and
    offset. Null and empty texts take one token, the end id. Repeated rows are packed
    as often as they occur; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    salt = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int")
    pieces = materialise(token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col).withColumn("salt", salt), "pieces")

    # At most capacity * salts rows, whatever the corpus holds.
    length, part, n = (c.to_numpy() for c in pieces.groupBy("length", "salt").count().toArrow().columns)
    counts = np.zeros((capacity + 1, salts), dtype=np.int64)
    counts[length, part] = n
    rows = placements(plan_bins({x: int(m) for x, m in enumerate(counts.sum(axis=1)) if m}, capacity))
    starts = counts.cumsum(axis=1) - counts
    # Bounded likewise: bins that differ in content, not bins.
    held = spark.sparkContext.broadcast((rows, starts))

    def place(batches):
        plan, first = held.value
        edges = (plan[:, 0] << 44) + plan[:, 1]
        for batch in batches:
            length, part, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5, 8))
            rank = first[length, part] + rank
            at = np.searchsorted(edges, (length.astype(np.int64) << 44) + rank, "right") - 1
            columns = [batch.column(i) for i in range(5)]
            columns += [pa.array(plan[at, 2] + rank - plan[at, 1]), pa.array(plan[at, 3])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.col("length").alias("length_"), "salt",
        (F.row_number().over(order) - 1).cast("long").alias("rank"))
    schema = T._parse_datatype_string(PIECES + ", sequence_id long, offset long")
    return ranked.mapInArrow(place, schema)
