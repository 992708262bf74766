"""Best-fit packing of documents into fixed-length sequences with a bounded number of open bins.

Documents are tokenised where they lie; only rows about pieces move. Pieces of full length fill a
sequence each. The others are dealt out at random to packers, which place them as they come, without
sorting them by length. A packer keeps a fixed number of open sequences in lists by free space and a
bitset of the free spaces that occur, so the tightest fit is the lowest set bit at or above the length
wanted. When one more has to open, the fullest closes.
"""

import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from wareloom.llm.common import run_tables
from wareloom.llm.tokenizing import RANKS, text_tokenizer

LENGTH = 2048
OPEN_BINS = 512
PIECES_PER_PACKER = 40_000
END = b"\x00\x00\x00\x00"

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, lot bigint"


def cut(count, length=LENGTH):
    """(start, length) of the pieces of a document of `count` ids; only the first may be shorter."""
    if count <= length:
        return [(0, count)]
    first = count % length
    starts = ([0] if first else []) + list(range(first, count, length))
    return [(start, first if first and start == 0 else length) for start in starts]


class OpenBins:
    """A fixed number of open sequences by free space."""

    def __init__(self, length=LENGTH, limit=OPEN_BINS):
        self.length, self.limit = length, limit
        self.bits, self.count, self.opened = 0, 0, 0
        self.by_room = {}

    def _take(self, room):
        places = self.by_room[room]
        place = places.pop()
        if not places:
            del self.by_room[room]
            self.bits ^= 1 << room
        self.count -= 1
        return place

    def put(self, size):
        """(bin, offset) of a piece: the tightest open bin, or a new one."""
        fitting = self.bits >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            place = self._take(room)
        else:
            room, place = self.length, self.opened
            self.opened += 1
        left = room - size
        if left:
            if self.count >= self.limit:
                fullest = (self.bits & -self.bits).bit_length() - 1
                if left <= fullest:
                    return place, self.length - room
                self._take(fullest)
            self.by_room.setdefault(left, []).append(place)
            self.bits |= 1 << left
            self.count += 1
        return place, self.length - room


_TYPES = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
_NAMES = ["doc_id", "piece", "start", "length", "ids_crc32", "lot"]


def _pieces(path, length):
    def tokenise(batches):
        tokenizer = text_tokenizer(path)
        task = TaskContext.get().partitionId()
        n = 0
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = tokenizer.ids(text.as_py()) + END
                for piece, (start, size) in enumerate(cut(len(ids) // 4, length)):
                    crc = zlib.crc32(memoryview(ids)[4 * start : 4 * (start + size)])
                    n += 1
                    lot = zlib.crc32(b"%d %d" % (task, n))
                    rows.append((doc_id, piece, start, size, crc, lot))
            columns = zip(*rows) if rows else [()] * len(_TYPES)
            yield pa.record_batch([pa.array(column, kind) for column, kind in zip(columns, _TYPES)], names=_NAMES)

    return tokenise


def _pack(length, limit):
    def pack(batches):
        task = TaskContext.get().partitionId()
        bins = OpenBins(length, limit)
        for batch in batches:
            placed = [bins.put(size) for size in batch.column("length").to_pylist()]
            sequences = pa.array([(2 * task << 40) + place for place, _ in placed], pa.int64())
            offsets = pa.array([offset for _, offset in placed], pa.int64())
            yield pa.record_batch([*batch.columns[:-1], sequences, offsets], names=[*_NAMES[:-1], "sequence_id", "offset"])

    return pack


def pack_documents(docs, length=LENGTH, tokenizer=RANKS, open_bins=OPEN_BINS, pieces_per_packer=PIECES_PER_PACKER):
    """Pieces of all documents with their sequence and place in it.

    A document without text has one id, the end mark. Repeated rows are packed once each. A null
    doc_id stays null. Extra columns are ignored. An empty table gives an empty result. Which of
    several equally good sequences a piece gets is open.
    """
    tables = run_tables(docs, "packing")
    narrow = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    # Written, so that the deal stays as it is when a task is repeated.
    pieces = tables.write(narrow.mapInArrow(_pieces(tokenizer, length), PIECES), "pieces")
    full = pieces.filter(F.col("length") == length).select(
        *[name for name in pieces.columns if name != "lot"],
        (F.monotonically_increasing_id() * 2 + 1).alias("sequence_id"),
        F.lit(0).cast("bigint").alias("offset"),
    )
    short = pieces.filter(F.col("length") < length)
    packers = max(1, -(-short.count() // pieces_per_packer))
    dealt = short.repartition(packers, "lot").sortWithinPartitions("lot", "doc_id", "piece")
    schema = PIECES.replace(", lot bigint", ", sequence_id bigint, offset bigint")
    return full.unionByName(dealt.select(*_NAMES).mapInArrow(_pack(length, open_bins), schema))
