"""Packing of documents into training sequences by bounded-space online best-fit.

Every text becomes token ids and one end token.  Only a document longer than a
sequence is cut; its last piece may be shorter.  A task takes its pieces one by
one: a piece goes to the fullest open bin it fits in, found in a bitset keyed
by free space.  Where it fits in none, a new bin is opened, and when ``OPEN``
bins are open already, the fullest closes first.  What is still open at a
task's end goes on to the next round with fewer tasks; the last one packs at
most ``OPEN`` bins of each of ``MERGE`` tasks and closes all.

No piece is dropped or cut to fit, and a task holds only lengths, never ids.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from salestide.llm import tokens
from salestide.llm.common import written
from salestide.session import durable

VOCABULARY = "word_bpe_49k.json"
LENGTH = 4096
END_TOKEN = 1
#: bins open at a time in a task
OPEN = 512
#: pieces of a task in the first round
ROWS_PER_TASK = 200_000
#: tasks whose open bins one task of the next round takes
MERGE = 16


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = VOCABULARY, length: int = LENGTH, end: int = END_TOKEN) -> DataFrame:
    """(doc, piece, start, length, ids): the pieces of every row, ``ids`` as little-endian unsigned 32-bit numbers.

    Null texts count as empty and are one end token; null keys and repeated
    rows have pieces like others.  Other columns of ``docs`` are left out.
    """
    read = docs.select(F.col(key).alias("doc"), F.col(text).cast("string").alias("text"))
    types = StructType([
        StructField("doc", read.schema["doc"].dataType), StructField("piece", IntegerType()), StructField("start", LongType()),
        StructField("length", LongType()), StructField("ids", BinaryType()),
    ])
    last = np.array([end], "<u4").tobytes()
    size = 4 * length

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokens.word_ids(name)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in tokens.slices(texts):
                rows, numbers, ids = [], [], []
                for i, body in enumerate(words.of(texts[a:b]), a):
                    body += last
                    for n, at in enumerate(range(0, len(body), size)):
                        rows.append(i)
                        numbers.append(n)
                        ids.append(body[at : at + size])
                n = np.array(numbers, np.int32)
                lengths = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
                arrays = [batch.column("doc").take(pa.array(rows, pa.int64())), pa.array(n), pa.array(n.astype(np.int64) * length), pa.array(lengths), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=types.names)

    return read.mapInArrow(cut, types)


class Bins:
    """Open bins by free space; ``closed`` gets every bin that closes as its list of items."""

    def __init__(self, length: int, most: int, closed: Callable[[list], None]):
        self.length, self.most, self.closed = length, most, closed
        self.spaces = 0  # bit f is set while a bin has f free
        self.bins: dict[int, list[list]] = defaultdict(list)
        self.count = 0

    def _take(self, free: int) -> list:
        """Any open bin with ``free`` left, no longer open."""
        same = self.bins[free]
        found = same.pop()
        if not same:
            self.spaces &= ~(1 << free)
        self.count -= 1
        return found

    def _put(self, items: list, free: int) -> None:
        if not free:
            self.closed(items)
            return
        self.bins[free].append(items)
        self.spaces |= 1 << free
        self.count += 1

    def add(self, item, size: int) -> None:
        fitting = self.spaces >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            items = self._take(free)
        else:
            if self.count >= self.most:
                self.closed(self._take((self.spaces & -self.spaces).bit_length() - 1))
            items, free = [], self.length
        items.append(item)
        self._put(items, free - size)

    def rest(self) -> list[list]:
        """All open bins, the fullest first."""
        return [items for free in sorted(self.bins) for items in self.bins[free]]


def best_fit(sizes: np.ndarray, length: int, most: int, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every item in the order of arrival; bin -1 is still open.

    With ``last`` the items of the bins still open are packed once more, the
    largest first, and all bins close.
    """
    at, offsets = np.full(len(sizes), -1, np.int64), np.zeros(len(sizes), np.int64)
    count = 0

    def closed(items: list) -> None:
        nonlocal count
        at[items] = count
        offsets[items] = np.cumsum(sizes[items]) - sizes[items]
        count += 1

    bins = Bins(length, most, closed)
    for i, size in enumerate(sizes.tolist()):
        bins.add(i, size)
    if last:
        left = sorted((i for items in bins.rest() for i in items), key=lambda i: -sizes[i])
        bins = Bins(length, most, closed)
        for i in left:
            bins.add(i, int(sizes[i]))
        for items in bins.rest():
            closed(items)
    return at, offsets


def _packer(turn: int, length: int, most: int, last: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = list(parts)
        if not read:
            return
        # the order doesn't depend on how the rows arrive
        rows = pd.concat(read).sort_values(["order", "id"])
        at, offsets = best_fit(rows.length.to_numpy(np.int64), length, most, last)
        first = (turn << 56) | (TaskContext.get().partitionId() << 32)
        yield pd.DataFrame({"id": rows.id.to_numpy(), "length": rows.length.to_numpy(), "sequence_id": np.where(at < 0, -1, first + at), "offset": offsets})

    return pack


def assigned(sized: DataFrame, length: int = LENGTH, most: int = OPEN, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """(id, sequence_id, offset) of the durable rows ``sized`` (id, length); ids are unique, lengths 1 to ``length``."""
    tasks = max(1, math.ceil(sized.count() / rows_per_task))
    left, found, turn = sized.select("id", "length"), None, 0
    while True:
        ordered = left.select("id", "length", F.xxhash64("id", F.lit(turn)).alias("order"))
        dealt = ordered.repartition(tasks, "order") if tasks > 1 else ordered.coalesce(1)
        types = "id long, length long, sequence_id long, offset long"
        now = durable(dealt.mapInPandas(_packer(turn, length, most, tasks == 1), types))
        done = now.where("sequence_id >= 0").select("id", "sequence_id", "offset")
        found = done if found is None else found.unionByName(done)
        if tasks == 1:
            return found
        left = now.where("sequence_id < 0")
        tasks, turn = math.ceil(tasks / MERGE), turn + 1


def packed(cut: DataFrame, length: int = LENGTH, most: int = OPEN) -> DataFrame:
    """``cut`` (with a column length, as ``pieces`` gives it) with sequence_id and offset.

    The rows are written once, so that every piece keeps its number; columns
    named as the added ones are replaced.
    """
    rows = written(cut.drop("sequence_id", "offset", "_id").withColumn("_id", F.monotonically_increasing_id()))
    places = assigned(rows.select(F.col("_id").alias("id"), "length"), length, most).withColumnRenamed("id", "_id")
    return rows.join(places, "_id").drop("_id")




def sequences(full: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids): the sequences of ``packed`` pieces with their ids; a group holds one sequence."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = F.aggregate(parts, F.lit(b""), lambda found, x: F.concat(found, x["ids"]))
    return full.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), whole.alias("ids"))
