"""Removal of repeated passages by sparse distributed prefix doubling.

A byte goes if a string of ``length`` bytes that covers it also starts at
another place of the corpus.  A suffix array would rank every byte position at
lengths 1, 2, 4, ... until ranks are unique or the length is reached; a row per
byte and round is more than the disk holds.  Here the early ranks (1, 2, ... up
to the level's length) are names that each task computes by the same doubling,
name(p, 2h) from name(p, h) and name(p + h, h), and Spark ranks only chosen
positions, in rounds of growing length:

* Of every window of ``length`` bytes the smallest name it holds stands for it.
  Neighbouring windows share it, so one row, a run, carries a whole stretch.
  Equal windows have equal smallest names, wherever they stand.
* Spark groups the runs by name.  A name met once is unique: no window of the
  run repeats, and it leaves.  Runs that agree in all their bytes repeat, and
  are settled.  Only runs that share the name but not all their bytes go on to
  the next round, with a longer name; the last round's name is the window.

Names are 64-bit; equality of a run also takes a second 64-bit hash of its bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from salestide.llm.common import MOST_BROADCAST_KEYS, content_key, packed, written

LENGTH = 400
#: lengths of the names of each round but the last, as shares of LENGTH
ROUNDS = (0.32, 0.92)
_ROWS_PER_BATCH = 50_000

_RUN = "doc long, row_key long, need boolean, first int, last int, name long, bytes_hash long, twice boolean"
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    out = left * _A
    out += right
    out ^= out >> np.uint64(31)
    out *= _B
    out ^= out >> np.uint64(29)
    return out


def names(data: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit name of the ``length`` bytes from every position, by doubling."""
    x = (data.astype(np.uint64) + np.uint64(1)) * _C
    half = 1
    while 2 * half <= length:
        x = _joined(x[:-half], x[half:])
        half *= 2
    return x if half == length else _joined(x[: len(data) - length + 1], x[length - half :])


def smallest(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` neighbours, by doubling."""
    out, half = x, 1
    while 2 * half <= width:
        out = np.minimum(out[:-half], out[half:])
        half *= 2
    return out if half == width else np.minimum(out[: len(x) - width + 1], out[width - half :])


def runs(data: bytes, start: int, name_length: int, length: int) -> Iterator[tuple[int, int, int, int, bool]]:
    """(first, last, name, bytes_hash, twice) of the windows of ``data``; positions are counted from ``start``.

    ``twice`` tells that the name stands at two places of the run, whose windows may then repeat each other.
    """
    if len(data) < length:
        return
    view = np.frombuffer(data, np.uint8)
    x = names(view, name_length)
    width = length - name_length + 1
    if width == 1:
        for p, name in enumerate(x.view(np.int64).tolist()):
            yield start + p, start + p, name, _signed(xxhash.xxh3_64_intdigest(data[p : p + length])), False
        return
    low = smallest(x, width)
    cuts = np.flatnonzero(low[1:] != low[:-1]) + 1
    firsts = np.concatenate(([0], cuts))
    lasts = np.concatenate((cuts - 1, [len(low) - 1]))
    values = low[firsts]
    for p, q, value, name in zip(firsts.tolist(), lasts.tolist(), values, values.view(np.int64).tolist()):
        twice = bool(np.count_nonzero(x[p : q + width] == value) > 1)
        yield start + p, start + q, name, _signed(xxhash.xxh3_64_intdigest(data[p : q + length])), twice


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _round(name_length: int, length: int) -> Callable:
    """Rows (see ``_RUN``) of a round, for mapInArrow over doc, row_key, data and, after the first round, open runs."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = pa.schema([("doc", pa.int64()), ("row_key", pa.int64()), ("need", pa.bool_()), ("first", pa.int32()), ("last", pa.int32()),
                            ("name", pa.int64()), ("bytes_hash", pa.int64()), ("twice", pa.bool_())])
        out: list[tuple] = []
        for batch in batches:
            docs, keys, data = batch.column("doc"), batch.column("row_key"), batch.column("data")
            opened = batch.column("open") if "open" in batch.schema.names else None
            for i in range(batch.num_rows):
                body = data[i].as_py() or b""
                parts = [(0, len(body) - length, True)] if opened is None else [(o["first"], o["last"], o["need"]) for o in opened[i].as_py()]
                ids = docs[i].as_py(), keys[i].as_py()
                for first, last, need in parts:
                    for run in runs(body[first : last + length], first, name_length, length):
                        out.append((*ids, need, *run))
                        if len(out) >= _ROWS_PER_BATCH:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), fields)], schema=fields)
                            out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), fields)], schema=fields)

    return go


def _judged(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(settled, open) of a round's runs: those that repeat as they are, and those for the next round."""
    by_name = found.groupBy("name").agg(
        F.count(F.lit(1)).alias("n"), F.min("bytes_hash").alias("low"), F.max("bytes_hash").alias("high"),
        F.bool_or(F.col("need")).alias("asked"), F.bool_or("twice").alias("inside"),
    ).where("asked and (n > 1 or inside)").select("name", ((F.col("low") != F.col("high")) | F.col("inside")).alias("mixed"), "inside")
    shared = written(found.join(by_name, "name"))
    # a name with one body is settled as it stands; the others are counted by body
    alike = shared.where("not mixed")
    bodies = shared.where("mixed").groupBy("name", "bytes_hash").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "row_key", "first", "last", "need")).alias("one"),
    )
    whole = bodies.where("n > 1").select("name", "bytes_hash")
    repeated = shared.where("mixed and need").join(whole, ["name", "bytes_hash"], "left_semi")
    settled = alike.where("need").select("doc", "row_key", "first", "last").union(repeated.select("doc", "row_key", "first", "last"))
    # of equal bodies one goes on, as a witness for others
    going = bodies.select("name", F.col("one.doc").alias("doc"), F.col("one.row_key").alias("row_key"), F.col("one.first").alias("first"),
                          F.col("one.last").alias("last"), (F.col("one.need") & (F.col("n") == 1)).alias("need"))
    asking = going.groupBy("name").agg(F.bool_or("need").alias("wanted")).where("wanted").select("name")
    return settled, going.join(asking, "name", "left_semi").select("doc", "row_key", "first", "last", "need")


def _number(docs: DataFrame, key: str) -> Column:
    """The key as a long: whole numbers as they are, others by hash; a null key has a value of its own.  Rows are told
    apart by it and the hash of key and text."""
    if isinstance(docs.schema[key].dataType, IntegralType):
        return F.coalesce(F.col(key).cast("long"), F.lit(-(2**63)))
    return F.xxhash64(F.col(key).cast("string"))


def _sources(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(
        _number(docs, key).alias("doc"), content_key(F.col(key), F.col(text)).alias("row_key"),
        F.col(text).cast("binary").alias("data"),
    )


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc, row_key, spans): the maximal repeated byte ranges of every document that has some."""
    texts = _sources(docs, key, text)
    lengths = [max(1, int(length * share)) for share in ROUNDS] + [length]
    found = written(texts.mapInArrow(_round(lengths[0], length), _RUN))
    settled, opened = _judged(found)
    parts = [settled]
    for at, name_length in enumerate(lengths[1:], 1):
        lists = written(opened.groupBy("doc", "row_key").agg(F.collect_list(F.struct("first", "last", "need")).alias("open")))
        # later rounds read the documents that are still open; if they are few, others don't travel to the join
        keys = lists.select("doc", "row_key")
        texts = texts.select("doc", "row_key", "data")
        if keys.count() <= MOST_BROADCAST_KEYS:
            texts = texts.join(F.broadcast(keys), ["doc", "row_key"], "left_semi")
        texts = texts.join(lists, ["doc", "row_key"])
        if at < len(lengths) - 1:
            texts = written(texts)
        found = texts.mapInArrow(_round(name_length, length), _RUN)
        if at == len(lengths) - 1:
            equal = written(found)
            twice = equal.groupBy("name", "bytes_hash").agg(F.count(F.lit(1)).alias("n"), F.bool_or("need").alias("asked"))
            twice = twice.where("n > 1 and asked").select("name", "bytes_hash")
            parts.append(equal.where("need").join(twice, ["name", "bytes_hash"], "left_semi").select("doc", "row_key", "first", "last"))
        else:
            settled, opened = _judged(written(found))
            parts.append(settled)
    spans = parts[0]
    for part in parts[1:]:
        spans = spans.union(part)
    own = Window.partitionBy("doc", "row_key").orderBy("first", "last")
    reach = F.max("stop").over(own.rowsBetween(Window.unboundedPreceding, -1))
    joined = spans.select("doc", "row_key", "first", "last", (F.col("last") + length).alias("stop")).withColumn(
        "fresh", F.when(reach >= F.col("first"), 0).otherwise(1)
    ).withColumn("island", F.sum("fresh").over(own)).groupBy("doc", "row_key", "island").agg(F.min("first").alias("start"), F.max("stop").alias("stop"))
    return joined.groupBy("doc", "row_key").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """``row`` (the document), n_bytes, spans and kept, the bytes that stay.

    A null text is empty.  Texts under ``length`` bytes stay whole.  Repeated
    rows are documents of their own, so they repeat each other.  ``kept`` is
    binary, as a cut may fall inside a character.
    """
    spans = repeated_spans(docs, key, text, length).withColumnsRenamed({"doc": "span_doc", "row_key": "span_key"})
    rows = docs.select(packed(docs).alias("row"), _number(docs, key).alias("doc"),
                       content_key(F.col(key), F.col(text)).alias("row_key"))
    met = rows.join(spans, (F.col("doc") == F.col("span_doc")) & (F.col("row_key") == F.col("span_key")), "left")
    empty = F.array().cast("array<struct<start:int,stop:int>>")
    data = F.coalesce(F.col("row")[text].cast("binary"), F.lit("").cast("binary"))
    full = met.select("row", F.coalesce("spans", empty).alias("spans"), F.octet_length(data).alias("n_bytes"))
    gaps = F.zip_with(
        F.concat(F.array(F.lit(0)), F.col("spans.stop")), F.concat(F.col("spans.start"), F.array(F.col("n_bytes"))),
        lambda a, b: F.struct(a.alias("start"), b.alias("stop")),
    )
    kept = F.aggregate(gaps, F.lit("").cast("binary"), lambda done, g: F.concat(done, F.substring(data, g["start"] + 1, g["stop"] - g["start"])))
    return full.select("row", "n_bytes", "spans", F.when(F.size("spans") == 0, data).otherwise(kept).alias("kept"))
