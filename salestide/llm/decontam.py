"""Benchmark decontamination by template canonicalisation.

Numbers, names and units of a text become typed placeholders, so a question
asked again with other values has the same template.  Every five-token window
of every document's template is joined by hash with the windows of the
benchmark items.  A document matches an item when it holds at least 0.8 of the
item's distinct windows.  For matches the tokens are read again, with the
values kept: along an alignment, each value of the item must always meet the
same value of the document (words before the item's first name may be read as
part of it).  All values equal means a copy, another mapping a
re-parameterised question; a mapping that contradicts itself is no match.
Every alignment is tested that holds ``similarity`` of the item's windows on its
own, and the one that most windows share; one that is consistent is enough.

Defined cases: a null or empty text has no tokens and matches nothing.  An item
of fewer than five tokens has one window, the whole item.  Repeated rows get
one answer per (document id, text).  Among consistent alignments the one
with most windows is reported, then the smallest offset.  An empty benchmark matches nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salestide.llm.common import content_key, rows_without
from salestide.session import durable

WINDOW = 5
SIMILARITY = 0.8
# a window row takes some 30 bytes, so that a broadcast side stays under 64 MB
MOST_BROADCAST_ROWS = 2_000_000

# fixed values: a number, a unit that may follow one, a run of capitalised words, a token
NUMBER = r"[0-9]+(?:[.,:/][0-9]+)*"
UNITS = (
    "km|m|cm|mm|miles|mile|feet|foot|inches|inch|kg|g|mg|tons|pounds|pound|ounces|liters|litres|ml|l|hours|hour|minutes|minute|"
    "seconds|second|days|day|weeks|week|months|month|years|year|dollars|dollar|euros|euro|cents|percent|degrees|mph|watts|volts"
)
NAME = r"\p{Lu}[\p{Ll}'][\p{L}'-]*(?: \p{Lu}[\p{Ll}'][\p{L}'-]*)*"
TOKEN = r"‹[^›]*›|[\p{L}\p{M}]+"
# the same matches, possessive: a repeated group is then a loop, else a call per turn, which overflows the stack in long runs
_NUMBER = r"[0-9]++(?:[.,:/][0-9]++)*+"
_NAME = r"\p{Lu}[\p{Ll}'][\p{L}'-]*+(?: \p{Lu}[\p{Ll}'][\p{L}'-]*+)*+"


def _marked(text: Column, values: bool) -> Column:
    """``text`` in lower case with its slots as ‹kind› or, with ``values``, as ‹kind:value›."""
    slot = (lambda kind, group: f" ‹{kind}:${group}› ") if values else (lambda kind, group: f" ‹{kind}› ")
    text = F.translate(F.coalesce(text, F.lit("")), "‹›", "  ")
    text = F.regexp_replace(text, rf"(^|[^\p{{L}}])({_NAME})", "$1" + slot("name", 2))
    text = F.regexp_replace(text, rf"({_NUMBER})", slot("num", 1))
    text = F.regexp_replace(text, rf"(?i)(‹num[^›]*› ) ?-?({UNITS})($|[^\p{{L}}])", "$1" + slot("unit", 2) + "$3")
    return F.lower(text)


def tokens(text: Column, values: bool = False) -> Column:
    return F.regexp_extract_all(_marked(text, values), F.lit(TOKEN), F.lit(0))


def _windows(hashes: Column, size: int) -> Column:
    """Hash of every run of ``size`` tokens, padded to five; none if there are fewer."""
    starts = F.when(F.size(hashes) >= size, F.sequence(F.lit(0), F.size(hashes) - size)).otherwise(F.array().cast("array<int>"))
    padding = [F.lit(0).cast("long")] * (WINDOW - size)
    return F.transform(starts, lambda i: F.xxhash64(*[hashes[i + k] for k in range(size)], *padding))


def _hashed(df: DataFrame, text: Column, *kept: Column) -> DataFrame:
    return df.select(*kept, tokens(text).alias("tokens")).select(
        *[F.col(n) for n in _names(df, kept)], F.transform("tokens", lambda t: F.xxhash64(t)).alias("hashes")
    )


def _names(df: DataFrame, kept) -> list[str]:
    return df.select(*kept).columns


def item_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item, length, win): the distinct template windows of every item."""
    hashed = _hashed(benchmark, F.col(text), F.col(item).alias("item")).where("size(hashes) > 0")
    short = F.array(F.xxhash64(*[F.coalesce(F.get("hashes", F.lit(k)), F.lit(0).cast("long")) for k in range(WINDOW)]))
    return hashed.select(
        "item", F.least(F.size("hashes"), F.lit(WINDOW)).alias("length"),
        F.explode(F.when(F.size("hashes") < WINDOW, short).otherwise(_windows(F.col("hashes"), WINDOW))).alias("win"),
    ).distinct()


def _document_windows(hashes: Column, lengths: list[int]) -> Column:
    """Windows of five tokens and, where the benchmark has shorter items, of their lengths."""
    found = [_windows(hashes, size) for size in [WINDOW, *lengths]]
    return F.concat(*found) if lengths else found[0]


def candidates(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
               similarity: float = SIMILARITY) -> DataFrame:
    """(doc, text_key, item, matched, windows) with at least ``similarity`` of the item's windows in the document."""
    items = item_windows(benchmark)
    stats = items.agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.when(F.col("length") < WINDOW, F.col("length"))).alias("short")).first()
    wanted = items.select("win").distinct()
    hashed = _hashed(docs, F.col(text), F.col(key).alias("doc"), content_key(F.col(text)).alias("text_key"))
    spread = hashed.select("doc", "text_key", F.explode(_document_windows(F.col("hashes"), sorted(stats["short"]))).alias("win"))
    small = stats["n"] <= MOST_BROADCAST_ROWS
    met = spread.join(F.broadcast(wanted) if small else wanted, "win", "left_semi").distinct()
    pairs = met.join(F.broadcast(items) if small else items, "win")
    totals = items.groupBy("item").agg(F.count(F.lit(1)).alias("windows"))
    counted = pairs.groupBy("doc", "text_key", "item").agg(F.count(F.lit(1)).alias("matched"))
    return counted.join(F.broadcast(totals) if small else totals, "item").where(F.col("matched") >= similarity * F.col("windows"))


def _placed(df: DataFrame, text: Column, *kept: Column) -> DataFrame:
    """Template tokens and values of every position."""
    split = F.transform(tokens(text, values=True), lambda t: F.struct(
        F.when(t.startswith("‹"), F.concat(F.lit("‹"), F.regexp_extract(t, "‹([a-z]+)", 1), F.lit("›"))).otherwise(t).alias("token"),
        F.when(t.startswith("‹"), F.regexp_extract(t, "(?s):(.*)›", 1)).alias("value"),
    ))
    return df.select(*kept, split.alias("split"))


def _slots(placed: DataFrame, names: list[str], at: str, whole: bool) -> DataFrame:
    """One row per window: its start, its tokens and their values; with ``whole`` no windows cut short by the end."""
    width = F.least(F.size("split"), F.lit(WINDOW)) if whole else F.lit(1)
    starts = F.when(F.size("split") > 0, F.sequence(F.lit(0), F.size("split") - width))
    return placed.select(*names, "split", F.explode(starts).alias(at)).select(
        *names, at, F.slice("split", F.col(at) + 1, F.lit(WINDOW)).alias("part")
    ).select(*names, at, F.col("part.token").alias("tokens"), F.col("part.value").alias("values"))


def _first_name(values: Column, own: Column, start: Column) -> Column:
    """``values`` of a document's window; where the item starts with a name and the document's run of names ends in it, the item's."""
    longer = (start == 0) & F.endswith(values[0], F.concat(F.lit(" "), own[0]))
    return F.when(longer, F.concat(F.slice(own, F.lit(1), F.lit(1)), F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0))))).otherwise(values)


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(doc, text_key, item, matched, windows, slots, changed) of all consistent matches.

    ``slots`` counts the item's distinct values on the alignment, ``changed``
    those that the document replaces.
    """
    found = durable(candidates(docs, benchmark, key, text, similarity))
    texts = docs.select(F.col(key).alias("doc"), content_key(F.col(text)).alias("text_key"), F.col(text).alias("text"))
    chosen = found.select("doc", "text_key").distinct()
    # one row per (document id, text), even if the table repeats it
    own = texts.join(chosen, texts["doc"].eqNullSafe(chosen["doc"]) & (texts["text_key"] == chosen["text_key"]), "left_semi")
    own = own.groupBy("doc", "text_key").agg(F.first("text").alias("text"))
    theirs = _slots(_placed(own, F.col("text"), F.col("doc"), F.col("text_key")), ["doc", "text_key"], "at", whole=False)
    ours = _slots(_placed(benchmark, F.col("text"), F.col("item_id").alias("item")), ["item"], "from", whole=True)
    pairs = found.join(
        ours.select("item", "from", F.col("tokens").alias("own_tokens"), F.col("values").alias("own_values")), "item"
    )
    n = F.size("own_tokens")
    # short items meet the leading part of longer windows as well
    met = pairs.alias("p").join(theirs.alias("d"), F.col("p.doc").eqNullSafe(F.col("d.doc")) & (F.col("p.text_key") == F.col("d.text_key"))
                                & (F.col("own_tokens")[0] == F.col("tokens")[0])
                                & (F.col("own_tokens") == F.slice("tokens", F.lit(1), n))).select(
        "p.doc", "p.text_key", "item", "matched", "windows", (F.col("at") - F.col("from")).alias("shift"), F.xxhash64("own_tokens").alias("own_window"),
        F.filter(F.arrays_zip("own_values", _first_name(F.slice("values", F.lit(1), n), F.col("own_values"), F.col("from")).alias("values"), "own_tokens"), lambda x: x["own_values"].isNotNull()).alias("slots"),
    )
    pair = ["doc", "text_key", "item", "matched", "windows"]
    own_values = F.array_distinct(F.transform("slots", lambda x: F.struct(x["own_tokens"], x["own_values"])))
    lines = met.groupBy(*pair, "shift").agg(
        F.count(F.lit(1)).alias("n"), F.size(F.collect_set("own_window")).alias("own"),
        F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"),
    ).withColumn("consistent", F.size(own_values) == F.size("slots"))
    rank = F.struct("n", -F.col("shift"))
    whole = F.when(F.col("consistent") & (F.col("own") >= similarity * F.col("windows")), rank)
    # the alignment with most windows counts even if insertions part the item into several
    best = lines.groupBy(*pair).agg(
        F.max_by(F.struct("slots", "consistent"), rank).alias("most"), F.max_by("slots", whole).alias("whole")
    ).select(*pair, F.when(F.col("most.consistent"), F.col("most.slots")).otherwise(F.col("whole")).alias("slots"))
    return best.where("slots is not null").select(
        *pair, F.size(own_values).alias("slots"), F.size(F.filter("slots", lambda x: x["own_values"] != x["values"])).alias("changed")
    )


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that match no benchmark item, with their own columns."""
    found = leaks(docs, benchmark, key, text, **options)
    flagged = durable(found.select("doc", F.col("text_key").alias("row_key")).distinct())
    return rows_without(docs, key, content_key(F.col(text)), flagged)
