"""Language identification by Bayesian evidence fusion.

The posterior of a row's language is the product of

* the text's likelihood: letter trigrams under a smoothed model per language,
  fitted on a bounded sample of labelled documents, and a uniform model for
  text of no known language.  Trigrams of a long text are not independent, so
  its log-likelihood counts as that of ``EVIDENCE`` trigrams at most;
* the declared language and the address suffix: how often each value stands
  beside each language, counted over all rows;
* the host's prior: the languages of its other rows, smoothed toward its domain
  and this toward the whole table.

Counts use the language that the text alone favours.  All tables are grouped
sums; a row leaves its own language out of its host's counts.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from salestide.llm.common import row_key, rows_without
from salestide.session import durable

SAMPLE_ROWS = 3_000
# of a language that the sample would hold fewer of, so many are taken, or all there are
LANGUAGE_ROWS = 300
LEAST_SAMPLED = 5
BUCKETS = 1 << 16
EVIDENCE = 60
PRIOR_WEIGHT = 10.0
LEAST_POSTERIOR = 0.5
UNKNOWN = "und"
UNKNOWN_SHARE = 0.01
_BLOCK = 1 << 20


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def trigrams(text: str) -> np.ndarray:
    """Buckets of the letter trigrams of one block; other characters part words and count as one blank."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(_letters()[codes], codes, 32)
    codes = codes[(codes != 32) | np.append(True, codes[:-1] != 32)].astype(np.uint64)
    if len(codes) < 3:
        return np.array([], int)
    mixed = (codes[:-2] * np.uint64(0x9E3779B1) + codes[1:-1] * np.uint64(0x85EBCA77) + codes[2:] * np.uint64(0xC2B2AE3D)) * np.uint64(0x27D4EB2F165667C5)
    return (mixed >> np.uint64(48)).astype(int)


def _blocks(text: str) -> Iterator[str]:
    for at in range(0, len(text), _BLOCK):
        yield text[at : at + _BLOCK]


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for lang, part in batch.groupby("lang"):
            total = np.zeros(BUCKETS, np.int64)
            for text in part["text"]:
                for block in _blocks(text):
                    total += np.bincount(trigrams(block), minlength=BUCKETS)
            seen = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "bucket": seen, "n": total[seen], "rows": np.where(np.arange(len(seen)) == 0, len(part), 0)})


class Model:
    """Languages and the log-probability of each trigram bucket under each; the unknown language is the last."""

    def __init__(self, languages: list[str], table: np.ndarray) -> None:
        self.languages, self.table = languages, table

    def score(self, text: str | None) -> list[float] | None:
        """Log-likelihood by language; None without letters."""
        total, n = np.zeros(self.table.shape[1]), 0
        for block in _blocks(text or ""):
            grams = trigrams(block)
            # blanks alone are no evidence
            if len(grams):
                total += self.table[grams].sum(axis=0, dtype=np.float64)
                n += len(grams)
        return (total * (min(n, EVIDENCE) / n)).tolist() if n else None


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = SAMPLE_ROWS,
        per_language: int = LANGUAGE_ROWS) -> Model:
    """The model from about ``rows`` labelled documents, with about ``per_language`` of every language or all it has.

    Languages with fewer than LEAST_SAMPLED documents in the whole table are left out.
    """
    labelled = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    place = F.pmod(F.xxhash64(F.col(key), F.length(text)), F.lit(1 << 40))
    placed = labelled.select(F.lower(F.col(lang)).alias("lang"), F.col(text).alias("text"), place.alias("place"))
    # one row per label
    sizes = placed.groupBy("lang").agg(F.count(F.lit(1)).alias("of_lang"))
    total, most = (x or 0 for x in sizes.agg(F.sum("of_lang"), F.max("of_lang")).first())
    share = F.least(F.lit(1.0), F.greatest(F.lit(rows / max(total, 1)), per_language / F.col("of_lang")))
    shares = sizes.where(F.col("of_lang") >= min(LEAST_SAMPLED, most)).select(F.col("lang").alias("own_lang"), (share * (1 << 40)).cast("long").alias("below"))
    sample = placed.join(F.broadcast(shares), F.col("lang") == F.col("own_lang")).where("place < below").select("lang", "text")
    # at most one row per language and bucket
    counts = sample.mapInPandas(_counts, "lang string, bucket int, n long, rows long").groupBy("lang", "bucket").agg(
        F.sum("n").alias("n"), F.sum("rows").alias("rows")
    ).toPandas()
    sampled = counts.groupby("lang")["rows"].sum()
    languages = sorted(sampled[sampled >= min(LEAST_SAMPLED, sampled.max() if len(sampled) else 0)].index)
    table = np.full((BUCKETS, len(languages) + 1), np.log(1 / BUCKETS))
    for k, name in enumerate(languages):
        own = counts[counts["lang"] == name]
        seen = np.zeros(BUCKETS)
        seen[own["bucket"]] = own["n"]
        table[:, k] = np.log((seen + 0.5) / (seen.sum() + 0.5 * BUCKETS))
    return Model(languages, table.astype(np.float32))


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))


def domain_of(host: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.lit("")), host)


def suffix_of(host: Column) -> Column:
    return F.nullif(F.regexp_extract(host, r"\.([^.]+)$", 1), F.lit(""))


def markup_language(html: Column) -> Column:
    found = F.regexp_extract(html, r"(?i)<html(?:\s[^<>]*?)?\slang\s*=\s*[\"']?([A-Za-z]{2,3})", 1)
    return F.nullif(F.lower(found), F.lit(""))


def page_text(html: Column) -> Column:
    return F.regexp_replace(html, r"<[^<>]*>", " ")


def _summed(rows: DataFrame, by: str, width: int) -> DataFrame:
    """Rows of each language per value of ``by``; rows without a value or a text are left out."""
    counted = rows.where(F.col(by).isNotNull() & F.col("top").isNotNull()).groupBy(by).agg(
        *[F.sum((F.col("top") == k).cast("long")).alias(f"n{k}") for k in range(width)]
    )
    return counted.select(F.col(by).alias(f"of_{by}"), F.array(*[f"n{k}" for k in range(width)]).alias(f"by_{by}"))


def _smoothed(counts: Column, own: Column | None, toward: Column, weight: float) -> Column:
    """Shares of ``counts``, without the row's own language, smoothed toward other shares."""
    if own is not None:
        counts = F.transform(counts, lambda n, k: F.greatest(n - (k == own).cast("long"), F.lit(0)))
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, n: a + n)
    return F.zip_with(counts, toward, lambda n, p: (n + weight * p) / (total + weight))


def fused(rows: DataFrame, model: Model) -> DataFrame:
    """``row``, language, posterior and rejected, from rows of (row, text, declared, host, domain, suffix).

    Any column may be null: such evidence is left out.  A row without letters,
    of null or empty text too, has language ``und``, posterior null, and is
    rejected.  Ties go to the language first in the alphabet.  Repeated rows
    count as often as they stand.
    """
    names = [*model.languages, UNKNOWN]
    width = len(names)

    @F.pandas_udf(ArrayType(DoubleType()))
    def likelihood(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([model.score(t) for t in batch])

    scored = rows.select("row", "declared", "host", "domain", "suffix", likelihood("text").alias("loglik"))
    scored = durable(scored.withColumn("top", (F.array_position("loglik", F.array_max("loglik")) - 1).cast("int")))
    whole = scored.agg(*[F.sum((F.col("top") == k).cast("long")).alias(f"n{k}") for k in range(width)]).first()
    flat = np.array([n or 0 for n in whole], float)
    flat[-1] = min(flat[-1], UNKNOWN_SHARE * flat.sum())
    general = ((flat + 1) / (flat.sum() + width)).tolist()
    spread = F.array(*[F.lit(p) for p in general])
    joined = scored
    for by in ("host", "domain", "suffix", "declared"):
        joined = joined.join(_summed(scored, by, width), F.col(by) == F.col(f"of_{by}"), "left").drop(f"of_{by}")
    none = F.array_repeat(F.lit(0).cast("long"), width)
    own = F.coalesce("top", F.lit(-1))
    domain = _smoothed(F.coalesce("by_domain", none), own, spread, PRIOR_WEIGHT)
    host = _smoothed(F.coalesce("by_host", none), own, domain, PRIOR_WEIGHT)
    # rows of language l that carry the value, over all rows of language l
    beside = lambda counts: F.zip_with(
        _smoothed(F.coalesce(counts, none), own, spread, PRIOR_WEIGHT), spread, lambda p, q: F.log(p / q)
    )
    evidence = F.zip_with(F.transform(host, lambda p: F.log(p)), F.col("loglik"), lambda a, b: a + b)
    for by in ("suffix", "declared"):
        evidence = F.zip_with(evidence, F.when(F.col(f"by_{by}").isNull(), F.array_repeat(F.lit(0.0), width)).otherwise(beside(F.col(f"by_{by}"))), lambda a, b: a + b)
    placed = joined.select("row", evidence.alias("evidence"))
    best = F.array_max("evidence")
    at = F.array_position("evidence", best).cast("int")
    mass = F.aggregate("evidence", F.lit(0.0), lambda a, x: a + F.exp(x - best))
    named = placed.select(
        "row", F.coalesce(F.element_at(F.array(*[F.lit(n) for n in names]), at), F.lit(UNKNOWN)).alias("language"), (1 / mass).alias("posterior")
    )
    refused = (F.col("language") == UNKNOWN) | (F.col("posterior") < LEAST_POSTERIOR)
    return named.select("row", "language", "posterior", refused.alias("rejected"))


def document_rows(docs: DataFrame, row: Column, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Documents have a declared language and a source in place of a host."""
    return docs.select(
        row.alias("row"), F.col(text).alias("text"), F.lower(F.col(lang)).alias("declared"), F.col(source).alias("host"),
        F.lit(None).cast("string").alias("domain"), F.lit(None).cast("string").alias("suffix"),
    )


def page_rows(pages: DataFrame, row: Column, url: str = "url", html: str = "html") -> DataFrame:
    host = host_of(F.col(url))
    return pages.select(
        row.alias("row"), page_text(F.col(html)).alias("text"), markup_language(F.col(html)).alias("declared"), host.alias("host"),
        domain_of(host).alias("domain"), suffix_of(host).alias("suffix"),
    )


def kept(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The documents that are not rejected, with their own columns."""
    model = fit(docs, key, text, lang)
    found = fused(document_rows(docs, F.struct(F.col(key).alias("doc"), row_key(docs).alias("row_key")), text, lang, source), model)
    return rows_without(docs, key, row_key(docs), durable(found.where("rejected").select("row.*").distinct()))
