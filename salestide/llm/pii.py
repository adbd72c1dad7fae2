"""Personal data by candidate gradient boosting.

High-recall generators propose overlapping spans.  Boosted trees read each
span's format and surroundings; a threshold per kind, calibrated on documents
kept out of the fit, selects the redactions.  Spans that satisfy the base rules
(``base_spans``) always stay; the trees add what the rules miss, such as spelled
out addresses or local phone numbers after a word like "tel".

The trees are fitted on the candidates of all documents.  Labels come from the
base rules: their spans are positive, also rewritten into forms that the rules
don't know; all other candidates are negative.  Candidates of equal features are
one row with a weight.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from salestide.llm.common import packed
from salestide.session import durable

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.98
TREES, DEPTH = 12, 3
SEED = 7

# fixed values: the base rules, made possessive where a retry can't succeed
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_QUAD = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

# what the generators propose beside candidates of the base rules
_SPELLED_HINT = re.compile(r"[\[({](?:at|dot)[\])}]| dot ", re.I)
_SPELLED = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:[\[({]at[\])}]|@| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:[\[({]dot[\])}]| dot |\.) ?[A-Za-z0-9-]{1,63}){1,8}", re.I
)
_LOCAL_PHONE = re.compile(r"(?<![0-9])(?:00[0-9]{1,3}[ .-]?)?\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])")
_LOOSE_CARD = re.compile(r"(?<![0-9])[0-9]{4}(?:[ ./_-]{1,2}[0-9]{4}){3}(?![0-9])")
_CUES = tuple(re.compile(p, re.I) for p in (
    r"mail|contact", r"\bip\b|host|server|address", r"card|visa|credit|master", r"tel|phone|call|mobile|fax",
))
_NEAR = 24
# characters on both sides of a span in which it is rewritten
_AROUND = 4 * _NEAR

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for at, c in enumerate(reversed(digits)):
        d = int(c) * (1 + at % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _digits(part: str) -> str:
    return "".join(_DIGIT.findall(part))


def base_spans(text: str) -> list[Span]:
    """Spans of the base rules, by kind and start."""
    out = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _QUAD.finditer(text):
        # long parts are compared by length first: no number is built from them
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def candidates(text: str) -> list[Span]:
    """Overlapping proposals of all generators."""
    found = set()
    if "@" in text:
        found.update(("email", s, e) for s, e in _emails(text))
    if _SPELLED_HINT.search(text):
        found.update(("email", m.start(), m.end()) for m in _SPELLED.finditer(text))
    if _DIGIT.search(text):
        found.update(("ip", m.start(), m.end()) for m in _QUAD.finditer(text))
        for rule in (_CARD, _LOOSE_CARD):
            found.update(("card", m.start(), m.end()) for m in rule.finditer(text) if 9 <= len(_digits(m[0])) <= 24)
        for rule in (_PHONE, _LOCAL_PHONE):
            found.update(("phone", m.start(), m.end()) for m in rule.finditer(text) if m.end() - m.start() <= 64)
    return sorted(found)


FEATURES = (
    *(f"is_{k}" for k in KINDS), "length", "digits", "letters", "luhn", "groups", "small_parts", "plus", "at", "spelled", "last_letters",
    "separators", "joined_left", "joined_right", *(f"cue_{k}" for k in KINDS), "digits_around",
)


def features(text: str, span: Span) -> list[float]:
    kind, start, end = span
    part, before, after = text[start:end], text[max(0, start - _NEAR) : start], text[end : end + _NEAR]
    digits, groups = _digits(part), re.findall("[0-9]+", part)
    tail = re.search("[A-Za-z]*$", part)[0]
    return [
        *(float(kind == k) for k in KINDS), len(part), len(digits), sum(c.isalpha() for c in part),
        float(13 <= len(digits) <= 19 and luhn(digits)), len(groups), float(all(len(g) <= 3 and int(g) <= 255 for g in groups)),
        float(part[:1] == "+"), float("@" in part), float(_SPELLED_HINT.search(part) is not None), len(tail),
        len(set(re.findall("[^0-9A-Za-z]", part))), float(before[-1:].isalnum()), float(after[:1].isalnum()),
        *(float(c.search(before) is not None) for c in _CUES), len(_DIGIT.findall(before + after)),
    ]


def _rewritten(text: str, span: Span) -> Iterator[tuple[str, Span, float]]:
    """Other ways to write a base span, in its place: (text, span, label)."""
    kind, start, end = span
    part = text[start:end]
    forms: list[tuple[str, str, float]] = []
    if kind == "email":
        name, _, host = part.partition("@")
        forms = [("", f"{name} [at] {host.replace('.', ' [dot] ')}", 1), ("mail ", f"{name}(at){host.replace('.', '(dot)')}", 1),
                 ("contact ", f"{name} at {host.replace('.', ' dot ')}", 1)]
    elif kind == "phone":
        local = re.sub(r"^\+[0-9]{1,2} ?", "", part)
        forms = [("tel ", local, 1), ("phone: ", local, 1), ("no ", local, 0)]
    elif kind == "card" and len(digits := _digits(part)) == 16:
        fours = [digits[k : k + 4] for k in range(0, 16, 4)]
        wrong = digits[:-1] + str((int(digits[-1]) + 5) % 10)
        forms = [("card ", ".".join(fours), 1), ("", wrong, 0)]
    elif kind == "ip":
        forms = [("version ", "9" + part, 0), ("", part.replace(".", ".3", 1) + "00", 0)]
    for lead, form, label in forms:
        yield text[:start] + lead + form + text[end:], (kind, start + len(lead), start + len(lead) + len(form)), label


def _labelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for text, part in zip(batch["text"], batch["part"]):
            base = set(base_spans(text))
            for span in candidates(text):
                rows.append((part, float(span in base), *features(text, span)))
            for kind, start, end in base:
                # near by only, so that a text of many spans isn't copied for each
                left = max(0, start - _AROUND)
                around, span = text[left : end + _AROUND], (kind, start - left, end - left)
                rows += [(part, label, *features(t, s)) for t, s, label in _rewritten(around, span) if label or s not in base_spans(t)]
        found = pd.DataFrame(rows, columns=["part", "label", *FEATURES])
        yield found.groupby(["part", "label", *FEATURES], as_index=False).size().rename(columns={"size": "n"})


class Trees:
    """The fitted trees as arrays, for scoring in tasks."""

    def __init__(self, model) -> None:
        self.parts = []
        for tree, weight in zip(model.trees, model.treeWeights):
            rows: list[list[float]] = []
            self._flatten(tree._java_obj.rootNode(), rows)
            self.parts.append((weight, np.array(rows)))
        self.depth = model.getOrDefault("maxDepth")

    @classmethod
    def _flatten(cls, node, rows: list[list[float]]) -> int:
        at = len(rows)
        rows.append([-1, 0, at, at, node.prediction()])
        if hasattr(node, "leftChild") and "InternalNode" in node.getClass().getSimpleName():
            split = node.split()
            left, right = cls._flatten(node.leftChild(), rows), cls._flatten(node.rightChild(), rows)
            rows[at][:4] = [split.featureIndex(), split.threshold(), left, right]
        return at

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for weight, rows in self.parts:
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                feature = rows[at, 0].astype(int)
                right = x[np.arange(len(x)), np.maximum(feature, 0)] > rows[at, 1]
                at = np.where(feature < 0, at, np.where(right, rows[at, 3], rows[at, 2]).astype(int))
            total += weight * rows[at, 4]
        return total


def _thresholds(scored: DataFrame) -> dict[str, float]:
    """By kind, from (kind, label, n, score): the lowest score from which on the share of positives is at least PRECISION; none qualifies: infinite."""
    # a row per score of the trees; equal scores stand or fall together
    points = scored.groupBy("kind", "score").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("label")).alias("hits"))
    above = Window.partitionBy("kind").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    good = points.withColumn("share", F.sum("hits").over(above) / F.sum("n").over(above)).where(F.col("share") >= PRECISION)
    lowest = {r["kind"]: r["score"] for r in good.groupBy("kind").agg(F.min("score").alias("score")).collect()}
    return {k: lowest.get(k, float("inf")) for k in KINDS}


def examples(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(part, label, features, n): the labelled candidates of all documents, equal ones counted.

    Half of the documents, by the hash of their key, are part 0, the others part 1.
    """
    part = F.pmod(F.xxhash64(F.col(key), F.lit(SEED)), F.lit(2)).cast("int").alias("part")
    read = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("text"), part)
    schema = "part int, label double, " + ", ".join(f"{f} double" for f in FEATURES) + ", n long"
    return read.mapInPandas(_labelled, schema).groupBy("part", "label", *FEATURES).agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[Trees | None, dict[str, float]]:
    """(trees, threshold by kind) from all documents, one half for the trees and the other for the thresholds.

    Without candidates of both labels there are no trees, and the base rules stand alone.
    """
    found = durable(examples(docs, key, text))
    seen = {(r.part, r.label) for r in found.select("part", "label").distinct().collect()}
    if not {(0, 0.0), (0, 1.0)} <= seen:
        return None, {}
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(found.where("part = 0"))
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED, weightCol="n").fit(ready)
    trees = Trees(model)

    @F.pandas_udf("double")
    def score(*cells: pd.Series) -> pd.Series:
        return pd.Series(trees.score(np.column_stack(cells)))

    kind = F.coalesce(*[F.when(F.col(f"is_{k}") > 0, k) for k in KINDS])
    return trees, _thresholds(found.where("part = 1").select(kind.alias("kind"), "label", "n", score(*FEATURES).alias("score")))


def selected(text: str, trees: Trees | None, limits: dict[str, float]) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) of one text, by kind and start; an added span overlaps no other of any kind."""
    base = base_spans(text)
    if trees is None:
        return base, base
    taken = list(base)
    extra = [s for s in candidates(text) if all(s[2] <= b[1] or b[2] <= s[1] for b in base)] if len(base) < 1000 else _free(candidates(text), base)
    if extra:
        scores = trees.score(np.array([features(text, s) for s in extra]))
        # spans that are taken don't overlap, so a span can only meet its two neighbours
        added: list[tuple[int, int]] = []
        for score, span in sorted(zip(-scores, extra)):
            if -score < limits[span[0]]:
                continue
            at = bisect.bisect_left(added, (span[1], span[2]))
            if (at == 0 or added[at - 1][1] <= span[1]) and (at == len(added) or span[2] <= added[at][0]):
                added.insert(at, (span[1], span[2]))
                taken.append(span)
    return base, sorted(taken, key=lambda s: (KINDS.index(s[0]), s[1]))


def _free(found: list[Span], base: list[Span]) -> list[Span]:
    """Spans that overlap no base span, by one look at the sorted base."""
    starts = np.array(sorted((b[1], b[2]) for b in base))
    reach = np.maximum.accumulate(starts[:, 1])
    at = np.searchsorted(starts[:, 0], [s[2] for s in found])
    return [s for s, k in zip(found, at) if k == 0 or reach[k - 1] <= s[1]]


_SPANS = ArrayType(StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("stop", IntegerType())]))


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``row`` (the document), base and spans: arrays of (kind, start, stop) in code points.

    A null text is empty and has no spans.  Repeated rows get the same answer;
    nothing is shuffled.
    """
    trees, limits = fit(docs, key, text)

    @F.pandas_udf(StructType([StructField("base", _SPANS), StructField("spans", _SPANS)]))
    def scan(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        as_rows = lambda spans: [{"kind": k, "start": s, "stop": e} for k, s, e in spans]
        for batch in texts:
            both = [selected(t or "", trees, limits) for t in batch]
            yield pd.DataFrame({"base": [as_rows(b) for b, _ in both], "spans": [as_rows(a) for _, a in both]})

    found = docs.select(packed(docs).alias("row"), scan(F.col(text)).alias("found"))
    return found.select("row", "found.base", "found.spans")


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with every selected span replaced by its kind in brackets."""
    found = find(docs, key, text)
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    body = F.col("row")[text]
    done = F.aggregate(
        ordered, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda a, s: F.struct(
            F.concat(a["out"], F.substring(body, a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0))), F.lit("["), s["kind"], F.lit("]")).alias("out"),
            F.greatest(a["at"], s["stop"]).alias("at"),
        ),
        lambda a: F.concat(a["out"], F.substring(body, a["at"] + 1, F.length(body))),
    )
    return found.select(*[(done if c == text else F.col("row")[c]).alias(c) for c in docs.columns])
