"""Language identification: held-out accuracy, the fusion against a plain version, odd rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from salestide.llm import langid

WORDS = {"en": "the of and to that thing with was".split(), "de": "der die und nicht schön über zeit für".split(), "fr": "le où des été que leçon pour très".split()}


def sentence(rnd, lang, n):
    return " ".join(rnd.choice(WORDS[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(1)
    rows = [(i, sentence(rnd, lang, rnd.randrange(3, 60)), lang, rnd.choice(["hot", f"s{lang}"])) for i in range(600) for lang in [rnd.choice(list(WORDS))]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").cache()


def test_held_out_accuracy(spark, docs):
    model = langid.fit(docs.where("doc_id < 300"))
    rows = langid.document_rows(docs.where("doc_id >= 300").withColumn("truth", F.col("lang")).withColumn("lang", F.lit(None).cast("string")), F.struct("doc_id", "truth"))
    got = langid.fused(rows, model).collect()
    assert sum(r.language == r.row.truth for r in got) / len(got) > 0.97


def test_fusion_matches_plain_version(spark, docs):
    model = langid.fit(docs)
    rnd = random.Random(7)
    data = [(i, sentence(rnd, rnd.choice(list(WORDS)), rnd.randrange(1, 6)), rnd.choice([None, "en", "de"]), rnd.choice([None, "a.x.org", "b.x.org", "c.y.fr"])) for i in range(60)]
    rows = spark.createDataFrame(data, "id long, text string, declared string, host string").select(
        F.struct("id").alias("row"), "text", "declared", "host", langid.domain_of(F.col("host")).alias("domain"), langid.suffix_of(F.col("host")).alias("suffix"))
    got = {r.row.id: r for r in langid.fused(rows, model).collect()}
    names = [*model.languages, "und"]
    w = len(names)
    full = [(i, model.score(t), d, h, h and ".".join(h.split(".")[-2:]), h and h.split(".")[-1]) for i, t, d, h in data]
    top = {r[0]: int(np.argmax(r[1])) for r in full}
    flat = np.array([sum(t == k for t in top.values()) for k in range(w)], float)
    flat[-1] = min(flat[-1], 0.01 * flat.sum())
    spread = (flat + 1) / (flat.sum() + w)

    def counts(at, value, own):
        n = np.array([float(sum(1 for r in full if r[at] == value and value is not None and top[r[0]] == k)) for k in range(w)])
        n[own] = max(0.0, n[own] - 1)
        return n

    for r in full:
        own = top[r[0]]
        smooth = lambda n, toward: (n + 10 * toward) / (n.sum() + 10)
        evidence = np.array(r[1]) + np.log(smooth(counts(3, r[3], own), smooth(counts(4, r[4], own), spread)))
        for at in (5, 2):
            if r[at] is not None:
                evidence += np.log(smooth(counts(at, r[at], own), spread) / spread)
        best = int(np.argmax(evidence))
        assert got[r[0]].language == names[best]
        assert math.isclose(got[r[0]].posterior, 1 / np.exp(evidence - evidence[best]).sum(), rel_tol=1e-9)


def test_odd_rows_and_kept_columns(spark, docs):
    odd = [(1000, None, "en", "x"), (1001, "", None, None), (1002, "1234 !!! ###", "de", "hot"), (1003, "zqxj vwkq qzxv jjqk xqzw kvqj wqzx", "en", "hot"), (None, "the of and to that", None, None),
           (1004, "the of and " * 400_000, "en", "hot")]
    both = docs.union(spark.createDataFrame(odd + odd[:1], docs.schema)).withColumn("language", F.lit(1))
    kept = langid.kept(both)
    assert kept.columns == both.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert ids == set(range(600)) | {None, 1004}
    assert langid.kept(both.where("doc_id < 0")).count() == 0


def test_page_evidence(spark):
    rows = [("http://u@www.Example.co.fr:80/de/1?x", '<html class="a" LANG=\'FR-ca\'><p>x'), ("no url", "<p lang='de'>"), (None, None)]
    page = spark.createDataFrame(rows, "url string, html string")
    got = page.select(langid.host_of(F.col("url")), langid.domain_of(langid.host_of(F.col("url"))), langid.suffix_of(langid.host_of(F.col("url"))), langid.markup_language(F.col("html"))).collect()
    assert [tuple(r) for r in got] == [("www.example.co.fr", "co.fr", "fr", "fr"), (None, None, None, None), (None, None, None, None)]


def test_rare_language_of_a_large_table_has_a_model(spark):
    rnd = random.Random(2)
    rows = [(i, sentence(rnd, "en", 9), "en", "s") for i in range(20_000)]
    rows += [(50_000 + i, "το και της με που για από ένα", "el", "s") for i in range(8)] + [(60_000 + i, "ten jest nie tak", "pl", "s") for i in range(4)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert langid.fit(table).languages == ["el", "en"]
    assert langid.kept(table).where("lang = 'el'").count() == 8
