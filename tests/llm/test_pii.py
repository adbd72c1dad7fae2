"""Personal data: base rules against plain patterns, trees on held-out rewritten cases."""

import random
import re
import time

import numpy as np

from salestide.llm import pii


def plain_base(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        total = sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(digits[::-1]))
        if 13 <= len(digits) <= 19 and total % 10 == 0:
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def test_base_rules_match_plain_patterns():
    rnd = random.Random(3)
    parts = ["a@b.c", "x.y+z@", "@", ".", "_d@e.f", "1.2.3.4", "255.256.1.1", "0001.002.3.4", ".5.6", "4041894974608795", "4041 8949-7460 8795",
             "+1 (626) 555-5759", "+", "é", " ", "-", "7", "\n", "a-b", "(", "0"]
    for _ in range(4000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 14)))
        assert pii.base_spans(text) == plain_base(text), text


def test_long_runs_take_linear_time():
    began = time.time()
    for text in ("a" * 2_000_000, "1" * 2_000_000, "1." * 500_000, "+1" * 500_000, "a@" * 500_000, "+1" + " " * 1_000_000):
        pii.base_spans(text)
    assert time.time() - began < 30


def _docs(spark):
    rnd = random.Random(11)
    words = ["lorem", "ipsum", "dolor", "sit", "amet", "consectetur", "elit"]

    def filler():
        return " ".join(rnd.choice(words) for _ in range(12))

    def card():
        head = "4" + "".join(str(rnd.randrange(10)) for _ in range(14))
        return next(head + str(d) for d in range(10) if pii.luhn(head + str(d)))

    rows = []
    for i in range(400):
        kind = i % 5
        item = (f"{rnd.choice('abc')}{rnd.choice('xyz')}.{i}@mail{i % 7}.example.com", ".".join(str(rnd.randrange(1, 255)) for _ in range(4)),
                card(), f"+1 ({rnd.randrange(200, 999)}) 555-{rnd.randrange(1000, 9999)}", str(rnd.randrange(10**9, 10**15)))[kind]
        rows.append((i, f"{filler()} {item} {filler()}"))
    rows += [(1000, None), (1001, ""), (1001, ""), (1002, "write to jane [at] corp [dot] org today"), (1003, "version 1234 5678 9012 of the list"),
             (1004, "é tel (626) 555-5759 x")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_trees_add_to_the_base(spark):
    docs = _docs(spark)
    got = {r.row.doc_id: r for r in pii.find(docs).collect()}
    for r in got.values():
        base = [(b.kind, b.start, b.stop) for b in r.base]
        assert base == plain_base(r.row.text or "")
        assert set(base) <= {(b.kind, b.start, b.stop) for b in r.spans}
    assert got[1000].spans == got[1001].spans == []
    assert [(s.kind, got[1002].row.text[s.start : s.stop]) for s in got[1002].spans] == [("email", "jane [at] corp [dot] org")]
    assert got[1003].spans == []
    assert [(s.kind, got[1004].row.text[s.start : s.stop]) for s in got[1004].spans] == [("phone", "(626) 555-5759")]
    held = [r for r in got.values() if r.row.doc_id < 400 and r.row.doc_id % 5 == 4]
    # plain numbers are left alone, as far as they pass no base rule
    assert sum(len(r.spans) > len(r.base) for r in held) == 0


def test_redacted_text_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a a@b.c z 1.2.3.4", 5), (2, None, 6)], "doc_id long, text string, spans int")
    assert sorted(map(tuple, pii.redact(docs).collect())) == [(1, "a [email] z [ip]", 5), (2, None, 6)]
    assert pii.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_many_added_spans_take_near_linear_time():
    class Sure:
        def score(self, x):
            return 0.9 + 0.05 * np.sin(np.arange(len(x)))

    text = "call 555 123 4567 now, " * 8_000
    start = time.time()
    base, spans = pii.selected(text, Sure(), dict.fromkeys(pii.KINDS, 0.5))
    assert time.time() - start < 20 and len(spans) >= 8_000 and set(base) <= set(spans)
    ends = sorted((s, e) for _, s, e in spans[len(base):])
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))


def test_the_fit_reads_all_documents(spark):
    texts = {i: f"mail user{i}@host.example.com or 10.0.{i % 250}.7" for i in range(9_000)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = pii.examples(docs).where("label = 1 and spelled = 0").selectExpr("sum(n * is_email) email", "sum(n * is_ip) ip", "count(*) many").first()
    # every base span of every document, equal ones merged
    assert (rows.email, rows.ip) == (9_000, 9_000) and rows.many < 100


def test_examples_of_many_spans_take_near_linear_time():
    start = time.time()
    part = next(pii._labelled(iter([pii.pd.DataFrame({"text": ["a@b.example 4111111111111111 " * 8_000], "part": [0]})])))
    assert time.time() - start < 60 and part["n"].sum() >= 16_000


def test_thresholds_weigh_examples(spark):
    rows = [("email", 1.0, 98, 0.9), ("email", 0.0, 2, 0.9), ("email", 1.0, 49, 0.5), ("email", 0.0, 1, 0.5), ("email", 0.0, 9, 0.1), ("ip", 0.0, 5, 0.9)]
    got = pii._thresholds(spark.createDataFrame(rows, "kind string, label double, n long, score double"))
    assert got == {"email": 0.5, "ip": float("inf"), "card": float("inf"), "phone": float("inf")}
