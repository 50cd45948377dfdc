"""Personal data: strict spans against Python's regular expressions, what the trees add, and the array helpers."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from pairlens.llm import personal_data as pd_

STRICT = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
ODD = [
    None, "", "no data", "a@b.c_d@e.f x@y", "a.b@c.d.e..f@g.h", "é@a.b ü\U0001F600 +49 (30) 123-4567.", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255 1.2.3.0300", "4111 1111-1111 1111x 4111111111111112",
    "+4 4111111111111111 +123456789", "4111  1111 1111 1111", "+1 (2", "7" * 500, "1-" * 3000, "a" * 5000 + "@", "x" * 3000 + "@y.z", "mail me: a@b.co, a@b.co; a@b.co", "1.1.1.1" * 50, "+1 23 456 78 90" * 40,
]


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in doubled) % 10 == 0


def strict(text):
    found = []
    for kind, pattern in STRICT.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            held = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.group().split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}
            if held[kind]:
                found.append((kind, m.start(), m.end()))
    return found


def card(i):
    stem = f"{4000_0000_0000_000 + i * 7_919_013}"
    return next(stem + str(k) for k in range(10) if luhn(stem + str(k)))


@pytest.fixture(scope="module")
def docs(spark):
    rows = list(enumerate(ODD)) + [(2, "no data"), (None, "x@y.org")]
    rows += [(1000 + i, f"word {i} write to user{i}@mail{i % 9}.example.org or call +49 {300 + i % 90} 555-{1000 + i} card {card(i)} from 10.{i % 250}.3.{i % 200}; order {10**15 + i * 37} v{i}.300.{i}.400") for i in range(120)]
    return spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, kind string, `found.x` int").repartition(3)


@pytest.fixture(scope="module")
def model(docs):
    return pd_.fit(docs)


def test_strict_spans_stay(docs, model):
    rows = pd_.digest(pd_.find(docs, model)).collect()
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    assert len(rows) == len(texts)
    want = sorted(((i, *(sum(s[0] == k for s in strict(t)) for k in STRICT), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in strict(t)).encode()).hexdigest()) for i, t in texts), key=repr)
    assert sorted(((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in rows), key=repr) == want
    for r in rows:
        held = {f"{k}:{a}:{b}" for i, t in texts if i == r.doc_id for k, a, b in strict(t)}
        assert held <= set(r.spans.split(",")) or not held
    assert pd_.find(docs.limit(0), model).count() == 0
    assert pd_.fit(docs.limit(0)) == pd_.Model((), (None,) * 4, ((),) * 4)


def test_trees_add_other_spellings_and_leave_decoys(spark, model):
    assert len(model.trees) == pd_.ROUNDS and None not in model.bounds[:3]
    text = f"word 5 write to jürgén@mäil.example.org or pay with {card(5)[:4]}.{card(5)[4:8]}.{card(5)[8:12]}.{card(5)[12:]} order 1000000000000037 v1.300.2.400"
    got = pd_.find(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).collect()[0].found
    kinds = [(pd_.KINDS[s.kind], text[s.start:s.end], s.base) for s in got]
    assert ("card", f"{card(5)[:4]}.{card(5)[4:8]}.{card(5)[8:12]}.{card(5)[12:]}", False) in kinds
    assert not any("1000000000000037" in t or "300" in t for _, t, _ in kinds)


def test_marks_teach_a_new_format(spark):
    rows = [(i, f"ring (030) {200000 + 137 * i} or see part 0{500 + i}-{300000 + i} in stock") for i in range(80)]
    marks = [(i, 5, 17) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    taught = pd_.fit(docs.filter("doc_id < 60"), spark.createDataFrame(marks, "doc_id long, start int, end int"))
    found = pd_.find(docs.filter("doc_id >= 60"), taught).collect()
    assert all([(s.start, s.end) for s in r.found] == [(5, 17)] for r in found)
    assert not any(r.found for r in pd_.find(docs, pd_.fit(docs)).collect())


def test_redacted_text(spark, model):
    text = "é to a@b.co, 1.2.3.4 and 4111111111111111 end"
    got = pd_.redacted(pd_.find(spark.createDataFrame([(1, text), (2, None), (3, "plain")], "doc_id long, text string"), model)).collect()
    assert [r.redacted for r in sorted(got)] == ["é to [EMAIL], [IP] and [CARD] end", "", "plain"]


@pytest.mark.parametrize("n", [0, 1, 3, 64, 65, 200])
def test_running_in_blocks(spark, n):
    values = [(7 * i) % 31 - 9 for i in range(n)]
    row = spark.createDataFrame([(values,)], "v array<bigint>").select(pd_.running(F.col("v"), lambda a, b: a + b).alias("s"), pd_.running(F.col("v"), F.greatest, 4).alias("m")).first()
    assert row.s == [sum(values[:i + 1]) for i in range(n)] and row.m == [max(values[:i + 1]) for i in range(n)]


def test_shares_rise():
    assert pd_._isotonic([(0, 0.0, 4.0), (1, 3.0, 4.0), (2, 2.0, 4.0), (3, 4.0, 4.0)]) == [(0, 0.0), (1, 0.625), (2, 0.625), (3, 1.0)]
