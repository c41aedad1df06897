import hashlib
import math
import random
import re
from collections import defaultdict

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pathloom.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False, "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), pii.KINDS.index(kind), m.end()))
    return sorted(out)


@given(st.text(alphabet="a@.1+- (9é%\n0", max_size=40))
@settings(max_examples=800, deadline=None)
def test_spans_are_those_of_the_plain_patterns(text):
    assert pii.base_spans(text) == brute(text)


def test_linear_on_hostile_texts():
    for text in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "+1" + "(" * 200_000, "1." * 150_000, "1 " * 150_000, "+" * 200_000):
        pii.base_spans(text)


def corpus():
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(500)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    docs = [(i, text(rng.randrange(0, 60))) for i in range(120)]
    for k in range(6):
        docs.append((200 + k, f"{text(12)} Zorblax, writes as ann.lee@mail.example {text(10)}"))
    for k in range(5):
        docs.append((300 + k, f"{text(9)} 10.1.2.{k} paid 4111 1111 1111 1111 +1 (988) 555-2485 {text(9)}"))
    same = f"{text(9)} quuxly bo@b.example {text(9)}"
    docs += [(400 + k, same) for k in range(5)]  # copies prove nothing
    docs += [(500, None), (501, ""), (None, "x y@z.example é"), (None, "x y@z.example é"), (200, docs[0][1])]
    return docs


def test_find_report_and_terms(spark):
    docs = corpus()
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("spans", F.lit("x")).withColumn("term", F.lit(3))
    got = pii.report(pii.find(table)).collect()
    assert len(got) == len(docs)
    want = defaultdict(list)
    n = len(docs)
    near, with_entity, with_term, around = defaultdict(set), defaultdict(set), defaultdict(set), defaultdict(set)  # of rows
    for row, (_, t) in enumerate(docs):
        for w in re.findall(pii._WORD, t or ""):
            with_term[pii._hash(pii.term_of(w))].add(row)
        for entity, term, context, _, _ in pii.near_terms(t, brute(t)) if brute(t) else []:
            near[entity, term].add(row)
            with_entity[entity].add(row)
            around[entity, term].add(context)
    for i, t in docs:
        spans = set(brute(t))
        for entity, term, _, a, b in pii.near_terms(t, brute(t)) if spans else []:
            p = len(near[entity, term]) * n / (len(with_entity[entity]) * len(with_term[term]))
            if len(around[entity, term]) >= pii.SUPPORT and math.log(p) / math.log(n / len(with_entity[entity])) >= pii.THRESHOLD:
                spans.add((a, 4, b))
        base = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in brute(t))
        counts = [sum(k == x for _, k, _ in brute(t)) for x in range(4)]
        want[i].append((*counts, hashlib.sha256(base.encode()).hexdigest(), ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))))
    have = defaultdict(list)
    for r in got:
        have[r.doc_id].append((r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    assert any("term" in r.spans for r in got if r.doc_id and 200 <= r.doc_id < 206)
    assert not any("term" in r.spans for r in got if r.doc_id and 400 <= r.doc_id < 406)
    assert pii.report(pii.find(table.limit(0))).collect() == []


def test_sanitise(spark):
    docs = corpus()
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("source", F.lit("s"))
    got = pii.sanitise(table)
    assert got.columns == table.columns
    out = defaultdict(list)
    for r in got.collect():
        out[r.doc_id].append(r.text)
    assert sum(map(len, out.values())) == len(docs)
    assert all("Zorblax" not in out[i][-1] and "[EMAIL]" in " ".join(out[i]) for i in range(201, 206))
    assert "[IP]  [CARD] [PHONE]" in out[300][0] and out[500] == [None]  # "paid" is only ever near such values
    assert all(t in out[i] for i, t in docs if not brute(t))


def test_terms_far_from_their_entity(spark):
    rng = random.Random(3)
    text = lambda n: " ".join(f"w{rng.randrange(300)}" for _ in range(n))
    docs = [(i, text(40)) for i in range(200)]
    docs += [(300 + k, f"Quixby {text(20)} {text(9)} q.b@mail.example {text(9)} {text(30)} Quixby, {text(3)}") for k in range(4)]
    docs += [(400 + k, f"Varnol {text(15)} v@{k}.example {text(3)} Varnol {text(15)} varnol.") for k in range(3)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    out = {r.doc_id: r.text.lower() for r in pii.sanitise(table).collect()}
    assert not any("quixby" in out[300 + k] for k in range(4))
    assert not any("varnol" in out[400 + k] for k in range(3))
    spans = {r.doc_id: r.spans for r in pii.report(pii.find(table)).collect()}
    assert all(f"term:{t.index('Quixby')}:" in spans[i] and f"term:{t.rindex('Quixby')}:" in spans[i] for i, t in docs if 300 <= i < 400)


def test_copies_change_no_term(spark):
    """The same documents once and 20 times, under ids of their own or repeated ones, give the same terms."""
    rng = random.Random(4)
    text = lambda n: " ".join(f"w{rng.randrange(200)}" for _ in range(n))
    named = [(k, f"{text(12)} Zorblax writes as ann.lee@mail.example {text(10)}") for k in range(6)]
    plain = [(100 + k, text(30)) for k in range(200)]
    for repeated in (named, named * 20, [(1000 * c + i, t) for c in range(20) for i, t in named]):
        table = spark.createDataFrame(repeated + plain, "doc_id long, text string")
        got = [(r.doc_id, r.spans) for r in pii.report(pii.find(table)).collect()]
        assert len(got) == len(repeated) + len(plain)
        texts = dict(repeated + plain)
        assert sum(f"term:{texts[i].index('Zorblax')}:" in spans for i, spans in got if "Zorblax" in texts[i]) == len(repeated)
        assert not any(spans for i, spans in got if "Zorblax" not in texts[i])


def test_a_document_of_very_many_spans(spark, monkeypatch):
    text = " ".join(f"word{k % 50} a{k % 20_000}@b.example" for k in range(100_000))
    table = spark.createDataFrame([(1, text), (2, "c d"), (None, text[:2000])], "doc_id long, text string")
    got = {r.doc_id: r.n_email for r in pii.report(pii.find(table)).collect()}
    assert got == {1: 100_000, 2: 0, None: len(brute(text[:2000]))}
    slices = list(pii.surroundings(text, pii.base_spans(text)))
    assert len(slices) == 50 and max(len(n) for _, n, _ in slices) <= 2 * pii.SLICE * 2 * pii.NEAR


def test_slices_change_nothing(spark, monkeypatch):
    table = spark.createDataFrame(corpus(), "doc_id long, text string")
    whole = sorted(map(str, pii.report(pii.find(table)).collect()))
    monkeypatch.setattr(pii, "SLICE", 1)
    assert sorted(map(str, pii.report(pii.find(table)).collect())) == whole
