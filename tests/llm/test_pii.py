import hashlib
import random
import re

from vitalscope.llm import pii

from .helpers import LONG, docs_of, empty_docs

PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def brute(text):
    out = []
    for n, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
            fine = {
                "email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")), "phone": lambda: 9 <= len(digits) <= 15,
                "card": lambda: 12 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0,
            }[kind]()
            if fine:
                out.append((m.start(), n, kind, m.end()))
    return [(s, k, e) for s, _, k, e in sorted(out)]


def test_base_spans_equal_the_patterns():
    random.seed(3)
    pieces = ["a", "b@", "@", "c.d", ".", "-", "+1", " ", "(", "12", "3", "255.", "4111 1111 1111 1111", "+1 (555) 555-0100", "é"]
    for _ in range(5000):
        text = "".join(random.choice(pieces) for _ in range(random.randint(0, 14)))
        assert brute(text) == pii.base_spans(text), text


def messy(spark):
    random.seed(4)
    digits = lambda n: "".join(random.choice("0123456789") for _ in range(n))
    rows = [(i, f"Text {i}. Write to mailbox: user{i}@host{i % 7}.example.com today, line {i} ends.") for i in range(60)]
    rows += [(100 + i, f"Please write to mailbox: user{i}(at)host{i} today, thanks.") for i in range(5)]
    rows += [(200 + i, f"the value {digits(7)} is a count of things") for i in range(40)]
    return rows + [(300, None), (301, ""), (302, LONG), (None, "a@b.cd"), (1, rows[1][1])]


def test_contexts_discover_new_identifiers(spark):
    rows = messy(spark)
    got = {r["doc_id"]: r for r in pii.extract(docs_of(spark, rows)).collect()}
    texts = dict(rows)
    for i in range(5):
        kind, start, end = got[100 + i]["spans"].split(":")
        assert kind == "email" and texts[100 + i][int(start):int(end)] == f"user{i}(at)host{i}"
        assert got[100 + i]["n_email"] == 0 and got[100 + i]["n_added"] == 1
    assert all(got[200 + i]["spans"] == "" for i in range(40))


def test_contract_columns_and_edges(spark):
    rows = messy(spark)
    got = pii.extract(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        base = pii.written(brute(texts[r["doc_id"]] or ""))
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(base.split(",")) - {""} <= set(r["spans"].split(","))
    assert pii.extract(empty_docs(spark)).collect() == []


def test_redaction(spark):
    rows = messy(spark)
    clean = pii.redact(docs_of(spark, rows))
    got = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert clean.columns == docs_of(spark, rows).columns and clean.count() == len(rows)
    assert got[2] == "Text 2. Write to mailbox: [EMAIL] today, line 2 ends." and got[300] is None and got[302] == LONG
    assert got[101] == "Please write to mailbox: [EMAIL] today, thanks."


def test_spaced_phones_and_cards_behind_learned_contexts(spark):
    random.seed(8)
    digits = lambda n: "".join(random.choice("0123456789") for _ in range(n))

    def card(fine):
        while True:
            d = digits(16)
            if pii.luhn(d) == fine:
                return " ".join(d[i:i + 4] for i in range(0, 16, 4))
    rows = [(i, f"Reach {i}: call me at +49 30 {digits(3)} {digits(4)} today") for i in range(60)]
    rows += [(100 + i, f"Order {i}: charged card number {card(True)} yesterday") for i in range(60)]
    phones = [f"0171 555 01{i}3" if i % 2 else f"(555) 555-01{i}0" for i in range(6)]
    cards = [card(False) for _ in range(6)]
    rows += [(200 + i, f"Please call me at {p} today") for i, p in enumerate(phones)]
    rows += [(300 + i, f"I charged card number {c} yesterday") for i, c in enumerate(cards)]
    rows += [(400 + i, f"sizes are {digits(3)} {digits(3)} {digits(4)} in all") for i in range(20)]
    got = {r["doc_id"]: r["text"] for r in pii.redact(docs_of(spark, rows)).collect()}
    assert all(got[200 + i] == "Please call me at [PHONE] today" for i in range(6))
    assert all(got[300 + i] == "I charged card number [CARD] yesterday" for i in range(6))
    assert all(got[i] == t for i, t in rows if i >= 400)
