import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from vitalscope.llm import conversations

from .helpers import sorted_rows

SCHEMA = "conv_id long, turn long, role string, text string"


def best_edits(rows):
    """(cost, audit) of rows (initial, must go, cut off), by all edits from the end."""
    order = {"": "", "s": "s", "u": "u", "a": "a"}
    fine = {("", "s"), ("", "u"), ("s", "u"), ("a", "u"), ("u", "a")}

    @lru_cache(None)
    def best(i, last, inserted=0):
        ways = []
        if i == len(rows):
            if last in ("", "a"):
                ways.append((0, ""))
        else:
            initial, gone, cut = rows[i]
            ways.append((lambda c, a: (c + 4, "D" + a))(*best(i + 1, last)))
            if not gone:
                if (last, initial) in fine:
                    ways.append((lambda c, a: (c + 3 * cut, "K" + a))(*best(i + 1, initial)))
                for new in "ua":
                    if (last, new) in fine:
                        ways.append((lambda c, a: (c + 3 + 3 * cut, "R" + a))(*best(i + 1, new)))
        if inserted < 3:
            for new in "ua":
                if (last, new) in fine:
                    ways.append((lambda c, a: (c + 3, "I" + a))(*best(i, order[new], inserted + 1)))
        return min(ways, default=(10**9, ""))
    return best(0, "")


def brute(rows, damage=True):
    text_of = lambda x: " " if x is None else str(x)
    groups = {}
    for conv, turn, role, text in rows:
        own = groups.setdefault(conv, [])
        role, text = text_of(role), text_of(text)
        kind = zlib.crc32(f"{text_of(conv)}:{text_of(turn)}".encode()) % 20 if damage else 9
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        own += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, facts, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in own:
            bare = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            facts.append((role[:1] or "-", fault in ("blank", "duplicate"), fault == "truncated"))
        turns = [t for t, _, _ in own if t is not None]
        initials = [r[:1] for _, r, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = best_edits(facts)
        lines, last, left = [], "", list(own)
        for edit in audit:
            new = "a" if last == "u" else "u"
            if edit == "I":
                lines.append({"u": "user", "a": "assistant"}[new] + ":")
                last = new
                continue
            _, role, text = left.pop(0)
            if edit == "R":
                role, last = {"u": "user", "a": "assistant"}[new], new
            elif edit == "K":
                last = role[:1]
            if edit != "D":
                lines.append(f"{role}:{text}")
        assert not left and re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
        out.append((
            conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts.values(), illegal, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


@pytest.fixture(scope="module")
def rows():
    rng, out = random.Random(11), []
    texts = ["Hello there.", "Cut off here", "", " \t", "Done!", "Ünïcode end?", "no stop", "x" * 30_000 + "."]
    for conv in range(150):
        for turn in range(rng.choice([1, 2, 3, 5, 8, 13, 21])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User", "staff"])
            if rng.random() < 0.6:
                role = ["user", "assistant"][turn % 2]
            text = rng.choice(texts) if rng.random() < 0.4 else f"Text {rng.random()}."
            out.append((conv if conv != 7 else None, None if rng.random() < 0.05 else turn + rng.choice([0, 0, 0, 5]), role, None if rng.random() < 0.05 else text))
    return out + out[:6] + [(900, 1, "user", "same.")] * 40


def run(spark, rows, parts=3, damage=True, **more):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS m", "'clash' AS known", "'clash' AS conv", "'clash' AS times_", "'x' AS seen", "2 AS part")
    df = df.repartition(parts)
    if damage:
        return conversations.repair(conversations.damaged(df), times="times", **more)
    return conversations.repair(df, **more)


@pytest.mark.parametrize("damage,parts", [(True, 3), (False, 8)])
def test_equals_brute_force(spark, rows, damage, parts):
    assert sorted_rows(run(spark, rows, parts, damage).collect()) == sorted_rows(brute(rows, damage))


def test_one_conversation_over_many_segments(spark, rows, monkeypatch):
    monkeypatch.setattr(conversations, "SEGMENT_ROWS", 7)
    rng = random.Random(3)
    hot = [(5, i // 2, rng.choice(["user", "assistant", "system", "x"]), rng.choice(["One.", "Two", "", f"{i} three."])) for i in range(400)]
    hot += [(6, 1, "user", f"{i} tie.") for i in range(60)] + [(6, None, "assistant", "same.")] * 30
    data = hot + [r for r in rows if r[0] != 5 and r[0] != 6]
    assert sorted_rows(run(spark, data, damage=False).collect()) == sorted_rows(brute(data, damage=False))


def test_block_lookups_equal_single_steps():
    import numpy as np

    t, rng = conversations.Tables(), random.Random(5)
    for n in range(0, 30):
        symbols = [rng.randrange(conversations.SYMBOLS) for _ in range(n)]
        for end in range(len(t.vectors)):
            costs = list(t.vectors[end])
            for symbol in reversed(symbols):
                costs = conversations._before(tuple(costs), symbol)
            _, at, total = t.boundaries(np.array(symbols, np.int64), end)
            assert [c + total if c < conversations.FAR else None for c in t.vectors[at]] == [c if c < conversations.FAR else None for c in costs]


def test_edges(spark):
    from pyspark.sql import functions as F

    empty = spark.createDataFrame([], SCHEMA)
    assert run(spark, [(1, 1, "user", "a.")], damage=False, texts=True).first()["repaired"] == "user:a.\nassistant:"
    assert conversations.repair(empty).collect() == []
    gone = spark.createDataFrame([(4, 2, "user", "a.")], SCHEMA).withColumn("times", F.lit(0))
    zero = hashlib.sha256(b"").hexdigest()
    assert [tuple(r) for r in conversations.repair(gone, times="times").collect()] == [(4, 0, 0, 0, 0, 0, 0, "", zero)]
