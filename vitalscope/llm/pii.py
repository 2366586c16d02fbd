"""Personal data by base patterns and bootstrapped contextual extraction.

Base spans (e-mail, IP, card, phone) are the seeds. Every word with a digit or an
``@`` is a possible identifier, and so is a run of digit groups over several words
(``DIGITS`` digits, as a phone or a card may have). A possible identifier's surroundings are lexical patterns: the
words before and after, a key before ``=`` or ``:`` and the word's letter shape.
Patterns and identifiers form a graph. Spark scores it in rounds: a pattern is as
good for a kind as the share of its identifiers that belong to the kind, and an
identifier's score combines its good patterns. Identifiers whose score reaches
``ACCEPT`` are added as spans wherever they occur outside the base spans.

Texts are read once and each by itself. The graph holds short strings; counts
per pattern and per identifier are summed before every shuffle, only good patterns
are joined, and hot keys are served apart.

Defined cases: null text is empty; repeated rows give repeated results; spans are
in code points, their end exclusive; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vitalscope.operators.skew import lookup_join

from .common import fresh, released, stored, with_id

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
SUPPORT = 5  # different identifiers of a kind that a pattern needs
GOOD = 0.7  # least share of the kind among a pattern's identifiers
ACCEPT = 0.95
LONGEST = 64  # letters of an identifier that the method adds
DIGITS = {"phone": (7, 15), "card": (12, 19)}  # digits of a run of groups

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_POSSIBLE = re.compile(r"[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*")
_GROUPS = re.compile(r"(?<![^\x20\x09-\x0D=:\"'\[(])\(?[0-9]+(?:(?:\x20\(?|[.-]|\)[\x20-]?|\()[0-9]+)+")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = ".,;:!?()[]{}<>'\"*"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _emails(text: str):
    """The local part reaches left from an ``@`` to the match before, the domain right."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            done = match.end()
            yield start, done
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) by start, then kind as listed."""
    spans = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                spans.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                spans.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                spans.append((m.start(), 3, m.end()))
    return [(s, KINDS[k], e) for s, k, e in sorted(spans)]


def written(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


def shape(word: str) -> str:
    """Runs of letters and digits by their class and, up to 20, length; other characters stand for themselves."""
    runs = re.findall(r"[a-z]+|[A-Z]+|[0-9]+|.", word)
    return "".join("9" + str(min(len(r), 20)) if r[0].isdigit() else "a" if r[0].islower() else "A" if r[0].isupper() else r for r in runs)


def _patterns(text: str, start: int, end: int, value: str) -> list[str]:
    before = [w.strip(_EDGE).lower() for w in _WORD.findall(text[max(0, start - 80):start])[-2:]]
    after = _WORD.match(text[end:end + 80].lstrip(" \t\n\x0b\x0c\r"))
    out = ["s:" + shape(value)]
    if before and before[-1]:
        out.append("l:" + before[-1])
        if len(before) == 2 and before[0]:
            out.append("ll:" + " ".join(before))
    if after and after[0].strip(_EDGE):
        out.append("r:" + after[0].strip(_EDGE).lower())
    if start and text[start - 1] in "=:":
        key = _WORD.findall(text[max(0, start - 40):start - 1])
        if key:
            out.append("k:" + key[-1].lower())
    return out


def identifiers(text: str, base: list[tuple[int, str, int]]) -> list[tuple[str, str | None, int, int, list[str]]]:
    """(value, kind of the seed or None, start, end, patterns) of all possible identifiers."""
    out = [(text[s:e].lower(), k, s, e, _patterns(text, s, e, text[s:e])) for s, k, e in base if e - s <= LONGEST]
    taken = sorted((s, e) for s, _, e in base)
    i = 0
    for m in _POSSIBLE.finditer(text):
        while i < len(taken) and taken[i][1] <= m.start():
            i += 1
        if i < len(taken) and taken[i][0] < m.end():
            continue
        start, end = m.start(), m.end()
        cut = max(m[0].rfind("="), m[0].rfind(":"))
        if 0 <= cut < len(m[0]) - 1:
            start += cut + 1
        while start < end and text[start] in _EDGE:
            start += 1
        while end > start and text[end - 1] in _EDGE:
            end -= 1
        if 6 <= end - start <= LONGEST:
            value = text[start:end]
            out.append((value.lower(), None, start, end, _patterns(text, start, end, value)))
    i = 0
    for m in _GROUPS.finditer(text) if " " in text else ():
        start, end = m.span()
        while i < len(taken) and taken[i][1] <= start:
            i += 1
        whole = end == len(text) or text[end] in _EDGE or text[end] in " \t\n\x0b\x0c\r"
        digits = sum("0" <= c <= "9" for c in m[0])
        if " " in m[0] and whole and not (i < len(taken) and taken[i][0] < end) and any(a <= digits <= b for a, b in DIGITS.values()):
            out.append((m[0], None, start, end, _patterns(text, start, end, m[0])))
    return out


_ITEM = pa.struct([("value", pa.string()), ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("patterns", pa.list_(pa.string()))])
_ITEM_SQL = "array<struct<value: string, kind: string, start: int, end: int, patterns: array<string>>>"


def _found(batches):
    names = ["doc_id", "key", *(f"n_{k}" for k in KINDS), "base", "items"]
    for batch in batches:
        rows = []
        for text in batch.column(2):
            text = text.as_py() or ""
            base = base_spans(text)
            items = identifiers(text, base) if base or "@" in text or _DIGIT.search(text) else []
            kinds = [k for _, k, _ in base]
            rows.append((*(kinds.count(k) for k in KINDS), written(base), [dict(zip(("value", "kind", "start", "end", "patterns"), x)) for x in items]))
        columns = list(zip(*rows)) if rows else [[]] * 6
        yield pa.RecordBatch.from_arrays([
            batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in columns[:4]),
            pa.array(columns[4], pa.string()), pa.array(columns[5], pa.list_(_ITEM)),
        ], names)


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Stored rows doc_id, key (hash of the text), n_<kind>, base, items for every row of ``docs``."""
    rows = with_id(docs, key, text).select("doc_id", F.xxhash64("text").alias("key"), "text")
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return stored(rows.mapInArrow(released(_found), f"doc_id long, key long, {counts}, base string, items {_ITEM_SQL}"))


def accepted(items: DataFrame) -> DataFrame:
    """value, kind of the identifiers that the rounds accept; ``items`` are exploded rows value, kind, patterns."""
    seeds = items.filter("kind is not null").select("value", "kind", F.lit(1.0).alias("score")).distinct()
    edges = stored(items.select("value", F.explode("patterns").alias("pattern")).distinct())
    size = edges.groupBy("pattern").agg(F.count("*").alias("size")).filter(F.col("size") >= SUPPORT)
    scores = stored(seeds)
    for _ in range(ROUNDS):
        known = lookup_join(edges, scores.groupBy("value").agg(F.collect_list(F.struct("kind", "score")).alias("kinds")), "value", "inner")
        mass = known.select("pattern", F.inline("kinds")).groupBy("pattern", "kind").agg(
            F.sum("score").alias("mass"), F.count("*").alias("members")
        )
        good = mass.filter(F.col("members") >= SUPPORT).join(size, "pattern").withColumn("share", F.col("mass") / (F.col("size") + 1))
        good = stored(good.filter(F.col("share") >= GOOD).groupBy("pattern").agg(F.collect_list(F.struct("kind", "share")).alias("shares")))
        reached = lookup_join(edges, good, "pattern", "inner").select("value", F.substring_index("pattern", ":", 1).alias("sort"), F.inline("shares"))
        # One voice for each sort of pattern, and a shape alone convinces nobody.
        voices = reached.groupBy("value", "kind", "sort").agg(F.max("share").alias("share"))
        heard = voices.groupBy("value", "kind").agg(
            (1 - F.exp(F.sum(F.log(1 - F.least("share", F.lit(0.999)))))).alias("score"), F.max((F.col("sort") != "s").cast("int")).alias("lexical")
        ).filter("lexical = 1")
        scores = stored(
            seeds.unionByName(heard.select("value", "kind", "score")).groupBy("value", "kind").agg(F.max("score").alias("score"))
        )
    seen = scores.join(seeds.select("value").distinct(), "value", "left_anti").filter(F.col("score") >= ACCEPT)
    best = seen.groupBy("value").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))
    digits = F.length(F.regexp_replace("value", "[^0-9]", ""))
    runs = [(F.col("kind") == k) & digits.between(*bounds) for k, bounds in DIGITS.items()]
    return best.filter(~F.contains("value", F.lit(" ")) | runs[0] | runs[1])


def added_spans(found: DataFrame) -> DataFrame:
    """doc_id, key, added (array of start, kind, end): what the method finds beside the base spans."""
    items = found.select("doc_id", "key", F.inline("items")).select("doc_id", "key", "value", "kind", "start", "end", "patterns")
    values = stored(accepted(items.select("value", "kind", "patterns")))
    places = items.filter("kind is null").select("doc_id", "key", "value", "start", "end")
    hits = lookup_join(places, values, "value", "inner")
    return hits.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set(F.struct("start", "kind", "end"))).alias("added"))


def _merged(batches):
    for batch in batches:
        base, added = batch.column(6).to_pylist(), batch.column(7).to_pylist()
        spans = []
        for b, a in zip(base, added):
            own = [(int(s), KINDS.index(k), int(e)) for k, s, e in (x.split(":") for x in b.split(",") if x)]
            own += [(x["start"], KINDS.index(x["kind"]), x["end"]) for x in a or []]
            spans.append(written((s, KINDS[k], e) for s, k, e in sorted(own)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(batch.column(i) for i in range(2, 6)), pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base]),
             pa.array(spans, pa.string()), pa.array([len(a or []) for a in added], pa.int64())],
            ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"],
        )


def extract(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, the base counts, base_sha256, all spans and how many the method added."""
    found = find(docs, key, text)
    added = added_spans(found).select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), "added")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__key"))
    joined = found.drop("items").join(added, same, "left").select("doc_id", "key", *(f"n_{k}" for k in KINDS), "base", "added")
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return joined.mapInArrow(released(_merged), f"doc_id long, {counts}, base_sha256 string, spans string, n_added long")


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every span replaced by ``[KIND]``; where spans overlap, the one that starts first counts.

    All columns stay. Null texts stay null.
    """
    names = fresh(docs, "__id", "__key", "__added")
    added = added_spans(find(docs, key, text)).toDF(*names)
    same = F.col(f"`{key}`").cast("long").eqNullSafe(F.col(names[0])) & (F.xxhash64(F.col(f"`{text}`").cast("string")) == F.col(names[1]))
    joined = docs.join(added, same, "left").drop(*names[:2])
    position = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            out = []
            for value, more in zip(batch.column(position), batch.column(batch.num_columns - 1)):
                raw = value.as_py()
                if raw is not None:
                    spans = sorted(base_spans(raw) + [(x["start"], x["kind"], x["end"]) for x in more.as_py() or []], key=lambda s: (s[0], -s[2]))
                    parts, at = [], 0
                    for s, k, e in spans:
                        if s >= at:
                            parts += [raw[at:s], f"[{k.upper()}]"]
                        at = max(at, e)
                    raw = "".join(parts) + raw[at:]
                out.append(raw)
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            columns[position] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])
    return joined.mapInArrow(released(run), docs.schema)
