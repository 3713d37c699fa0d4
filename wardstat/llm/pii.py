"""Operator 12: personal data by bootstrapped contextual extraction.

Expressions of four kinds (email, ip, card, phone) give the base spans, and these are the
seeds. Every seed, and every other string that looks like an identifier (a number of 7
digits or more in groups, or something with an at sign), is an instance: its digits, or its
letters in lower case. The words around an instance are its lexical patterns: two words
before it, one before and one after, two after. Patterns and instances form a graph, one
edge for each different pair, so copies of a document add nothing. Spark scores it in rounds:

* a pattern's confidence for a kind is the weight of its instances of that kind over
  the weight of all whose kind is known (and a small part of those unknown) plus one, and
  it counts from ``MIN_CONFIDENCE`` on;
* an unknown instance's score for a kind is 1 - product(1 - confidence) over the counting
  patterns it occurs in; from ``MIN_SCORE`` on it is accepted as the likeliest kind, and takes part in
  the next round.

All occurrences of accepted instances are spans too. Scanning is linear in the text's length: each
expression is tried once at each place where it can start.

Defined cases: null or empty text has no span; null ids and repeated rows are kept, each with
its own row; overlapping base spans of different kinds are all told; a candidate that
touches a base span is none; ties between kinds go to the first as listed; an empty
table gives no row, one without seeds base spans only (none). Other columns are ignored. Bounds: a document's
spans are one row; at most ``MAX_BROADCAST`` patterns or instances are broadcast, else joined.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardstat.llm.tables import documents, small_enough, written

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
MIN_CONFIDENCE = 0.85
MIN_SCORE = 0.85
#: part of an unknown instance in a pattern's weight
UNKNOWN = 0.1
MIN_DIGITS, MAX_DIGITS = 7, 24
MAX_BROADCAST = 200_000
ROWS = 512
CONTEXT = 60

# fixed by the contract: what a base span is
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IP_MAX, _CARD_DIGITS, _PHONE_DIGITS = 255, (12, 19), (9, 15)

_ANY = re.compile(r"[0-9@]|[(\[]at[)\]]", re.I)
#: ips, cards, phones and numbers hold no other characters, so none crosses a zone's end
_ZONE = re.compile(r"[0-9+][0-9 ().+-]*")
_NUMBER = re.compile(r"\+?\(?[0-9](?:[ ().-]{0,2}[0-9])++")
_AT = re.compile(r" ?[(\[]at[)\]] ?|@", re.I)
_HEAD = re.compile(r"[\w.%+-]+\Z")
_TAIL = re.compile(r"[\w-]+(?:\.[\w-]+)*")
_WORD = re.compile(r"[^\W\d_]+|[:=#]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

_SCAN = (
    "doc_id long, base array<struct<start:int,kind:int,end:int>>, "
    "found array<struct<kind:int,start:int,end:int,instance:string,patterns:array<string>>>"
)
_SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
_FOUND = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))])


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= _IP_MAX


def _zones(text: str) -> Iterator[tuple[int, int]]:
    for m in _ZONE.finditer(text):
        if m.end() - m.start() >= MIN_DIGITS:  # the shortest ip is as long as that
            yield m.span()


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, one at sign after the other: what is before it can hold no other."""
    low, at = 0, text.find("@")
    while at >= 0:
        local = text[low:at]
        start = low + len(local.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        low = m.end() if m else at + 1
        if m:
            yield start, low
        at = text.find("@", max(at + 1, low))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``start, kind, end`` of the base spans, in order; offsets are code points."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    for a, b in _zones(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text, a, b) if all(map(_small, m.group().split(".")))]
        for m in _CARD.finditer(text, a, b):
            digits = _NOT_DIGIT.sub("", m.group())
            if _CARD_DIGITS[0] <= len(digits) <= _CARD_DIGITS[1] and _luhn(digits):
                out.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text, a, b):
            if _PHONE_DIGITS[0] <= len(_NOT_DIGIT.sub("", m.group())) <= _PHONE_DIGITS[1]:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _loose(text: str) -> Iterator[tuple[int, int]]:
    """Strings that look like identifiers: with an at sign (or the word for it), and long numbers."""
    low = 0
    for m in _AT.finditer(text):
        head = _HEAD.search(text, max(low, m.start() - 64), m.start())
        tail = _TAIL.match(text, m.end())
        if head and tail:
            low = tail.end()
            yield head.start(), low
    for a, b in _zones(text):
        for m in _NUMBER.finditer(text, a, b):
            digits = len(_NOT_DIGIT.sub("", m.group()))
            before, after = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
            if MIN_DIGITS <= digits <= MAX_DIGITS and not before.isalnum() and not after.isalnum():
                yield m.span()


def _instance(text: str, start: int, end: int) -> str:
    what = text[start:end]
    return "@" + _AT.sub("@", what.lower()) if _AT.search(what) else "#" + _NOT_DIGIT.sub("", what)


def _patterns(text: str, start: int, end: int, family: str) -> list[str]:
    left = _WORD.findall(text[max(0, start - CONTEXT) : start].lower())[-2:]
    right = _WORD.findall(text[end : end + CONTEXT].lower())[:2]
    out = []
    if len(left) == 2:
        out.append(f"{left[0]} {left[1]} {family}")
    if left and right:
        out.append(f"{left[-1]} {family} {right[0]}")
    if len(right) == 2:
        out.append(f"{family} {right[0]} {right[1]}")
    return out


def scan_text(text: str | None) -> tuple[list[dict], list[dict]]:
    """Base spans, and all instances with their patterns (``kind`` -1: unknown)."""
    if not text or not _ANY.search(text):
        return [], []
    base = base_spans(text)
    found = [(a, b, k) for a, k, b in base]
    taken = sorted((a, b) for a, _, b in base)
    reach = i = 0
    for a, b in sorted(_loose(text)):
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        clear = i == len(taken) or taken[i][0] >= b
        if clear and reach <= a:
            reach = b
            found.append((a, b, -1))
    out = []
    for a, b, k in found:
        value = _instance(text, a, b)
        out.append({"kind": k, "start": a, "end": b, "instance": value, "patterns": _patterns(text, a, b, value[0])})
    return [{"start": a, "kind": k, "end": b} for a, k, b in base], out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            some = batch.slice(i, ROWS)
            told = [scan_text(t.as_py()) for t in some.column("text")]
            yield pa.record_batch(
                [some.column("doc_id"), pa.array([b for b, _ in told], pa.list_(_SPAN)), pa.array([f for _, f in told], pa.list_(_FOUND))], names=["doc_id", "base", "found"]
            )


def scanned(docs: DataFrame) -> DataFrame:
    """``row, doc_id, base, found`` of every document, written to the shared folder."""
    out = documents(docs).select("doc_id", "text").mapInArrow(_scan, _SCAN)
    return written(out.withColumn("row", F.monotonically_increasing_id()), "pii-scan")


# -------------------------------------------------------------------- the graph --


def _joined(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(F.broadcast(right) if small_enough(right, MAX_BROADCAST) else right, key)


def bootstrap(scan: DataFrame, rounds: int = ROUNDS, min_confidence: float = MIN_CONFIDENCE, min_score: float = MIN_SCORE) -> tuple[DataFrame, DataFrame]:
    """``pattern, kind, confidence`` of the counting patterns, and ``instance, kind, score`` of
    the accepted instances that no seed is equal to."""
    seen = scan.select(F.explode("found").alias("f")).select("f.instance", "f.kind", "f.patterns")
    edges = written(seen.select(F.explode("patterns").alias("pattern"), "instance").distinct(), "pii-edges")
    seeds = written(seen.where("kind >= 0").select("instance", "kind", F.lit(1.0).alias("score")).distinct(), "pii-seeds")
    known, best = seeds, None
    confident = edges.select("pattern", F.lit(0).alias("kind"), F.lit(0.0).alias("confidence")).where("false")
    accepted = seeds.where("false")
    for _ in range(rounds):
        # patterns that no known instance has can't count: only the others' edges go on
        told = edges.join(known, "instance")
        per = told.groupBy("pattern", "kind").agg(F.sum("score").alias("positive"))
        size = edges.groupBy("pattern").agg(F.count("*").alias("n"))
        weighed = per.groupBy("pattern").agg(F.sum("positive").alias("all"), F.max(F.struct("positive", -F.col("kind"))).alias("top"))
        weighed = weighed.where(F.col("top.positive") >= min_confidence * (F.col("all") + 1))
        weighed = weighed.join(size, "pattern")  # few are left: the join is small
        unknown = UNKNOWN * F.greatest(F.col("n") - F.col("all"), F.lit(0.0))
        weighed = weighed.select("pattern", (-F.col("top").getField("col2")).alias("kind"), (F.col("top.positive") / (F.col("all") + unknown + 1)).alias("confidence"))
        confident = written(weighed.where(F.col("confidence") >= min_confidence), "pii-patterns")
        reached = _joined(edges, confident, "pattern").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("score"))
        top = F.max_by(F.struct("kind", "score"), F.struct("score", -F.col("kind")))
        reached = reached.groupBy("instance").agg(top.alias("t")).select("instance", "t.kind", "t.score").where(F.col("score") >= min_score)
        accepted = written(reached.join(seeds.select("instance").distinct(), "instance", "left_anti"), "pii-accepted")
        if (now := accepted.count()) == best:
            break
        best, known = now, seeds.unionByName(accepted)
    return confident, accepted


def _told(spans: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["end"])), ",")


def _of(kind: int):
    return lambda span: span["kind"] == kind


def personal_data(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, base, added`` (spans: start, kind, end), ``n_email, n_ip, n_card, n_phone``
    (base ones), ``base_told`` and ``spans`` as text, for every document."""
    scan = scanned(docs)
    _, accepted = bootstrap(scan, rounds)
    unseen = scan.select("row", F.explode("found").alias("f")).where("f.kind < 0").select("row", "f.instance", "f.start", "f.end")
    new = _joined(unseen, accepted.select("instance", "kind"), "instance")
    new = written(new.groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("added")), "pii-added")
    new = F.broadcast(new) if small_enough(new, MAX_BROADCAST // 10) else new
    out = scan.select("row", "doc_id", "base").join(new, "row", "left")
    added = F.coalesce("added", F.array().cast("array<struct<start:int,kind:int,end:int>>"))
    counts = [F.size(F.filter("base", _of(kind))).cast("long").alias(f"n_{name}") for kind, name in enumerate(KINDS)]
    return out.select("doc_id", "base", added.alias("added"), *counts, _told(F.col("base")).alias("base_told"), _told(F.concat("base", added)).alias("spans"))
