import hashlib
import random
import re
import time

import pytest

from wardstat.llm import pii, queries

SMALL = "/root/testdata/sf0.001"
#: the expressions as they are given
GIVEN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    odd, even = digits[::-1][::2], digits[::-1][1::2]
    return (sum(map(int, odd)) + sum(sum(map(int, str(2 * int(d)))) for d in even)) % 10 == 0


def brute(text):
    out = []
    for k, (kind, given) in enumerate(GIVEN.items()):
        for m in re.finditer(given, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {
                "email": True, "ip": all(int(p) <= 255 for p in m.group().split(".") if kind == "ip"),
                "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def told(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, row string, base int").repartition(3)


def test_base_spans_are_those_of_the_given_expressions():
    rng = random.Random(4)
    pieces = ["a", "Z9", "@", ".", "-", " ", "+", "(", ")", "1", "22", "255", "256", "4111 1111 1111 1111", "x@y.zz", "+1 (523) 555-1055", "é", "🙂", "1.2.3.4", "%", "_", "\n", "00", ".."]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 30)))
        assert pii.base_spans(text) == brute(text), text


@pytest.mark.parametrize("text", ["1" * 300_000, "a" * 300_000, "a.b@" * 60_000, "1.1." * 60_000, "+1 " * 60_000, "1-" * 100_000 + "a", "+1" + "(" * 200_000, "a@b." * 60_000, "(at)" * 60_000])
def test_long_texts_take_linear_time(text):
    start = time.time()
    pii.scan_text(text)
    assert time.time() - start < 5


def test_documents(spark, docs, corpus):
    got = sorted((r["doc_id"], r["spans"], r["base_told"]) for r in pii.personal_data(docs).collect())
    assert got == sorted((i, told(brute(t)), told(brute(t))) for i, t in corpus)


def seeded():
    """Numbers after a cue, with and without the plus sign; the same shapes after other words."""
    rng = random.Random(8)
    words = ["river", "stone", "cloud", "amber", "field", "north"]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = []
    for i in range(12):
        rows.append((i, f"{some(5)} please ring me under +49 30 55{i:02d} 12{i:02d} today {some(4)}"))
        rows.append((100 + i, f"{some(3)} my mailbox is user{i}@host{i}.example.org now {some(2)}"))
    rows += [(200 + i, f"{some(5)} please ring me under 030 77{i:02d} 99{i:02d} today {some(4)}") for i in range(3)]
    rows += [(300, f"{some(4)} my mailbox is jane(at)host5.example now {some(2)}"), (301, f"{some(3)} order {some(1)} 4455667788990011 {some(3)}")]
    rows += [(302, f"seen in {some(3)} as 030 7700 9900 once more"), (303, None), (304, ""), (None, "x@y.zz"), (305, "x@y.zz"), (305, "x@y.zz")]
    return rows


def test_patterns_of_seeds_find_unseen_identifiers(spark):
    rows = seeded()
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["spans"]) for r in pii.personal_data(table(spark, rows)).collect())
    want = []
    for i, t in rows:
        spans = brute(t)
        for shape, kind in ((r"(?<!\+49 )\b030 \d{4} \d{4}", 3), (r"jane\(at\)host5\.example", 0)):
            spans += [(m.start(), kind, m.end()) for m in re.finditer(shape, t or "")]
        want.append((i is None, i or 0, told(sorted(spans))))
    assert got == sorted(want)  # 302 has a number that 200 made known; 301's number has no pattern


def test_patterns_and_scores(spark):
    confident, accepted = pii.bootstrap(pii.scanned(table(spark, seeded())))
    patterns = {r["pattern"]: (r["kind"], round(r["confidence"], 6)) for r in confident.collect()}
    # 12 seeds and 3 numbers unseen, weighed 0.1, in the first round; the last counts them as known
    assert patterns["me under #"][0] == 3 and patterns["me under #"][1] > 12 / 13.3
    assert patterns["mailbox is @"][0] == 0
    assert {r["instance"]: r["kind"] for r in accepted.collect()} == {"#03077009900": 3, "#03077019901": 3, "#03077029902": 3, "@jane@host5.example": 0}
    once = [(i, t) for i, t in seeded()] * 3  # copies add nothing
    again, _ = pii.bootstrap(pii.scanned(table(spark, once)))
    assert {r["pattern"]: (r["kind"], round(r["confidence"], 6)) for r in again.collect()} == patterns


def test_mixed_patterns_do_not_count(spark):
    rows = [(i, f"see note +49 30 55{i:02d} 12{i:02d} for it") for i in range(10)] + [(50 + i, f"see note 10.0.{i}.7 for it") for i in range(10)]
    rows += [(90, "see note 030 7700 9900 for it")]
    assert {r["spans"] for r in pii.personal_data(table(spark, rows)).where("doc_id = 90").collect()} == {""}


def test_no_documents(spark, no_docs):
    assert pii.personal_data(no_docs).count() == 0


def test_given_table(spark):
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}
    out = queries.QUERIES["op12_personal_data"](spark, SMALL).collect()
    assert len(out) == len(texts)
    for r in out:
        base = brute(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == i for s in base) for i in range(4)]
        assert r["base_sha256"] == hashlib.sha256(told(base).encode()).hexdigest()
        assert set(told(base).split(",")) <= set(r["spans"].split(",")) or not base
