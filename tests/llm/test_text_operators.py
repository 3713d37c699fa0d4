import hashlib
import random
import re
from collections import Counter, defaultdict

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from wardstat.llm import decontaminate, mixing, ngram_join, suffix_dedup, textbytes, token_output

BPE = public_tokenizers.path("byte_bpe_50k.json")


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


# ------------------------------------------------------------------ op1 ---


def test_ngram_join_is_brute_force(docs, corpus):
    got = rows(ngram_join.join(docs), "doc_id", "n_shingles", "component_id")
    want = brute.jaccard_components(dict(corpus))
    assert Counter(got) == Counter((i, *want[i]) for i, _ in corpus)


def test_ngram_join_other_similarity_and_no_listed_shingles(docs, corpus):
    """The order of shingles must not matter: with nothing listed the result is the same."""
    a = Counter(rows(ngram_join.join(docs, listed=0), "doc_id", "component_id"))
    b = Counter(rows(ngram_join.join(docs), "doc_id", "component_id"))
    assert a == b


def test_ngram_join_chain_has_one_component(spark):
    """Links between neighbours only: the ends are in one component though they don't link."""
    words = [f"v{i}" for i in range(100)]
    chain = [(10 + k, " ".join(["zz%d" % j for j in range(2 * k)] + words[2 * k :])) for k in range(12)]
    df = spark.createDataFrame(chain, "doc_id long, text string")
    want = brute.jaccard_components(dict(chain))
    assert {r[0]: r[1] for r in rows(ngram_join.join(df), "doc_id", "component_id")} == {i: c for i, (_, c) in want.items()}


def test_ngram_join_many_near_copies(spark):
    base = [f"b{i}" for i in range(120)]
    texts = []
    for k in range(300):
        own = list(base)
        own[(k * 7) % 120] = f"edit{k}"
        texts.append((k + 1, " ".join(own)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert set(rows(ngram_join.join(df), "component_id")) == {(1,)}


def test_ngram_join_null_ids_and_empty(spark, no_docs):
    df = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (None, None), (8, None)], "doc_id long, text string")
    assert Counter(rows(ngram_join.join(df), "doc_id", "n_shingles", "component_id")) == Counter([(None, 2, 7), (7, 2, 7), (None, 0, None), (8, 0, 8)])
    assert ngram_join.join(no_docs).count() == 0


def test_prefix_length_keeps_one_shared_shingle():
    """Two sets at the threshold that miss as many shingles as allowed still share one of their prefixes."""
    for n in range(1, 200):
        p = int(ngram_join.prefix_length(np.array([n]))[0])
        assert p == n - -(-80 * n // 100) + 1


@given(st.lists(st.text("ab \n\tÉß", max_size=40), max_size=8))
@settings(max_examples=60, deadline=None)
def test_shingle_counts(texts):
    data, offsets = textbytes.texts(pa.array(texts, pa.string()))
    prints, counts = ngram_join.shingle_sets(data, offsets)
    sets = [brute.shingles(t) for t in texts]
    assert counts.tolist() == [len(s) for s in sets]
    parts = np.split(prints, np.cumsum(counts)[:-1]) if len(texts) else []
    of = {}
    for own, part in zip(sets, parts):
        assert of.setdefault(own, tuple(part)) == tuple(part)
    assert len(set(of.values())) == len(of)


def test_parity_bound():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 62, 700, dtype=np.uint64)
    b = np.concatenate([a[:600], rng.integers(0, 1 << 62, 300, dtype=np.uint64)])
    assert ngram_join.differ_at_least(ngram_join.parity(a), ngram_join.parity(b)) <= len(np.setxor1d(a, b))
    assert ngram_join.differ_at_least(ngram_join.parity(a), ngram_join.parity(a)) == 0


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_lists_over_tasks_have_the_same_neighbours(spark, parts):
    """One shingle in a third of the places; ranges of any number, of one row too, give what a window over each list gives."""
    rng = np.random.default_rng(5)
    data = [(0 if i % 3 == 0 else int(rng.integers(1, 400)), i, int(rng.integers(5, 9)), int(rng.integers(0, 4))) for i in range(900)]
    places = spark.createDataFrame(data, "token long, gid long, n int, pos int")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = Counter(rows(ngram_join.listed_places(places)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    listing = Window.partitionBy("token").orderBy("n", F.xxhash64("gid", F.pmod("token", F.lit(ngram_join.ORDERS))), "gid")
    want = places.select("*", *[F.lag(c).over(listing).alias(f"p_{c}") for c in ("gid", "n", "pos")], F.lead("gid").over(listing).alias("next"))
    assert got == Counter(rows(want.where("p_gid is not null or next is not null").drop("next")))
    assert ngram_join.listed_places(places.where("false")).count() == 0


@pytest.mark.parametrize("percent", [50, 80, 100])
def test_ngram_join_of_sizes_far_apart(spark, percent):
    """Texts that share all their rare shingles, of sizes on both sides of the bands' edges."""
    rng = np.random.default_rng(8)
    base = [f"w{k}" for k in range(120)]
    texts = [(i, " ".join(base[: int(rng.integers(20, 120))])) for i in range(60)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in texts)}
    part = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                low, high = sorted((part[a], part[b]))
                part = {i: low if c == high else c for i, c in part.items()}
    assert dict(rows(ngram_join.join(df, percent), "doc_id", "component_id")) == part


# ------------------------------------------------------------------ op4 ---


def bench_rows(corpus):
    by = dict(corpus)
    item = lambda i, a, b: " ".join(by[i].split()[a:b])
    return [(1, item(5, 3, 40)), (2, item(400, 1000, 1013).upper()), (10, item(7, 2, 9)), (11, "one two"), (12, None), (13, " ?! "), (14, item(5, 10, 25)),
            (15, "the the the the the"), (None, item(9, 0, 13)), (16, "no such words at all in any of the documents here, not one"), (17, "é ñ")]


def test_contamination_is_brute_force(spark, docs, corpus):
    bench = bench_rows(corpus)
    table = spark.createDataFrame([(i, t, "z") for i, t in bench], "item_id long, text string, win string")
    got = Counter((i, n, h, tuple(x)) for i, n, h, x in rows(decontaminate.contamination(docs, table), "doc_id", "n_words", "n_hit", "items"))
    named = [(i, t) for i, t in bench if i is not None]
    want = brute.contamination([t for _, t in corpus], bench)
    items = brute.contamination([t for _, t in corpus], named)
    assert got == Counter((i, n, h, tuple(x)) for (i, _), (n, h, _), (_, _, x) in zip(corpus, want, items))


def test_contamination_of_empty_tables(spark, docs, no_docs, corpus):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.contamination(no_docs, some).count() == 0
    out = decontaminate.contamination(docs, none)
    assert out.count() == len(corpus) and out.where("n_hit > 0 or n_items > 0").count() == 0


def test_contamination_plan_has_no_python(spark, docs, corpus):
    table = spark.createDataFrame(bench_rows(corpus), "item_id long, text string")
    plan = decontaminate.contamination(docs, table)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "MapIn" not in plan


# ------------------------------------------------------------------ op5 ---


def test_tokens_round_trip(spark, docs, corpus, tmp_path):
    path = str(tmp_path / "shards")
    token_output.write_shards(docs, path, BPE, shard_ids=5000)
    got = token_output.read_shards(spark, path, with_ids=True).orderBy("start").collect()
    texts = defaultdict(list)
    for i, t in corpus:
        texts[i].append(t)
    # rows of one id are equal here, so their order doesn't matter
    assert all(len(set(t)) == 1 for t in texts.values())
    order = sorted(corpus, key=lambda r: r[0])
    want = brute.tokens([t for _, t in order], BPE)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == [(i, *w) for (i, _), w in zip(order, want)]
    assert all(len(r.ids) == r.n_tokens and r.ids[-1] == 0 for r in got)


def test_tokens_of_no_documents_and_null_ids(spark, no_docs, tmp_path):
    token_output.write_shards(no_docs, str(tmp_path / "none"), BPE)
    assert token_output.read_shards(spark, str(tmp_path / "none")).count() == 0
    df = spark.createDataFrame([(None, "x"), (1, "y"), (None, None)], "doc_id long, text string")
    token_output.write_shards(df, str(tmp_path / "nulls"), BPE)
    got = rows(token_output.read_shards(spark, str(tmp_path / "nulls")), "doc_id", "start", "n_tokens")
    nulls = sorted(got, key=lambda r: r[1])[:2]
    assert {(i, n) for i, _, n in nulls} == {(None, 1), (None, 2)} and [s for _, s, _ in nulls] == [0, nulls[0][2]]
    assert (1, 3, 2) in got


def test_an_added_token_in_a_text_is_its_id(spark, tmp_path):
    from tokenizers import Tokenizer

    mark, tok = "<|endoftext|>", Tokenizer.from_file(BPE)
    texts = [f"one two{mark}three", mark, f"a {mark}{mark} b", "no mark <|endoftext| >", "<|endof", "text|> x", f"\u3000{mark}", "last one"] * 2
    write = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    token_output.write_shards(write, str(tmp_path / "added"), BPE)
    got = token_output.read_shards(spark, str(tmp_path / "added"), with_ids=True).orderBy("start").collect()
    assert [r.ids for r in got] == [tok.encode(t, add_special_tokens=False).ids + [0] for t in texts]
    assert got[1].ids == [50256, 0] and [r.start for r in got] == [sum(r.n_tokens for r in got[:k]) for k in range(len(got))]


PIECES = [*"ab'stT.,!7 \n\t\r<|>", "\u00a0", "\u3000", "\u0085", "\u2028", "\x1c", "é", "ß", "漢", "🙂", "<|endoftext|>", " the", "'ll"]


@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=25).map("".join), min_size=1, max_size=6))
@settings(max_examples=300, deadline=None)
def test_pieces_encode_as_the_library_does(texts):
    enc = token_output.encoder(BPE)
    data, offsets = textbytes.texts(pa.array(texts, pa.string()))
    ids, counts = enc.encode(data, offsets)
    want = [x.ids + [0] for x in enc.tok.encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == [len(w) for w in want]
    assert ids.tolist() == sum(want, [])


def test_pieces_are_encoded_without_offsets():
    enc = token_output.Encoder(BPE)
    tok = enc.tok

    class Fast:  # has no ``encode``, which tells offsets too
        encode_batch_fast = staticmethod(tok.encode_batch_fast)

    enc.tok = Fast()
    rng = np.random.default_rng(4)
    for _ in range(3):  # later blocks meet kept pieces and new ones
        texts = [" ".join("".join(map(chr, rng.integers(97, 123, rng.integers(1, 4)))) for _ in range(3000)) + ", x1\u00a0y" for _ in range(2)]
        data, offsets = textbytes.texts(pa.array(texts))
        ids, counts = enc.encode(data, offsets)
        want = [[*tok.encode(t, add_special_tokens=False).ids, 0] for t in texts]
        assert ids.tolist() == sum(want, []) and counts.tolist() == [len(w) for w in want]
        assert (enc.keys[1:] > enc.keys[:-1]).all()


@given(st.lists(st.lists(st.integers(0, 3), max_size=60), min_size=1, max_size=12))
@settings(max_examples=100, deadline=None)
def test_repair_shards_decode_alone(lists):
    lists = [x + [0] for x in lists]
    ids, counts = np.array(sum(lists, []), np.uint16), np.array([len(x) for x in lists])
    rules, seq, per_doc = token_output.repair(ids, counts, min_count=2)
    assert per_doc.sum() == len(seq) and len(per_doc) == len(lists)
    shard = token_output.Shard(token_output.pack(ids, counts))
    for k in range(len(lists)):
        out, n = shard.decode(k, k + 1)
        assert out.tolist() == lists[k] and n.tolist() == [len(lists[k])]


def test_repair_makes_frequent_pairs_short():
    ids = np.tile(np.array([5, 6, 7, 8, 9, 0], np.uint16), 4000)
    payload = token_output.pack(ids, np.full(4000, 6))
    assert len(payload) < len(ids) * 2 * 0.6 + 4 * 4000
    out, n = token_output.Shard(payload).decode(0, 4000)
    assert np.array_equal(out, ids) and set(n) == {6}


def test_repair_goes_on_until_a_passage_is_one_symbol():
    passage = np.random.default_rng(0).integers(1, 50_000, 500).astype(np.uint16)
    ids, counts = np.tile(passage, 400), np.full(400, 500)
    rules, seq, per_doc = token_output.repair(ids, counts)
    assert len(seq) == 400 and set(per_doc) == {1} and len(rules) == 499
    out, n = token_output.Shard(token_output.pack(ids, counts)).decode(0, 400)
    assert np.array_equal(out, ids) and set(n) == {500}


# ------------------------------------------------------------------ op7 ---


def test_mixing_targets_and_amounts(spark, docs, corpus):
    out = mixing.mix(docs).collect()
    sizes = defaultdict(int)
    for r in out:
        sizes[r.source] += r["size"]
    want = brute.fill_targets(dict(sizes))
    taken = defaultdict(int)
    for r in out:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert r.taken == r["size"] * r.copies <= 3 * r["size"]
        taken[r.source] += r.taken
    assert len(out) == len(corpus)
    for s in sizes:  # no closer document is left: dropping or adding one can't halve the miss of a source
        assert abs(taken[s] - want[s]) <= max(r["size"] for r in out if r.source == s) / 2 + 1
    by = dict(corpus)
    assert all(r["size"] == len(brute.SPACED.findall(by[r.doc_id] or "")) for r in out)
    again = Counter(rows(mixing.mix(docs.repartition(3)), "doc_id", "size", "source", "copies"))
    assert again == Counter((r.doc_id, r["size"], r.source, r.copies) for r in out)


def test_mixing_is_close_on_many_documents(spark):
    df = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(1 + id % 37 as int))").alias("text"),
        F.expr("case when id % 3 = 0 then 'hot' when id % 50 = 1 then 's1' when id % 50 = 2 then 's2' else concat('t', id % 5) end").alias("source"),
    )
    out = mixing.mix(df)
    per = out.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("source_size").alias("size")).collect()
    want = brute.fill_targets({r.source: r["size"] for r in per})
    for r in per:
        assert r.target == pytest.approx(want[r.source])
        assert abs(r.taken - r.target) <= 1


def test_mixing_capped_sources_are_taken_three_times(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, "c " * 500, "y"), (3, "", "z"), (4, None, None)], "doc_id long, text string, source string")
    got = {r.doc_id: (r["size"], r.target, r.taken) for r in mixing.mix(df).collect()}
    assert got[1] == (2, 6.0, 6) and got[3] == (0, 0.0, 0) and got[4] == (0, 0.0, 0)
    assert got[2][1] == pytest.approx(496) and got[2][2] == 500


def test_mixing_of_nothing(no_docs):
    assert mixing.mix(no_docs).count() == 0


def test_mixing_plan_has_no_python(docs):
    plan = mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "MapIn" not in plan


# ------------------------------------------------------------------ op8 ---


@pytest.mark.parametrize("length,gram,hot", [(60, 12, 1 << 14), (25, 96, 2), (120, 40, 1 << 14), (60, 20, 1)])
def test_repeats_are_brute_force(docs, corpus, length, gram, hot):
    small = docs.where("text is null or length(text) < 3000")
    some = [(i, t) for i, t in corpus if t is None or len(t) < 3000]
    got = rows(suffix_dedup.remove_repeats(small, length, keep_first=False, gram=gram, hot_kinds=hot), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    want = brute.repeats([t for _, t in some], length)
    assert Counter(got) == Counter((i, *w) for (i, _), w in zip(some, want))


@pytest.mark.parametrize("words,gram,hot", [(12, 4, 1 << 11), (51, 16, 1 << 11), (5, 5, 1), (30, 7, 2)])
def test_shared_passages_are_brute_force(docs, corpus, words, gram, hot):
    small = docs.where("text is null or length(text) < 3000")
    some = [(i, t) for i, t in corpus if t is None or len(t) < 3000]
    passages = suffix_dedup.shared_passages(small, words, gram, hot)
    got = rows(suffix_dedup.remove_repeats(small, 60, keep_first=False, gram=20, passages=passages), "doc_id", "n_shared")
    cut = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in some]
    seen = Counter(tuple(w[p : p + words]) for w in cut for p in range(len(w) - words + 1))
    want = []
    for (i, _), w in zip(some, cut):
        inside = {p + k for p in range(len(w) - words + 1) if seen[tuple(w[p : p + words])] > 1 for k in range(words)}
        want.append((i, len(inside)))
    assert Counter(got) == Counter(want)


def test_words_of_texts_are_told_apart():
    texts = ["", "a b  c", "\t a\n", "b", "a b", " ", "\x0bc\x0cd\re"]
    raw = [t.encode() for t in texts]
    offsets = np.append(0, np.cumsum([len(r) for r in raw]))
    codes, upto = textbytes.words(np.frombuffer(b"".join(raw), np.uint8), offsets)
    want = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]
    assert np.diff(upto).tolist() == [len(w) for w in want]
    flat = [w for ws in want for w in ws]
    assert {(a == b) for a, b in zip(codes, codes)} == {True}
    assert all((codes[i] == codes[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(len(flat)))


def test_anchors_are_the_leftmost_smallest_pieces_in_any_segments(monkeypatch):
    rng = np.random.default_rng(8)
    pieces = (rng.integers(0, 12, 400).astype(np.uint64) << np.uint64(40)) | rng.integers(0, 1 << 20, 400).astype(np.uint64)
    for window in (1, 2, 7, 64):
        want = [i + int(np.argmin(pieces[i : i + window] >> np.uint64(23))) for i in range(len(pieces) - window + 1)]
        for segment in (1 << 20, 33, 64):
            monkeypatch.setattr(suffix_dedup, "SEGMENT", segment)
            assert suffix_dedup.leftmost_smallest(pieces, window).tolist() == want


def test_repeats_of_long_texts(docs, corpus):
    out = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs, keep_first=False).collect()}
    by = dict(corpus)
    assert out[400].n_removed == len(by[400]) and out[402].n_removed == len(by[402])
    assert out[501].n_bytes == 0 and out[500].n_bytes == 0 and out[503].n_removed == 0
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in out.values())


@pytest.mark.parametrize("hot", [1 << 14, 1])
def test_keep_first_leaves_one_copy(spark, hot):
    rng = random.Random(4)
    a, b = ("".join(rng.choice("abcdefghij") for _ in range(300)) for _ in range(2))
    texts = [(1, "x" * 30 + a), (2, a + b), (3, b[50:]), (4, a + b), (None, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    out = {r.doc_id: r for r in suffix_dedup.remove_repeats(df, 60, keep_first=True, gram=20, hot_kinds=hot).collect()}
    assert out[1].kept.decode() == texts[0][1]
    assert out[2].kept.decode() == b and out[3].kept == b"" and out[4].kept == b""
    assert out[None].n_bytes == 0


def test_no_repeats(no_docs):
    assert suffix_dedup.remove_repeats(no_docs).count() == 0
