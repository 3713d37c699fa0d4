"""Trained operators (2, 3, 6): accuracy on rows that they did not learn from, and odd inputs."""

import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wardstat.llm import lang_id, license_scan, queries, textbytes, toxicity
from wardstat.llm.licence_texts import TEMPLATES

SF = "/root/testdata/sf0.01"
ODD = [(1, None, None), (2, "", "en"), (3, " \n\t ", "fr"), (4, "12 34 !?", "en"), (5, "漢字 かな", None), (None, "the thing of that", "en"), (7, "the " * 40_000, "en"), (7, "the " * 40_000, "en"), (8, "one\nline", None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "x", 1) for r in ODD], "doc_id long, text string, lang string, p string, score int")


# ------------------------------------------------------------------ op2 ---


def test_language_accuracy_on_held_out_documents(spark):
    out = queries.QUERIES["op2_language_id"](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text")
    rows = out.join(docs, "doc_id").collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out and r.lang is not None and r.lang_pred != "und"]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)


def test_language_of_odd_texts(spark, odd):
    pieces = [("the thing of that and this is it ".encode() * 4, "en"), ("le la des que les une est ".encode() * 4, "fr")] * 40
    model = lang_id.train(pieces, epochs=40)
    got = {(r.doc_id, r.lang_pred, r.score) for r in lang_id.identify(odd, model).collect()}
    by = {i: (p, s) for i, p, s in got}
    assert all(by[i] == ("und", 0.0) for i in (1, 2, 3, 4))
    assert by[5][0] != "und" and by[None][0] == "en" and by[7][0] == "en" and by[7][1] > 0.8
    assert lang_id.identify(odd, model).count() == len(ODD)
    carried = lang_id.identify(odd, model, carry=odd.columns)
    assert carried.columns == [*odd.columns, "lang_pred", "score"] and carried.where("doc_id = 8 and text = 'one\nline'").count() == 1


def test_language_scores_are_those_of_plain_loops():
    pieces = [("the thing of that and this is it ".encode() * 4, "en"), ("le la des que les une est à ".encode() * 4, "fr"), ("der die und in ist für ".encode() * 4, "de")] * 20
    model = lang_id.train(pieces, hidden=5, epochs=3)
    texts = ["", "the", "Une thing, que 12 for that!", "für und " * 30, "漢字 and 🙂 le", "x" * 64, "y" * 65]
    data, offsets = textbytes.texts(pa.array(texts))
    got = lang_id.pooled(model, data, offsets)
    for t, p in zip(texts, got):
        assert p.tolist() == pytest.approx(brute.language(model, t, lang_id.WINDOW, lang_id._LETTER), abs=1e-4)


def test_language_without_labels_or_rows(spark, odd):
    nothing = lang_id.learned(odd.withColumn("lang", F.lit(None).cast("string")))
    assert {(r.lang_pred, r.score) for r in lang_id.identify(odd, nothing).collect()} == {("und", 0.0)}
    assert lang_id.identify(odd.limit(0), nothing).count() == 0
    one = lang_id.train([(b"the thing", "en")])
    assert {r.lang_pred for r in lang_id.identify(odd.where("doc_id = 7"), one).collect()} == {"en"}


def test_backpropagation_through_time_is_the_gradient():
    """Numerical derivatives of one direction's recurrent and input weights."""
    rng = np.random.default_rng(0)
    x, u = rng.normal(0, 0.5, (6, 256)).astype(np.float32), rng.normal(0, 0.5, (6, 2)).astype(np.float32)
    seq = rng.integers(0, 256, (5, 3)).astype(np.uint8)
    d = rng.normal(0, 1, (5, 2, 3)).astype(np.float32)
    loss = lambda a, b: float((lang_id._pass(a, b, seq).astype(np.float64) * d).sum())
    keep = []
    states = lang_id._pass(x, u, seq, keep)
    gx, gu = lang_id._back(u, seq, states, keep, d)
    for i, j in [(0, 0), (2, 1), (3, 0), (5, 1)]:
        e = np.zeros_like(u)
        e[i, j] = 1e-2
        assert (loss(x, u + e) - loss(x, u - e)) / 2e-2 == pytest.approx(gu[i, j], abs=2e-2, rel=0.03)
    for i, j in [(1, seq[0, 0]), (4, seq[4, 2]), (2, seq[2, 1])]:
        e = np.zeros_like(x)
        e[i, j] = 1e-2
        assert (loss(x + e, u) - loss(x - e, u)) / 2e-2 == pytest.approx(gx[i, j], abs=2e-2, rel=0.03)


def test_every_byte_is_pooled():
    """A text of many windows is the letter-weighted mean of its windows."""
    model = lang_id.train([(b"the thing of that ", "en"), (b"le la des que les ", "fr")] * 20, epochs=2)
    parts = [b"the thing of that and this is it the end of it all in here. "[:64].ljust(64, b"."), b"le la des que les une est pour les dans le la des que les un. "[:64].ljust(64, b".")]
    one = lang_id.pooled(model, np.frombuffer(b"".join(parts), np.uint8), np.array([0, 128]))
    two = lang_id.pooled(model, np.frombuffer(b"".join(parts), np.uint8), np.array([0, 64, 128]))
    n = np.array([sum(chr(b).isalpha() for b in p) for p in parts])
    assert np.allclose(one[0], (two * n[:, None]).sum(axis=0) / n.sum(), atol=1e-5)


# ------------------------------------------------------------------ op3 ---


def test_licences_of_the_corpus(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op3_license_scan"](spark, SF).collect()}
    lines = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC", "This work is licensed under the GNU General Public License, version 3.": "GPL", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "All rights reserved.": "unknown"}
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        own = (r.text or "").split("\n")
        assert got[r.doc_id].families == ",".join(sorted({lines[x] for x in own if x in lines}))
        assert got[r.doc_id].n_paragraphs == sum(x != "" for x in own)


def test_licence_model_on_new_wordings_and_odd_texts(spark, odd):
    ordinary = [f"Some plain sentence number {k} about weather, cooking and long walks." for k in range(300)]
    model = license_scan.train(ordinary)
    new = [
        ("Apache-2.0", "Copyright 2024 Jane Roe. Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
        ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
        ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published"),
        (None, "We walked along the river and cooked a long dinner with plain rice."),
        ("unknown", "All rights reserved."),
    ]
    df = spark.createDataFrame([(k, f"first line\n{t}\nlast line") for k, (_, t) in enumerate(new)], "doc_id long, text string")
    for r in license_scan.scan(df, model).collect():
        family, text = new[r.doc_id]
        assert [f.family for f in r.found] == ([family] if family else []), text
        for f in r.found:
            assert f"first line\n{text}\nlast line".encode()[f.start : f.end].decode() == text and f.paragraph == 1
    assert license_scan.scan(odd, model).count() == len(ODD)
    assert license_scan.scan(odd.limit(0), model).count() == 0
    assert license_scan.sample(odd.limit(0)) == [] and license_scan.train([]).names[-1] == "ordinary"


def test_notices_within_long_lines(spark):
    rng = np.random.default_rng(6)
    words = "plain sentence about weather cooking and long walks by the river with rice bread old friends the work in a library".split()
    text = lambda n: " ".join(rng.choice(words, n))
    model = license_scan.train([text(int(rng.integers(5, 60))) + "." for _ in range(400)])
    mit, gpl, bsd = "Released under the MIT License.", TEMPLATES["GPL"][1], TEMPLATES["BSD"][0]
    lines = [(["MIT"], f"{text(300)}. {mit} {text(300)}"), (["GPL"], f"{text(40)} {gpl} {text(500)}"), ([], text(900)), (["MIT"], f"{text(20)} {mit}"), (["BSD", "GPL"], f"{bsd} {text(80)} {gpl} {text(9)}")]
    df = spark.createDataFrame([(k, f"first\n{t}") for k, (_, t) in enumerate(lines)], "doc_id long, text string")
    for r in license_scan.scan(df, model).collect():
        want, line = lines[r.doc_id]
        assert [f.family for f in r.found] == want, line
        assert all((f.paragraph, f.start, f.end) == (1, 6, 6 + len(line)) for f in r.found)


def test_templates_confirm_their_own_family_only():
    for family, texts in TEMPLATES.items():
        assert all(license_scan.confirmed(t, family) for t in texts)
    assert not license_scan.confirmed("Released under the MIT License.", "GPL")


# ------------------------------------------------------------------ op6 ---


def test_toxicity_on_held_out_documents(spark):
    rows = queries.QUERIES["op6_toxicity"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_toxicity_tells_held_out_rows_of_the_large_table(spark):
    """Every held-out labelled row counts, none is chosen."""
    large = "/root/testdata/sf0.1"
    rows = queries.QUERIES["op6_toxicity"](spark, large).join(spark.read.parquet(f"{large}/labels.parquet"), "doc_id").where("held_out and toxic is not null").collect()
    toxic, clean = ([r.predicted for r in rows if r.toxic == y] for y in (1, 0))
    assert len(toxic) > 50 and sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.05 * len(clean)


def _labelled(n, seed=3):
    rng = np.random.default_rng(seed)
    words = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ter", "sun") for b in ("ran", "del", "vor", "pin") for c in ("", "os", "ik", "und")]
    out = []
    for k in range(n):
        own = [words[i] for i in rng.integers(0, len(words), rng.integers(30, 200))]
        if k % 4 == 0:
            for _ in range(rng.integers(1, 5)):
                own.insert(int(rng.integers(len(own))), ("blarghface", "snotwaffle", "grumblord")[int(rng.integers(3))])
        out.append((" ".join(own), int(k % 4 == 0)))
    return out


def test_compression_distance_tells_new_texts():
    model = toxicity.train(_labelled(600))
    new = _labelled(200, seed=9)
    data, offsets = textbytes.texts(pa.array([t for t, _ in new]))
    row, dist = toxicity.Distances(model)(data, offsets)
    s = 1 / (1 + np.exp(-toxicity.features(row, dist, len(new), model.edge) @ model.weights))
    assert ((s >= 0.5) == np.array([y for _, y in new])).mean() >= 0.97
    assert b"snotwaffle" in model.toxic and b"snotwaffle" not in model.ordinary and len(model.toxic) == len(model.ordinary)


def test_windows_cover_every_byte():
    texts = ["", "a" * 500, "word " * 100, "x y " * 3, "é" * 90, " " * 70]
    data, offsets = textbytes.texts(pa.array(texts))
    row, start, end = toxicity.windows(data, offsets)
    for k, t in enumerate(texts):
        own = sorted((a, b) for r, a, b in zip(row, start, end) if r == k and b > a)
        assert b"".join(data[a:b].tobytes() for a, b in own) == t.encode()


def test_toxicity_of_odd_texts(spark, odd):
    model = toxicity.train(_labelled(600))
    got = toxicity.score(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score < 0.5 for r in got)
    assert toxicity.score(odd.limit(0), model).count() == 0
    nothing = toxicity.train([("only one class here", 0)] * 5)
    assert {r.score for r in toxicity.score(odd, nothing).collect()} == {0.0}
    labels = spark.createDataFrame([(None, 1), (7, None), (7, 1), (8, 0), (99, 1), (None, None)], "doc_id long, toxic int")
    assert toxicity.learned(odd, labels).weights is None
