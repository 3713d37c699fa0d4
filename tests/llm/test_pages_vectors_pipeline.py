from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from wardstat.llm import embedding_join, html_extract, queries

SMALL = "/root/testdata/sf0.001"

# ----------------------------------------------------------------- op10 ---


def text_of(page):
    cut = html_extract.blocks(page)
    return " ".join(t for main, t in cut if main)


@pytest.mark.parametrize(
    "page,want",
    [
        ("<article><h1>A &amp; B</h1><p>one<br>two <b>th</b>ree</article>", "A & B one two three"),
        ("<nav><p>menu</nav><article><p>x <!-- no <p> --> y<script>var t='</p>';</script></p></article><footer>f", "x y"),
        ("<main><header><h1>Title</h1></header><p>a\n\t b&nbsp;c</p><div class='ad-box'>buy</div><aside>s</aside><form>f</form><p>z</main>", "Title a b c z"),
        ('<article><p title="a > b">q</p><section id="comments"><p>me too</section><div role="navigation">n</div><p hidden>h<p>end &lt;tag&gt; &#233; &eacute', "q end <tag> é é"),
        ("<article><p>cut in a tag <b", "cut in a tag"),
        ("<article>a < b and c</article>", "a < b and c"),
        ("<article><ul><li>1<li>2</ul><table><tr><td>3<td>4</table>", "1 2 3 4"),
        ("<article><style>p{}</style>t<noscript>n</noscript></article><article class='comment'>no</article>", "t"),
        ("<main><div class='commentlist'>c</div><div class='header'>t</div><p>b</p><div id='ad1'>x</div><p class='adult shadow'>y", "t b y"),
        ("", ""),
        ("plain text without markup", ""),
    ],
)
def test_main_text(page, want):
    assert text_of(page) == want


def test_runs_and_their_pages_are_brute_force():
    rng = np.random.default_rng(2)
    for trial in range(40):
        pages = [list(rng.integers(0, 4, rng.integers(0, 40))) for _ in range(4)]
        for p in pages[1:]:
            p[3:3] = pages[0][5 : 5 + int(rng.integers(0, 15))]
        run = int(rng.integers(2, 9))
        tokens, page = np.array(sum(pages, []), np.uint64), np.repeat(np.arange(4), [len(p) for p in pages])
        at, pages_of = html_extract.runs(tokens, page, run)
        where, first, begin = {}, {}, 0
        for k, p in enumerate(pages):
            for i in range(len(p) - run + 1):
                where.setdefault(tuple(p[i : i + run]), set()).add(k)
                first.setdefault(tuple(p[i : i + run]), begin + i)
            begin += len(p)
        assert sorted(zip(at.tolist(), pages_of.tolist())) == sorted((first[w], len(on)) for w, on in where.items())


@pytest.mark.parametrize("n,partitions,host_pages", [(60, 1, 512), (60, 5, 7), (300, 1, 20), (300, 5, 20)])
def test_a_notice_on_some_pages_goes_however_the_host_is_grouped(spark, n, partitions, host_pages):
    notice = "this site stores small files on your device to count visits"
    own = lambda k: " ".join(f"p{k}x{i}" for i in range(15))
    rows = [(k, f"http://h.org/{k}", f"<div>{own(k)}</div>" + (f"<div>{notice}</div>" if k % (n // 10) == 0 else "")) for k in range(n)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(partitions)
    got = {r.page_id: r.text for r in html_extract.extract(df, host_pages=host_pages).collect()}
    assert got == {k: own(k) for k in range(n)}


def test_copies_of_a_page_keep_their_text(spark):
    page = "<div>" + " ".join(f"same{i}" for i in range(20)) + "</div>"
    rows = [(k, f"http://h.org/{k}", page) for k in range(40)] + [(99, "http://h.org/99", "<div>quite another page with a few words of its own</div>")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4), host_pages=2).collect()
    assert len(got) == 41 and all(r.text == " ".join(f"same{i}" for i in range(20)) for r in got if r.page_id < 99)


@pytest.mark.parametrize(
    "page,want",
    [
        ("<article><p title=it's>Hello there world</p><p>second don't stop</p></article>", "Hello there world second don't stop"),
        ("<article><div class='content has-sidebar'><p>one</p></div><div class=alert-text>two</div><div class='banner-story'>three</div><div id='side'>four</div></article>", "one two three four"),
        ("<article><div class='sidebar'>no</div><div class='x comment-list'>no</div><div id=newsletter-signup>no</div><p class=\"ad-box\">no</p><p>yes</article>", "yes"),
        ("<article><p title='class=\"sidebar\"'>kept</p><p data-x=\"a>b\" class = wide>too</p></article>", "kept too"),
        ('<article>before<p title="never closed>lost</p></article>', "before"),
        ("<article><a href=/x?q='y'>link</a><br/><p a==b c>end</article>", "link end"),
    ],
)
def test_attributes_and_names_of_wrappers(page, want):
    assert text_of(page) == want


def test_pages_without_an_article_lose_what_their_host_repeats(spark):
    menu = "<div>home news sport weather about contact imprint help and more links</div>"
    rows = [(k, f"http://h.org/{k}", f"<body>{menu}<div>{' '.join(f'w{k}x{i}' for i in range(12))}</div>{menu}") for k in range(20)]
    rows += [(100, "http://other.org/", f"<body>{menu}"), (101, None, None), (102, "no url", ""), (7, "http://h.org/7", rows[7][2])]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "page_id long, url string, html string, host string, part int")
    got = html_extract.extract(df).collect()
    assert Counter((r.page_id, r.url) for r in got) == Counter((i, u) for i, u, _ in rows)
    by = {r.page_id: r.text for r in got}
    assert "home" not in by[3] and by[3] == " ".join(f"w3x{i}" for i in range(12)) and by[100].startswith("home news") and by[101] == by[102] == ""
    assert by[7].startswith("w7x0 w7x1")  # a row that occurs twice is one page
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_extract.extract(df.limit(0)).count() == 0


def test_large_hosts_are_split(spark, monkeypatch):
    monkeypatch.setattr(html_extract, "HOST_PAGES", 10)
    rows = [(k, f"http://big.org/{k}", f"<article><p>text {k}</article>") for k in range(95)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {(r.page_id, r.text) for r in got} == {(k, f"text {k}") for k in range(95)}


def test_a_box_that_the_host_repeats_goes_from_articles(spark):
    box = "read more of our stories every morning in the new edition"
    line = "the author has nothing else to say about this matter today"
    own = lambda k, n: " ".join(f"p{k}x{i}" for i in range(n))
    rows = [(k, f"http://h.org/{k}", f"<article><h1>{own(k, 3)}</h1><p class=text>{line}</p><p>{own(k, 30)}</p><div class='zz'>{box}</div></article>") for k in range(12)]
    rows.append((50, "http://two.org/", rows[0][2].replace("zz", "yy")))  # this host doesn't repeat it
    rows += [(60 + k, f"http://few.org/{k}", f"<article><h1>{k}</h1><div class='body'>{box}</div></article>") for k in range(5)]  # most of the page
    rows.append((70, "http://h.org/70", f"<article><div>{box}</div><p>{own(70, 30)}</p></article>"))  # no name: prose
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in html_extract.extract(df, host_pages=5).collect()}
    assert got == {k: f"{own(k, 3)} {line} {own(k, 30)}" for k in range(12)} | {
        50: f"{own(0, 3)} {line} {own(0, 30)} {box}", 70: f"{box} {own(70, 30)}", **{60 + k: f"{k} {box}" for k in range(5)}
    }


# ------------------------------------------------------------------ op9 ---


@pytest.mark.parametrize("leaf,width", [(16_384, 16), (40, 5), (25, 16)])
def test_vector_links_are_brute_force(spark, leaf, width):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(120, 16))
    near = [base[i] + rng.normal(0, s, 16) for i in range(60) for s in (0.1, 0.25, 0.35)]
    hub = [base[0] + rng.normal(0, 0.05, 16) for _ in range(40)]
    vectors = [list(map(float, v)) for v in [*base, *near, *hub, *base[:5], *base[:3]]]
    vectors += [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] * 16, [1.0, 2.0], [2.0, 4.0], [1.0], [-0.0] + [1.0] * 15, [0.0] + [1.0] * 15]
    ids = [int(i) for i in rng.permutation(len(vectors)) * 3]
    df = spark.createDataFrame([(i, v, 1, "z") for i, v in zip(ids, vectors)], "vec_id long, embedding array<double>, n int, cls string").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_join.near_duplicates(df, leaf=leaf, width=width).collect()}
    links, part = brute.vector_links(vectors)
    low = {}
    for i, p in zip(ids, part):
        low[p] = min(low.get(p, i), i)
    assert got == {i: (n, low[p], i == low[p]) for i, n, p in zip(ids, links, part)}


def test_tiny_and_huge_vectors(spark):
    """Components whose squares leave the range of doubles link by their directions."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=(60, 16))
    vectors = [list(map(float, v)) for v in base] + [[1e-170] * 16, [2e-170] * 16, list(map(float, base[0] * 1e-200)), list(map(float, base[1] * 1e200)), [5e-324] + [0.0] * 15]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_join.near_duplicates(df).collect()}
    assert got[60] == got[61] == (1, 60) and got[62] == (1, 0) and got[63] == (1, 1) and got[0] == (1, 0)
    assert got[64] == (0, 64) and len(got) == 65


def test_a_pair_at_the_edge_of_a_share_counts_once():
    """Pairs whose part in a block is the share and a little more, or exactly the limit."""
    rng = np.random.default_rng(8)
    plan = embedding_join.Plan(embedding_join._unit(rng.normal(size=(500, 8))), 500, 0.9, 4, 16_384)
    for over in (-5e-5, 0.0, 5e-7, 1e-6, 2e-6, 5e-5, 9e-5):
        for full in (0, 1):
            x, y = np.zeros((2, 8))
            for block, (a, b) in enumerate(zip(plan.edges, plan.edges[1:])):
                part = plan.shares[block] + over if block == full else plan.shares[block] - 1e-3
                angle = np.arccos(1 - part)  # half of the square length lies in each block
                x[a], y[a], y[a + 1] = np.sqrt(0.5), np.sqrt(0.5) * np.cos(angle), np.sqrt(0.5) * np.sin(angle)
            vec = np.array([x, y]) @ plan.rotation.T
            links = Counter()
            for block in range(2):
                table = pa.table({"block": pa.array([block] * 2, pa.int32()), "a": pa.array([0, 0], pa.int32()), "b": pa.array([0, 0], pa.int32()), "home": pa.array([0, 0], pa.int32()),
                                  "cls": pa.array([3, 5]), "n": pa.array([1, 1]), "vec": pa.array(vec.tolist())})
                for r in embedding_join._tile(plan)(table).to_pylist():
                    links[r["cls"]] += r["links"]
            assert links == {3: 1, 5: 1}, (over, full)


def test_a_box_of_too_many_vectors_is_dealt_into_pieces(spark):
    """Near copies that no median parts: no tile holds more than about two pieces, and no link is lost."""
    rng = np.random.default_rng(4)
    hub = rng.normal(size=16)
    vec = np.concatenate([hub + rng.normal(0, 1e-3, (1500, 16)), rng.normal(size=(100, 16))])
    plan = embedding_join.Plan(embedding_join._unit(vec[-50:]), len(vec), 0.9, 16, 100)
    batch = pa.RecordBatch.from_pydict({"cls": pa.array(np.arange(len(vec))), "n": pa.array(np.ones(len(vec), np.int64)), "vec": pa.array(vec.tolist())})
    counts = [tuple(r.values()) for b in embedding_join._count(plan)(iter([batch])) for r in b.to_pylist()]
    assert sum(n for _, _, n in counts) == len(vec)
    plan.split([c for c in counts if c[2] > 100], 100)
    tiles = Counter((r["block"], r["a"], r["b"]) for b in embedding_join._deal(plan)(iter([batch])) for r in b.select(["block", "a", "b"]).to_pylist())
    assert max(tiles.values()) < 2 * 100 * 1.5
    df = spark.createDataFrame([(k, v) for k, v in enumerate(vec.tolist())], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_join.near_duplicates(df, leaf=100).collect()}
    unit = embedding_join._unit(vec)
    near = unit @ unit.T >= 0.9
    assert {k: n for k, (n, _) in got.items()} == dict(enumerate((near.sum(axis=1) - 1).tolist()))
    assert all(got[k][1] == 0 for k in range(1500))


def test_vectors_with_null_and_repeated_ids(spark):
    rows = [(None, [1.0, 0.0]), (4, [1.0, 0.0]), (4, [1.0, 0.0]), (9, [0.99, 0.01]), (None, None), (11, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_join.near_duplicates(df).collect())
    assert got == Counter([(None, 3, 4, False), (4, 3, 4, True), (4, 3, 4, True), (9, 3, 4, False), (None, 0, None, False), (11, 0, 11, True)])
    assert embedding_join.near_duplicates(df.limit(0)).count() == 0
    assert embedding_join.near_duplicates(df.where("vec_id = 4 and embedding is null")).count() == 0


# ------------------------------------------------------------- pipeline ---


def test_pipeline_stages_are_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    rows = docs.collect()
    rows += [rows[5], rows[5]]  # repeated rows
    docs = spark.createDataFrame(rows, docs.schema)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "ngram_jaccard_join", "benchmark_decontamination", "source_mixing", "token_output"]
    told = stages["language_id"](spark, docs, SMALL)
    assert told.columns == columns
    got = told.collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in rows if any(c.isalpha() for c in r.text or ""))
    one = stages["ngram_jaccard_join"](spark, spark.createDataFrame(got, docs.schema), SMALL)
    assert one.columns == columns
    kept = one.collect()
    want = brute.jaccard_components({r.doc_id: r.text for r in got})
    assert sorted(r.doc_id for r in kept) == sorted(i for i, (n, c) in want.items() if c == i)
    clean = stages["benchmark_decontamination"](spark, spark.createDataFrame(kept, docs.schema), SMALL)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    hits = brute.contamination([r.text for r in kept], items)
    left = clean.collect()
    assert clean.columns == columns
    assert sorted(r.doc_id for r in left) == sorted(r.doc_id for r, (n, h, _) in zip(kept, hits) if not (h > 0 and 20 * h >= n))
    mix = stages["source_mixing"](spark, spark.createDataFrame(left, docs.schema), SMALL)
    assert mix.columns == columns
    picked = mix.collect()
    assert max(Counter(r.doc_id for r in picked).values()) <= 3 and {r.doc_id for r in picked} <= {r.doc_id for r in left}
    out = stages["token_output"](spark, spark.createDataFrame(picked, docs.schema), SMALL).orderBy("start").collect()
    import public_tokenizers

    order = sorted(picked, key=lambda r: (r.doc_id, r.text.encode()))
    ids = brute.tokens([r.text for r in order], public_tokenizers.path("byte_bpe_50k.json"))
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in out] == [(r.doc_id, *w) for r, w in zip(order, ids)]


def test_pipeline_on_odd_rows_and_none(spark, docs, no_docs):
    """Odd rows and columns with clashing names go through every stage."""
    for table in (docs, no_docs):
        df = table
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, SMALL)
            if name != "token_output":
                assert out.columns == df.columns
            df = spark.createDataFrame(out.collect(), out.schema)
        assert df.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert no_docs.count() == 0


def test_run_applies_the_stages_and_deletes_what_it_no_longer_reads(spark):
    from wardstat import session

    mark = session.scratch_mark(spark)
    other = session.scratch_folder(spark, "other")
    spark.range(3).write.parquet(other)
    out = corpus_pipeline.run(spark, SMALL)
    rows = out.collect()
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and len(rows) > 100
    assert spark.read.parquet(other).count() == 3  # not this run's
    left = session._SCRATCH[spark][mark + 1 :]
    assert len(left) == 2 and sum("source_mixing" in p for p in left) == 1 and sum("shards" in p for p in left) == 1
    starts = sorted((r.start, r.n_tokens) for r in rows)
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


# -------------------------------------------------------------- queries ---


def test_queries_against_sql(spark):
    from oracle_compare import compare, duck

    con = duck(SMALL)
    for name, sql in queries.ORACLE.items():
        assert compare(spark, name, queries.QUERIES[name], sql, SMALL, con)["ok"], name


def test_one_query_for_each_operator(spark):
    assert [n.split("_")[0] for n in sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{k}" for k in range(1, 14)]


def test_language_sends_each_text_to_python_once(spark, monkeypatch):
    seen, real = [], corpus_pipeline.lang_id.identify
    monkeypatch.setattr(corpus_pipeline.lang_id, "identify", lambda docs, *a, **k: seen.append(docs) or real(docs, *a, **k))
    texts = ["the cat and the dog went to the house", "der Hund und die Katze gehen in das Haus", None, "12 34"]
    rows = [(n, texts[k % 4], ("en", "de", "en", "de")[k % 4], k, str(n), None) for k, n in enumerate(range(5, 45))]
    docs = spark.createDataFrame(rows, "score long, text string, lang string, doc_id long, lang_pred string, `other.x` string")
    out = corpus_pipeline.language(spark, docs, "")
    assert seen[0].schema.simpleString().count("text:") == 1
    assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
    got = {tuple(r) for r in out.collect()}
    assert got and got <= {r for r in rows if r[1] and r[1] != "12 34"}
