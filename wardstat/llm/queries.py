"""The operators' queries over the given tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardstat.llm import decontaminate, embedding_join, html_extract, lang_id, license_scan, mixing, ngram_join, pii, prefix_trie, suffix_dedup, token_output, toxicity, whiten
from wardstat.llm.tables import crc_mod, read
from wardstat.session import scratch_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLE[name] = oracle
        return fn

    return add


_DECON_SQL = r"""
WITH d AS (SELECT doc_id, text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(ws), 13) AS m, list_slice(ws, s, s + least(len(ws), 13) - 1) AS win
       FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS s FROM b WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT doc_id, s, m, list_slice(ws, s, s + m - 1) AS win
       FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS s FROM d, lens WHERE len(ws) >= m)),
hit AS (SELECT DISTINCT doc_id, s, dw.m AS m, item_id FROM dw JOIN bw USING (win)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + m)) AS p FROM (SELECT DISTINCT doc_id, s, m FROM hit)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""


_JACCARD_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, s, s + 4), ' ') AS g
       FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS s FROM d WHERE len(ws) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
sym AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, sym.b FROM reach JOIN sym ON reach.y = sym.a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id
FROM d LEFT JOIN size USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) r USING (doc_id)
"""

_REPEATS_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents),
pos AS (SELECT doc_id, p, md5_number(substr(hx, 2 * p + 1, 800)) AS h FROM (SELECT doc_id, hx, unnest(range(0, len(hx) // 2 - 399)) AS p FROM d WHERE len(hx) >= 800)),
twice AS (SELECT h FROM pos GROUP BY h HAVING count(*) > 1),
hit AS (SELECT doc_id, p, p > coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 400, -1) AS fresh FROM pos WHERE h IN (SELECT h FROM twice)),
span AS (SELECT doc_id, min(p) AS a, max(p) + 400 AS b FROM (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM hit) GROUP BY doc_id, k),
piece AS (SELECT span.doc_id, a, b, substr(hx, 2 * coalesce(lag(b) OVER w, 0) + 1, 2 * (a - coalesce(lag(b) OVER w, 0))) AS before
          FROM span JOIN d USING (doc_id) WINDOW w AS (PARTITION BY span.doc_id ORDER BY a)),
wd AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
wp AS (SELECT doc_id, p, md5_number(array_to_string(list_slice(ws, p, p + 50), ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 49)) AS p FROM wd WHERE len(ws) > 50)),
wt AS (SELECT h FROM wp GROUP BY h HAVING count(*) > 1),
shared AS (SELECT doc_id, count(DISTINCT p) AS n_shared FROM (SELECT doc_id, unnest(range(p, p + 51)) AS p FROM wp WHERE h IN (SELECT h FROM wt)) GROUP BY doc_id),
cut AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(before, '' ORDER BY a) AS head, max(b) AS upto FROM piece GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_shared, 0) AS BIGINT) AS n_shared_words, CAST(len(hx) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(hx, 2 * coalesce(upto, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id) LEFT JOIN shared USING (doc_id)
"""

_COSINE_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS s FROM v),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id WHERE a.s > 0 AND b.s > 0 AND list_dot_product(a.e, b.e) / (a.s * b.s) >= 0.9),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT reach.x, link.b FROM reach JOIN link ON reach.y = link.a),
part AS (SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT vec_id, CAST(coalesce(k, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM part LEFT JOIN (SELECT a AS vec_id, count(*) AS k FROM link GROUP BY a) c USING (vec_id)
"""


@query("op4_benchmark_decontamination", _DECON_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contaminated words of every document by benchmark windows of 13 words."""
    out = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


_MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, sum(CAST(size AS DOUBLE) * size) AS squares FROM d GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS DOUBLE) AS w, 3e0 * source_size AS cap FROM per),
e AS (SELECT *, cap / w AS edge FROM w),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY edge, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(w) OVER (ORDER BY edge, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM e),
t AS (SELECT source, source_size, squares, least(cap, coalesce(w * (SELECT arg_min(level, (edge, level)) FROM l WHERE level <= edge), cap)) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size + 1e-12) END AS whole FROM t),
r AS (SELECT *, greatest(target - whole * source_size, 0) AS rest FROM p),
s AS (SELECT *, CASE WHEN squares > 0 THEN rest / squares ELSE 0 END AS share FROM r),
u AS (SELECT d.doc_id, d.size, s.*, (CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':20240607'), 1, 13) AS BIGINT) + 0.5e0) / 4503599627370496e0 AS u,
             greatest(least(size * share, 1 - 1e-9), 1e-12) AS p FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
q AS (SELECT *, (u / (1 - u)) / (p / (1 - p)) AS q FROM u),
x AS (SELECT *, q / (1 + q) AS x FROM q),
c AS (SELECT *, CASE WHEN rest > 0 AND sum(size) OVER (PARTITION BY source ORDER BY x, doc_id) <= rest THEN 1 ELSE 0 END AS more FROM x),
g AS (SELECT *, rest - sum(size * more) OVER (PARTITION BY source) AS gap FROM c),
closing AS (SELECT source, arg_min(doc_id, (abs(size - gap), x, doc_id)) AS doc_id FROM g WHERE more = 0 AND size > 0 AND rest > 0 AND abs(size - gap) < gap GROUP BY source)
SELECT doc_id, size, source_size, target, CAST(size * (whole + more + CASE WHEN doc_id IN (SELECT doc_id FROM closing) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM g
"""


@query("op7_source_mixing", _MIX_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    out = mixing.mix(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


@query("op5_token_output")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places and checksums of every document's token ids, read back from the shard files."""
    path = scratch_folder(spark, "llm-shards")
    token_output.write_shards(read(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_output.read_shards(spark, path)


@query("op2_language_id")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document by the byte network."""
    docs = read(spark, sf_dir, "documents")
    out = lang_id.identify(docs, lang_id.learned(docs))
    held = crc_mod("doc_id", lang_id.FOLDS) == lang_id.HELD
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


@query("op6_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by compression distance."""
    docs = read(spark, sf_dir, "documents")
    out = toxicity.score(docs, toxicity.learned(docs, read(spark, sf_dir, "labels")))
    held = crc_mod("doc_id", toxicity.FOLDS) == toxicity.HELD
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


#: for pages whose article has paragraphs, bold runs and breaks only, as the given ones have
_ARTICLE_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)(</article>|$)', 1, 's') AS m FROM pages),
plain AS (SELECT page_id, url, regexp_replace(regexp_replace(m, '</?b>', '', 'g'), '<[^>]*(>|$)', ' ', 'g') AS m FROM a),
told AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(m, '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g') AS m FROM plain),
t AS (SELECT page_id, url, trim(regexp_replace(m, '[ \t\n\r\f]+', ' ', 'g')) AS text FROM told)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM t
"""


@query("op10_html_extraction", _ARTICLE_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract(read(spark, sf_dir, "pages"))


@query("op9_embedding_near_dedup", _COSINE_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of every vector at cosine 0.9."""
    return embedding_join.near_duplicates(read(spark, sf_dir, "embeddings"))


@query("op1_ngram_jaccard_join", _JACCARD_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents at Jaccard similarity 0.8 of five-word shingles."""
    return ngram_join.join(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op8_suffix_array_dedup", _REPEATS_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document in strings of 400 bytes that recur."""
    docs = read(spark, sf_dir, "documents")
    out = suffix_dedup.remove_repeats(docs, keep_first=False, passages=suffix_dedup.shared_passages(docs))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.col("n_shared").alias("n_shared_words"))


@query("op3_license_scan")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families named in every document."""
    docs = read(spark, sf_dir, "documents")
    out = license_scan.scan(docs, license_scan.train(license_scan.sample(docs)))
    families = F.array_sort(F.array_distinct(F.transform("found", lambda f: f["family"])))
    return out.select("doc_id", "n_paragraphs", F.size("found").cast("long").alias("n_licence"), F.array_join(families, ",").alias("families"))


_TRIE_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
r AS (SELECT conv_id, turn, md5(concat(strlen(role), ':', role, text)) AS k, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w FROM t),
own AS (SELECT conv_id, list({'k': k, 'w': w} ORDER BY turn NULLS FIRST, k) AS own FROM r GROUP BY conv_id),
crc AS (SELECT conv_id, own, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
               lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295) % 4 AS h FROM own),
b AS (SELECT c.conv_id, list_concat(coalesce(list_slice(f.own, 1, h), []), list_slice(c.own, h + 1, len(c.own))) AS seq
      FROM crc c LEFT JOIN own f ON f.conv_id = c.conv_id - c.conv_id % 20),
pre AS (SELECT conv_id, d, list_slice(list_transform(seq, lambda x: x.k), 1, d) AS p, coalesce(seq[d].w, 0) AS w, d = len(seq) AS ends
        FROM (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS d FROM b)),
node AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n, max(w) AS w, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends) AS e FROM pre GROUP BY p, d),
kids AS (SELECT list_slice(p, 1, d - 1) AS p, count(*) AS k FROM node WHERE d > 0 GROUP BY 1),
every AS (SELECT node.*, coalesce(k, 0) AS k FROM node LEFT JOIN kids USING (p)),
below AS (SELECT list_slice(p, 1, a) AS p, sum(CAST(k = 0 AS INT)) AS leaves, sum((n - 1) * w) AS saved
          FROM (SELECT p, k, n, w, unnest(range(0, d + 1)) AS a FROM every) GROUP BY 1)
SELECT x.conv_id, CAST(x.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, CAST(x.n AS BIGINT) AS n_convs, CAST(x.k AS BIGINT) AS n_children,
       CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(x.e, '')) AS ends_sha256
FROM every x JOIN below USING (p) LEFT JOIN every u ON x.d > 0 AND u.p = list_slice(x.p, 1, x.d - 1)
"""


@query("op13_conversation_trie", _TRIE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of the rebuilt conversations."""
    return prefix_trie.trie(read(spark, sf_dir, "conversations"))


@query("op11_embedding_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First four whitened components of every vector."""
    return whiten.whitened(read(spark, sf_dir, "embeddings"))


@query("op12_personal_data")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document: those of the expressions, and those that bootstrapping adds."""
    out = pii.personal_data(read(spark, sf_dir, "documents"))
    return out.select("doc_id", *[f"n_{kind}" for kind in pii.KINDS], F.sha2("base_told", 256).alias("base_sha256"), "spans")
