"""Operator 4: benchmark decontamination as a prefix-filtered set join.

A window (13 consecutive item words; a shorter item is one window) occurs in a
document when all its words do, in order. Its tokens are its runs of three
words (one word, where a window has fewer than three). For full containment the
prefix filter needs one token: the window's rarest in the corpus. So

1. one pass over the documents keeps the places of tokens that any item has
   (and the number of words); the places are written to the shared folder;
2. tokens are ordered by their number of places over all documents, and each
   window keeps its rarest one;
3. the places of those tokens are joined with the windows; positional and length
   bounds drop windows that would begin before or end after the document;
4. candidates are verified word by word on the documents that have any.

Everything is DataFrame functions. The token table of the items is broadcast
only when it has at most ``BROADCAST_ROWS`` rows of 8 bytes; beyond that the
join is left to the planner.

Defined cases: null text or text without words has 0 words, is hit by nothing; null or
wordless items match nothing; repeated rows give repeated result rows (a row is
known by doc_id and text); items equal in text all count; an empty benchmark leaves
every document clean; a null item_id is not counted in n_items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardstat.llm.tables import pick, small_enough, written

WINDOW = 13
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GRAM = 3
BROADCAST_ROWS = 1_000_000
#: place of no token: keeps a row for every document in the one pass
MARK = 0


def words(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z in lower case; null: none."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP), lambda w: w != "")


def _tokens(ws: Column, gram: int) -> Column:
    """Hash of the run of ``gram`` words at each position where one begins."""
    return F.transform(ws, lambda w, i: F.xxhash64(w, *[F.get(ws, i + k) for k in range(1, gram)]))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows: ``win`` (its words), ``gram``, ``tokens`` and the ``items`` that have it."""
    ws = words(F.col("text"))
    items = pick(benchmark, [("item_id", "string"), ("text", "string")]).select("item_id", ws.alias("_ws")).where(F.size("_ws") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("_ws") - window + 1, F.lit(1)))
    wins = items.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("_ws", s, window))).alias("win"))
    return (
        wins.groupBy("win")
        .agg(F.collect_set("item_id").alias("items"))
        .withColumn("gram", F.when(F.size("win") >= GRAM, GRAM).otherwise(1))
        .withColumn("win_id", F.xxhash64("win"))
    )


def _token_rows(wins: DataFrame) -> DataFrame:
    """``win_id, gram, token, off``: each whole token of each window."""
    kinds = []
    for gram in (GRAM, 1):
        whole = F.slice(_tokens(F.col("win"), gram), F.lit(1), F.size("win") - gram + 1)
        kinds.append(wins.where(F.col("gram") == gram).select("win_id", "gram", F.posexplode(whole).alias("off", "token")))
    return kinds[0].unionByName(kinds[1])


def _places(docs: DataFrame, wanted: DataFrame, gram: int) -> DataFrame:
    """``doc_id, row, n_words, gram, token, pos`` of the wanted tokens, and one mark per document row."""
    ws = words(F.col("text"))
    base = docs.select("doc_id", F.xxhash64("text").alias("row"), ws.alias("_ws"))
    marked = base.select(
        "doc_id", "row", F.size("_ws").cast("long").alias("n_words"),
        F.posexplode(F.concat(F.array(F.lit(MARK).cast("long")), _tokens(F.col("_ws"), gram))).alias("pos", "token"),
    )
    keep = wanted.where(F.col("gram") == gram).select("token").distinct().unionByName(
        wanted.sparkSession.range(1).select(F.lit(MARK).cast("long").alias("token"))
    ).distinct()
    if small_enough(keep, BROADCAST_ROWS):
        keep = F.broadcast(keep)
    return marked.join(keep, "token").select(
        "doc_id", "row", "n_words", F.lit(gram).alias("gram"), "token", (F.col("pos") - 1).alias("pos")
    )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, row, n_words, n_hit, n_items, items`` per document row, where
    ``row`` is a hash of the text (rows of one id may differ) and ``items`` are the sorted item ids."""
    docs = pick(docs, [("doc_id", "long"), ("text", "string")])
    wins = written(benchmark_windows(benchmark, window), "decon-windows")
    toks = written(_token_rows(wins), "decon-tokens")
    places = _places(docs, toks, GRAM)
    if toks.where("gram = 1").limit(1).count():
        places = places.unionByName(_places(docs, toks, 1).where(F.col("pos") >= 0))
    places = written(places, "decon-places")
    every = places.where("pos < 0").select("doc_id", "row", "n_words")

    rarity = places.where("pos >= 0").groupBy("gram", "token").agg(F.count("*").alias("places"))
    # a token with no place in the corpus rules its window out at once
    first = (
        toks.join(rarity, ["gram", "token"], "left")
        .groupBy("win_id")
        .agg(
            F.min(F.struct(F.coalesce("places", F.lit(0)).alias("places"), "token", "off", "gram")).alias("m"),
        )
        .where("m.places > 0")
        .select("win_id", "m.gram", "m.token", "m.off")
    )
    starts = (
        places.where("pos >= 0")
        .join(first, ["gram", "token"])
        .join(wins.select("win_id", "win"), "win_id")
        .withColumn("start", F.col("pos") - F.col("off"))
        .where((F.col("start") >= 0) & (F.col("start") + F.size("win") <= F.col("n_words")))
        .select("doc_id", "row", "start", "win_id", "win")
        .distinct()
    )
    claims = starts.groupBy("doc_id", "row").agg(F.collect_list(F.struct("start", "win_id", "win")).alias("_claims"))
    texts = docs.withColumn("row", F.xxhash64("text")).alias("d")
    joined = texts.join(claims.alias("c"), F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("d.row") == F.col("c.row")))
    true = F.filter("_claims", lambda c: F.slice("_ws", c["start"] + 1, F.size(c["win"])) == c["win"])
    # at most one row for each document row's (doc_id, row): repeated rows get theirs back below
    seen = (
        joined.select("d.doc_id", "d.row", words(F.col("d.text")).alias("_ws"), "_claims")
        .dropDuplicates(["doc_id", "row"])
        .select("doc_id", "row", true.alias("_true"))
        .where(F.size("_true") > 0)
    )
    seen = written(
        seen.select(
            "doc_id", "row",
            F.transform("_true", lambda c: F.struct(c["start"].alias("start"), (c["start"] + F.size(c["win"])).alias("end"))).alias("_spans"),
            F.array_distinct(F.transform("_true", lambda c: c["win_id"])).alias("_wins"),
        ),
        "decon-seen",
    )
    found = (
        seen.select("doc_id", "row", F.explode("_wins").alias("win_id"))
        .join(wins.select("win_id", F.explode("items").alias("item")), "win_id")
        .groupBy("doc_id", "row")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )
    hits = seen.select("doc_id", "row", covered(F.col("_spans")).alias("n_hit"))
    hits = _by_row(hits, found, ["n_hit", "items"])
    out = _by_row(every, hits, ["n_words", "n_hit", "items"])
    none = F.array().cast("array<string>")
    return out.select(
        "doc_id", "row", "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.coalesce("items", none).alias("items"),
    )


def _by_row(left: DataFrame, right: DataFrame, values: list[str]) -> DataFrame:
    a, b = left.alias("a"), right.alias("b")
    on = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & F.col("a.row").eqNullSafe(F.col("b.row"))
    return a.join(b, on, "left").select("a.doc_id", "a.row", *values)


def covered(spans: Column) -> Column:
    """Number of places inside any of the spans ``[start, end)``."""
    zero = F.struct(F.lit(0).cast("int").alias("upto"), F.lit(0).cast("int").alias("n"))
    return F.aggregate(
        F.sort_array(spans),
        zero,
        lambda a, s: F.struct(
            F.greatest(a["upto"], s["end"]).alias("upto"),
            (a["n"] + F.greatest(s["end"] - F.greatest(a["upto"], s["start"]), F.lit(0))).alias("n"),
        ),
        lambda a: a["n"],
    )


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
