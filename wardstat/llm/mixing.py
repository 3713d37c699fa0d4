"""Operator 7: mixing sources to target weights by Pareto order sampling.

Each source has a target number of words. Every document gets the whole copies
that the target certainly holds (``floor(target / source_size)``); the rest of
the target is drawn as one more copy of some documents. That draw is Pareto
order sampling: document i with inclusion probability p_i (in proportion to its
size, so long documents are likelier) and a uniform number u_i made from a hash of its
id has the rank value

    q_i = (u_i / (1 - u_i)) / (p_i / (1 - p_i))

and the documents of smallest q are taken as long as the words of the rest hold
them. The first that doesn't fit ends the draw, and one more document, whose size is nearest to
the words still missing (if it brings the sum nearer), closes it.

The order is found without sorting a source in one task: q / (1 + q) is cut
into ``BINS`` bins whose words are summed by Spark (partial sums first), the
bin that crosses the mark is cut again, and only the documents of one fine bin
per source are ranked by a window.

Defined cases: null or empty text has size 0 and takes 0 words; a null source is a
source of its own, last in order; repeated rows are documents of their own and rank
alike (row order decides between rows that are equal in every column used); a
null id hashes as its own value; a source whose size is 0 has target 0; an
empty table gives an empty result. Runs on the same rows agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardstat.llm.tables import pick, written

WORD_GAP = r"[\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MAX_RATIO = 3
BINS = 4096
SEED = 20240607


def n_words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` runs; null: 0."""
    parts = F.split(text, WORD_GAP)
    edge = F.when(F.element_at(parts, 1) == "", 1).otherwise(0) + F.when(
        (F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1
    ).otherwise(0)
    return F.when(text.isNull(), F.lit(0)).otherwise(F.size(parts) - edge).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_ratio: int = MAX_RATIO) -> DataFrame:
    """``source, source_size, target`` from rows ``source, size``.

    Sources in code point order, null last, get the weights in turn and share
    the sum of all sizes; a target stops at ``max_ratio`` times its source's
    size and the excess is shared by weight among the others until none is
    above. That fixed point is target = min(cap, weight * level): with sources
    sorted by cap / weight, the first k are at their caps, where k is the
    smallest number for which the level left for the others is at most the
    next one's cap / weight.
    """
    per = sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"),
        F.sum(F.col("size").cast("double") * F.col("size")).alias("_squares"),
    )
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]),
        (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"),
    )
    capped = (
        per.withColumn("_w", weight)
        .withColumn("_cap", F.col("source_size").cast("double") * max_ratio)
        .withColumn("_edge", F.col("_cap") / F.col("_w"))
    )
    order = Window.orderBy("_edge", F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.orderBy("_edge").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (
        (F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        / F.sum("_w").over(rest)
    )
    leveled = capped.withColumn("_level", level).withColumn(
        "_final",
        F.min(F.when(F.col("_level") <= F.col("_edge"), F.struct("_edge", "_level"))).over(every)["_level"],
    )
    return leveled.select(
        "source",
        "source_size",
        F.least(F.col("_cap"), F.coalesce(F.col("_w") * F.col("_final"), F.col("_cap"))).alias("target"),
        "_squares",
    )


def rank_value(size: Column, share: Column, seed: int = SEED) -> Column:
    """q / (1 + q) of Pareto order sampling; ``share`` is p_i per word."""
    named = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(f":{seed}"))
    u = (F.conv(F.substring(F.md5(named), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)  # 52 bits of the id's md5
    p = F.greatest(F.least(size * share, F.lit(1 - 1e-9)), F.lit(1e-12))
    q = (u / (1 - u)) / (p / (1 - p))
    return q / (1 + q)


def mix(docs: DataFrame, weights=WEIGHTS, max_ratio: int = MAX_RATIO, bins: int = BINS, seed: int = SEED) -> DataFrame:
    """``doc_id, row, source, size, source_size, target, copies, taken`` per row of
    ``docs``; ``row`` is a hash of the text."""
    sized = pick(docs, [("doc_id", "long"), ("text", "string"), ("source", "string")]).select(
        "doc_id", F.xxhash64("text").alias("row"), "source", n_words(F.col("text")).alias("size")
    )
    sized = written(sized, "mix-sizes")
    targets = source_targets(sized, weights, max_ratio)
    ratio = F.col("target") / F.col("source_size")
    # a target that equals whole copies up to rounding has no rest
    whole = F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.floor(ratio + 1e-12))
    plan = written(
        targets.withColumn("_whole", whole)
        .withColumn("_rest", F.greatest(F.col("target") - F.col("_whole") * F.col("source_size"), F.lit(0.0)))
        # expected words of the draw = sum(p_i * size_i) = the rest, with p_i = share * size_i
        .withColumn("_share", F.when(F.col("_squares") > 0, F.col("_rest") / F.col("_squares")).otherwise(0.0))
        .drop("_squares"),
        "mix-plan",
    )
    joined = sized.alias("d").join(plan.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select(
        "doc_id", "row", "d.source", "size", "source_size", "target", "_whole", "_rest", "_share"
    )
    ranked = joined.withColumn("_x", rank_value(F.col("size"), F.col("_share"), seed))
    coarse = F.least(F.floor(F.col("_x") * bins), F.lit(bins - 1)).cast("int")
    fine = F.least(F.floor((F.col("_x") * bins - F.col("_bin")) * bins), F.lit(bins - 1)).cast("int")
    ranked = written(
        ranked.withColumn("_bin", coarse).withColumn("_sub", fine).withColumn("_id", F.monotonically_increasing_id()), "mix-ranked"
    )
    edge1 = _crossing(ranked, plan, ["_bin"])
    edge2 = _crossing(_with_edge(ranked, edge1, "_edge1").where("_bin = _edge1"), edge1, ["_sub"])
    edges = written(
        edge1.alias("a")
        .join(edge2.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")), "left")
        .select(
            "a.source",
            F.col("a._edge").alias("_edge1"),
            F.col("b._edge").alias("_edge2"),
            F.coalesce(F.col("b._rest"), F.lit(0.0)).alias("_left"),
        ),
        "mix-edges",
    )
    placed = ranked.alias("d").join(edges.alias("e"), F.col("d.source").eqNullSafe(F.col("e.source")), "left").select(
        "d.*", "_edge1", "_edge2", "_left"
    )
    inside = (F.col("_bin") < F.col("_edge1")) | ((F.col("_bin") == F.col("_edge1")) & (F.col("_sub") < F.col("_edge2")))
    at_edge = (F.col("_bin") == F.col("_edge1")) & (F.col("_sub") == F.col("_edge2"))
    clear = placed.withColumn("_edgerow", F.coalesce(at_edge, F.lit(False)))
    order = Window.partitionBy("source").orderBy("_x", "doc_id", "row", "_id")
    last = (
        clear.where("_edgerow")
        .withColumn("_upto", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("_more", (F.col("_upto") <= F.col("_left")).cast("int"))
        .drop("_upto")
    )
    rest = clear.where(~F.col("_edgerow")).withColumn(
        "_more", F.coalesce(inside & (F.col("_rest") > 0), F.lit(False)).cast("int")
    )
    drawn = written(rest.unionByName(last).drop("_edgerow", "_edge1", "_edge2", "_left", "_bin", "_sub"), "mix-drawn")
    gaps = drawn.groupBy("source").agg((F.max("_rest") - F.sum(F.col("size") * F.col("_more"))).alias("_gap"))
    free = (
        drawn.where((F.col("_more") == 0) & (F.col("size") > 0) & (F.col("_rest") > 0)).alias("d")
        .join(gaps.alias("g"), F.col("d.source").eqNullSafe(F.col("g.source")))
        .select("d.source", "_id", "_x", "doc_id", "row", "_gap", F.abs(F.col("size") - F.col("_gap")).alias("_off"))
        .where(F.col("_off") < F.col("_gap"))
    )
    closing = free.groupBy("source").agg(F.min_by("_id", F.struct("_off", "_x", "doc_id", "row", "_id")).alias("_id"))
    closing = closing.select("_id", F.lit(1).alias("_close"))
    more = F.col("_more") + F.coalesce("_close", F.lit(0))
    copies = (F.col("_whole") + more).cast("int")
    return drawn.join(closing, "_id", "left").select(
        "doc_id", "row", "source", "size", "source_size", "target",
        copies.alias("copies"), (F.col("size") * copies).alias("taken"),
    )


def _with_edge(rows: DataFrame, edge: DataFrame, name: str) -> DataFrame:
    return (
        rows.alias("d")
        .join(edge.alias("e"), F.col("d.source").eqNullSafe(F.col("e.source")))
        .select("d.*", F.col("e._edge").alias(name))
    )


def _crossing(rows: DataFrame, marks: DataFrame, by: list[str]) -> DataFrame:
    """Per source, the bin in which the running words pass the mark ``_rest``
    of ``marks``, and what is left of the mark at that bin's start."""
    (name,) = by
    sums = rows.groupBy("source", name).agg(F.sum("size").alias("_words"))
    running = Window.partitionBy("source").orderBy(name).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = (
        sums.withColumn("_upto", F.sum("_words").over(running))
        .alias("s")
        .join(marks.select("source", "_rest").alias("m"), F.col("s.source").eqNullSafe(F.col("m.source")))
        .select("s.source", name, "_words", "_upto", "_rest")
    )
    return (
        upto.where((F.col("_upto") >= F.col("_rest")) & (F.col("_rest") > 0))
        .groupBy("source")
        .agg(F.min(F.struct(name, (F.col("_rest") - (F.col("_upto") - F.col("_words"))).alias("_left"))).alias("_m"))
        .select("source", F.col(f"_m.{name}").alias("_edge"), F.col("_m._left").alias("_rest"))
    )
