"""Mixing sources to target weights.

Entropy balancing: among all ways to give documents a rate of copies, take the one that is closest (relative entropy, one
copy a document being the start) to the corpus as it is, subject to each source's token goal and the cap on repeats. The
optimum tilts the rate of a document exponentially by its length, min(cap, exp(dual * tokens / mean tokens of its
source)): a source that gives more than it has repeats its long documents more, one that gives less drops them first, so
the fewest documents are touched for the tokens that are missing. The duals are found by Newton steps, each one
distributed aggregation over the histogram of (source, tokens). Rates are then rounded into copies so that a source's
tokens miss its goal by about one document, whatever its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.tokens import count_tokens
from cairn.session import cut

#: Newton steps at most (a report says where they did not suffice), and the relative error at which they end.
STEPS, TOLERANCE = 60, 1e-9
#: Documents of one source and length that one task ranks; longer runs are cut into salts.
RUN = 50_000
#: Corrections of single copies after rounding.
MOVES = 2


def goals(targets: DataFrame, supply: DataFrame, total: float | None = None) -> DataFrame:
    """(mix, source, weight, cap, target_share, documents, supply, wanted, goal): the tokens each source should and can give.

    targets: (mix, source, weight, max_repeats). Equal rows are one; other rows of a mix and source add up their weights
    and take the smallest cap. target_share is relative to all weights of the mix. A source without tokens, or with a
    weight that is null, not positive or not a number, has no goal; the others keep their relative shares.

    A mix has `total` tokens: a source whose cap does not give its share gives all it can, wanted - goal is what is
    missing. Without a total it is as large as the caps allow at exact shares; without any cap, as its sources."""
    rows = targets.where("mix is not null and source is not null").select("mix", "source", "weight", "max_repeats").distinct()
    usable = F.when((F.col("weight") > 0) & ~F.isnan("weight"), F.col("weight")).otherwise(0.0)
    each = rows.groupBy("mix", "source").agg(F.sum(usable).alias("weight"), F.min("max_repeats").alias("cap"))
    each = each.join(supply, "source", "left").fillna(0, ["documents", "supply"])
    mix = Window.partitionBy("mix")
    live = (F.col("weight") > 0) & (F.col("supply") > 0) & (F.col("cap").isNull() | (F.col("cap") > 0))
    share = F.when(live, F.col("weight")) / F.sum(F.when(live, F.col("weight"))).over(mix)
    most = F.col("cap") * F.col("supply")
    size = F.coalesce(F.min(most / F.col("share")).over(mix), F.sum(F.when(live, F.col("supply"))).over(mix)) if total is None else F.lit(float(total))
    each = each.withColumn("target_share", F.try_divide(F.col("weight"), F.sum("weight").over(mix))).withColumn("share", share)
    each = each.withColumn("wanted", size * F.col("share"))
    return each.withColumn("goal", F.when(F.col("wanted").isNotNull(), F.least("wanted", most.cast("double")))).drop("share")


def tilted(dual: Column, tokens: Column, mean: Column, cap: Column) -> Column:
    """The rate of a document; all at the cap where the dual is null."""
    return F.coalesce(F.least(F.exp(F.least(dual * tokens / mean, F.lit(700.0))), F.coalesce(cap, F.lit(float("inf")))), cap)


def solve_duals(goal_rows: DataFrame, histogram: DataFrame) -> DataFrame:
    """goal_rows with `dual`, `mean` (tokens a document of the source) and `converged`, null without a goal. A source that
    gives all it can has a null dual: all its documents are at the cap.

    The dual function of a source is convex with slope mass - goal, where mass = sum(n * tokens * rate), and its curvature is
    the sum over the documents below the cap. The Newton step is taken on the logarithm of the mass; a step that leaves the
    known bracket is halved into it. Each step aggregates the histogram and cuts the lineage."""
    mean = (F.col("supply") / F.col("documents")).alias("mean")
    cap = F.col("cap").cast("double").alias("cap")
    full = F.col("goal") >= F.col("cap") * F.col("supply") * (1 - TOLERANCE)
    asked = goal_rows.where("goal is not null").select("mix", "source", "goal", cap, mean, F.coalesce(full, F.lit(False)).alias("full"))
    known = ["mix", "source", "goal", "cap", "mean", "full"]
    state = cut(asked.select(*known, F.lit(0.0).alias("dual"), F.lit(-60.0).alias("low"), F.lit(60.0).alias("high"), F.col("full").alias("done")))
    for _ in range(STEPS):
        rate = tilted(F.col("dual"), F.col("tokens"), F.col("mean"), F.col("cap"))
        mass = F.col("n") * F.col("tokens") * rate
        below = F.col("cap").isNull() | (rate < F.col("cap"))
        sums = histogram.join(state.where("not done"), "source").groupBy("mix", "source").agg(
            F.sum(mass).alias("mass"), F.sum(F.when(below, mass * F.col("tokens") / F.col("mean")).otherwise(0.0)).alias("curve")
        )
        slope = F.col("mass") - F.col("goal")
        step = F.col("dual") + F.ln(F.col("goal") / F.col("mass")) * F.try_divide(F.col("mass"), F.col("curve"))
        reached = F.abs(slope) <= F.col("goal") * TOLERANCE
        low, high = F.when(slope < 0, F.col("dual")).otherwise(F.col("low")), F.when(slope > 0, F.col("dual")).otherwise(F.col("high"))
        moved = state.join(sums, ["mix", "source"], "left").withColumns({"reached": F.col("done") | reached, "low": low, "high": high, "step": step})
        inside = F.col("step").between(F.col("low"), F.col("high"))
        dual = F.when(F.col("reached"), F.col("dual")).when(inside, F.col("step")).otherwise((F.col("low") + F.col("high")) / 2)
        state = cut(moved.withColumn("dual", dual).select(*known, "dual", "low", "high", F.col("reached").alias("done")))
        if state.where("not done").isEmpty():
            break
    solved = state.select("mix", "source", "mean", F.when(~F.col("full"), F.col("dual")).alias("dual"), F.col("done").alias("converged"))
    return goal_rows.join(solved, ["mix", "source"], "left")


def sized(documents: DataFrame, **options: str) -> DataFrame:
    """(doc_id, source, tokens) of the documents that have a source and at least one token."""
    return count_tokens(documents.where("source is not null"), ["doc_id", "source"], **options).where("tokens > 0")


def better_quota() -> Column:
    """The quota after the one move of its source (a copy more or less of one length, or none) that ends nearest the goal."""
    source = Window.partitionBy("mix", "source")
    left = F.col("goal") - F.sum(F.col("quota") * F.col("tokens")).over(source)
    room = F.col("cap").isNull() | (F.col("quota") < F.col("n") * F.col("cap"))
    more = F.when(room, F.struct(F.abs(left - F.col("tokens")).alias("error"), "tokens", "salt", F.lit(1).alias("move")))
    less = F.when(F.col("quota") > 0, F.struct(F.abs(left + F.col("tokens")).alias("error"), "tokens", "salt", F.lit(-1).alias("move")))
    best = F.min(F.least(more, less)).over(source)
    here = (best["error"] < F.abs(left)) & (best["tokens"] == F.col("tokens")) & (best["salt"] == F.col("salt"))
    return F.col("quota") + F.when(here, best["move"]).otherwise(0)


def mixed(documents: DataFrame, targets: DataFrame, total: float | None = None, **options: str) -> tuple[DataFrame, DataFrame]:
    """The copies (mix, doc_id, source, tokens, copies), copies > 0, and the report of shares.

    In order of length, copies are the steps of the rounded running sum of rates, so no document has more than its cap
    and the sum of any run of lengths is right to one copy; then single copies are added or taken where that ends nearer
    the goal. Documents of one length are ranked by a hash of doc_id, in runs of bounded size.

    Report: wanted and goal (what the caps allow of it), shortfall (their difference), the dual, least and most rates,
    and whether the dual converged."""
    docs = cut(sized(documents, **options))
    lengths = docs.groupBy("source", "tokens").agg(F.count("*").alias("all"))
    salted = docs.join(lengths, ["source", "tokens"]).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("all") / RUN))).drop("all")
    histogram = cut(salted.groupBy("source", "tokens", "salt").agg(F.count("*").alias("n")))
    supply = histogram.groupBy("source").agg(F.sum("n").alias("documents"), F.sum(F.col("n") * F.col("tokens")).alias("supply"))
    solved = cut(solve_duals(goals(targets, supply, total), histogram))

    order = Window.partitionBy("mix", "source").orderBy("tokens", "salt").rowsBetween(Window.unboundedPreceding, 0)
    cells = histogram.join(solved.where("goal is not null").select("mix", "source", "dual", "mean", "goal", F.col("cap").cast("double").alias("ceiling"), "cap"), "source")
    cells = cells.withColumn("rate", tilted(F.col("dual"), F.col("tokens"), F.col("mean"), F.col("ceiling")))
    upto = F.sum(F.col("n") * F.col("rate")).over(order)
    steps = F.floor(upto + 0.5) - F.floor(upto - F.col("n") * F.col("rate") + 0.5)
    cells = cells.withColumn("quota", F.when(F.col("cap").isNull(), steps).otherwise(F.least(steps, F.col("n") * F.col("cap"))))
    for _ in range(MOVES):
        cells = cells.withColumn("quota", better_quota())
    cells = cut(cells.select("mix", "source", "tokens", "salt", "rate", F.expr("quota div n").alias("each"), (F.col("quota") % F.col("n")).alias("extra")))
    rank = F.row_number().over(Window.partitionBy("source", "tokens", "salt").orderBy(F.xxhash64("doc_id", F.lit("rank")), "doc_id"))
    ranked = salted.withColumn("rank", rank)
    copies = (F.col("each") + (F.col("rank") <= F.col("extra")).cast("long")).alias("copies")
    out = ranked.join(cells.drop("rate"), ["source", "tokens", "salt"]).select("mix", "doc_id", "source", "tokens", copies).where("copies > 0")

    reached = out.groupBy("mix", "source").agg(
        F.count("*").alias("used_documents"), F.max("copies").alias("most_copies"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens")
    )
    rates = cells.groupBy("mix", "source").agg(F.min("rate").alias("least_rate"), F.max("rate").alias("most_rate"))
    report = solved.join(rates, ["mix", "source"], "left").join(reached, ["mix", "source"], "left").fillna(0, ["used_documents", "most_copies", "tokens"])
    shares = report.withColumn("share", F.try_divide(F.col("tokens"), F.sum("tokens").over(Window.partitionBy("mix")))).select(
        "mix", "source", "weight", F.col("cap").alias("max_repeats"), "target_share", "documents", F.col("supply").alias("source_tokens"), "wanted", "goal",
        (F.col("wanted") - F.col("goal")).alias("shortfall"), "dual", "converged", "least_rate", "most_rate", "used_documents", "most_copies", "tokens", "share",
    )
    return out, shares
