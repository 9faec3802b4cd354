"""Mixing sources to target weights by entropy balancing.

Document rates are as close to 1 as the token targets of the sources allow, in
relative entropy, and never above the cap.  The solution has the form
``min(cap, exp(lambda_source * size))``; the multipliers solve the convex dual
by distributed Newton steps.  All steps run on a histogram of sizes per source,
which is as large as the number of different sizes.  Rates then become whole
copies such that every block of a source comes out at its expected tokens.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webquarry.llm.common import ROW, dense_order, drop_table, whole_groups, with_row_id, word_count
from webquarry.session import durable

TOLERANCE = 1e-10
MAX_STEPS = 200


def source_targets(sources: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """``source, source_size, target``: shares by weight, stopped at ``cap`` times the size, the excess reshared.

    ``sources`` has ``source, source_size``.  Weights repeat along the sources in
    code-point order, null last.  Each round stops the sources that are above;
    their number only grows, so the rounds end.
    """
    ranks = dense_order(sources, "source", "rank")
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    rows = sources.join(ranks, sources["source"].eqNullSafe(ranks["source"])).select(
        sources["source"], "source_size", pick.alias("weight"), F.lit(False).alias("stopped")
    )
    rows = durable(rows)
    limit = F.col("source_size") * float(cap)
    while True:
        figures = rows.agg(
            F.sum("source_size").alias("all"),
            F.coalesce(F.sum(F.when(F.col("stopped"), limit)), F.lit(0.0)).alias("held"),
            F.coalesce(F.sum(F.when(~F.col("stopped"), F.col("weight"))), F.lit(0.0)).alias("weights"),
            F.count(F.when(F.col("stopped"), 1)).alias("n"),
        ).first()
        level = (float(figures["all"] or 0) - figures["held"]) / figures["weights"] if figures["weights"] else 0.0
        share = F.col("weight") * level
        after = durable(rows.withColumn("stopped", F.col("stopped") | (share > limit)))
        drop_table(rows)
        rows = after
        if rows.where("stopped").count() == figures["n"]:
            return rows.select("source", "source_size", F.when(F.col("stopped"), limit).otherwise(share).alias("target"))


def multipliers(histogram: DataFrame, targets: DataFrame, cap: float) -> DataFrame:
    """``source_no, tilt``; the tilt is null where every document takes the cap.

    ``histogram`` has ``source_no, size, n`` with positive sizes, ``targets`` has
    ``source_no, source_size, target``.  Newton steps on the logarithm of the
    taken tokens, kept inside a bracket that each step narrows, so a step that
    leaves it is halved instead.
    """
    least = histogram.groupBy("source_no").agg(F.min("size").alias("least"))
    open_ = targets.where((F.col("target") < cap * F.col("source_size")) & (F.col("target") > 0)).join(least, "source_no")
    aim = F.log(F.try_divide("target", "source_size"))
    rows = open_.select(
        "source_no",
        "target",
        F.lit(0.0).alias("tilt"),
        F.when(aim < 0, aim / F.col("least")).otherwise(0.0).alias("low"),
        F.when(aim < 0, 0.0).otherwise(F.lit(log(cap)) / F.col("least")).alias("high"),
        F.lit(1.0).alias("gap"),
    )
    state = durable(rows)
    for _ in range(MAX_STEPS):
        tilted = F.least(F.lit(float(cap)), F.exp(F.least(F.col("tilt") * F.col("size"), F.lit(log(cap) + 1))))
        words = F.col("size") * F.col("n") * tilted
        slope = F.when(tilted < cap, words * F.col("size")).otherwise(0.0)
        sums = histogram.join(state.select("source_no", "tilt"), "source_no").groupBy("source_no").agg(
            F.sum(words).alias("words"), F.sum(slope).alias("slope")
        )
        off = F.log(F.try_divide("words", "target"))
        low = F.when(off < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(off > 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - off * F.col("words") / F.when(F.col("slope") > 0, F.col("slope"))
        inside = (newton > low) & (newton < high)
        step = F.when(F.abs(off) < TOLERANCE, F.col("tilt")).when(inside, newton).otherwise((low + high) / 2)
        after = durable(
            state.join(sums, "source_no").select(
                "source_no", "target", step.alias("tilt"), low.alias("low"), high.alias("high"), F.abs(off).alias("gap")
            )
        )
        drop_table(state)
        state = after
        worst = state.agg(F.max(F.when(F.col("high") - F.col("low") > 1e-15 * F.abs(F.col("high")), F.col("gap")))).first()[0]
        if worst is None or worst < TOLERANCE:
            break
    return targets.select("source_no").join(state.select("source_no", "tilt"), "source_no", "left")


def _round_block(block: pd.DataFrame, cap: int) -> np.ndarray:
    """Whole copies of one block, each rate rounded up or down so as to make up for what is off so far.

    Large documents come first, so what is off in the end is about one small document.
    """
    sizes = block["size"].to_numpy(float)
    rates = block["rate"].to_numpy(float)
    copies = np.zeros(len(block), np.int64)
    owed = 0.0
    for at, size, rate in zip(range(len(block)), sizes.tolist(), rates.tolist(), strict=True):
        owed += size * rate
        if size > 0:
            low = int(rate)
            want = int(round(owed / size)) if owed > 0 else 0
            copies[at] = min(max(want, low), low + (rate > low), cap)
            owed -= copies[at] * size
    return copies


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    cap: int = 3,
    block_rows: int = 4096,
) -> DataFrame:
    """``id, size, source, source_size, target, rate, copies, taken`` and the row id of every row.

    ``size`` counts words; null and empty texts have none and take no copy.  A
    null source is a source of its own, the last.  ``taken`` is ``copies * size``,
    never above ``cap * size``.  Rounding goes through blocks of about
    ``block_rows`` rows of one source in an order fixed by size and id, so runs
    agree; rows stay apart whatever their id.  An empty
    table gives an empty result, and other columns are not read.
    """
    rows = with_row_id(docs).select(
        F.col(id_col).cast("long").alias("id"),
        F.col(source_col).cast("string").alias("source"),
        word_count(text_col).alias("size"),
        *ROW,
    )
    rows = durable(rows)
    histogram = durable(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
    sources = histogram.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("source_rows")
    )
    sources = durable(sources.withColumn("source_no", F.monotonically_increasing_id()))
    targets = source_targets(sources.select("source", "source_size"), weights, cap)
    targets = sources.join(targets.select(F.col("source").alias("s"), "target"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    targets = durable(targets)
    numbered = histogram.join(targets.select("source", "source_no"), histogram["source"].eqNullSafe(targets["source"]))
    tilts = multipliers(durable(numbered.where("size > 0").select("source_no", "size", "n")), targets, cap)
    goals = durable(targets.join(tilts, "source_no"))
    rate = F.when(F.col("size") == 0, 0.0).when(F.col("tilt").isNull(), F.lit(float(cap))).otherwise(
        F.least(F.lit(float(cap)), F.exp(F.least(F.col("tilt") * F.col("size"), F.lit(log(cap) + 1))))
    )
    pairs = rows.withColumnRenamed("source", "own").join(goals, F.col("own").eqNullSafe(F.col("source"))).drop("own")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("source_rows") / block_rows))
    # The id decides the block where there is one, so the same documents give the same mix from any folder.
    spread = F.when(F.col("id").isNull(), F.xxhash64(*ROW)).otherwise(F.xxhash64("id", "size"))
    placed = pairs.withColumn("rate", F.round(rate, 9)).withColumn("block", F.pmod(spread, blocks))
    keys = ["source_no", "block"]

    def rounded(batches):
        for batch in whole_groups(batches, keys):
            copies = [_round_block(block, cap) for _, block in batch.groupby(keys, sort=False)]
            yield batch.assign(copies=np.concatenate(copies)).drop(columns=keys)

    given = f"id long, size long, {', '.join(f'`{c}` long' for c in ROW)}, source string, source_size long, target double, rate double"
    columns = ["id", "size", *ROW, "source", "source_size", "target", "rate"]
    ordered = placed.select(*columns, *keys).repartition(*keys).sortWithinPartitions(*keys, F.desc("size"), "id", *ROW)
    out = ordered.mapInPandas(rounded, f"{given}, copies long")
    return out.withColumn("taken", F.col("copies") * F.col("size"))
