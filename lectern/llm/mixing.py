"""Mixing sources to target weights by pivotal dependent rounding of copy counts."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ranks import global_places
from .work import as_text, stored

#: Documents, or residuals, that one rounding group holds on average.
BLOCK = 2048
WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3


def targets(sizes: list[int], weights: list[float], most: float = MOST_COPIES) -> list[float]:
    """Shares the sum of sizes by weight; none gets more than `most` times its size, and what is over is shared again by weight."""
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        total = sum(weights[k] for k in open_)
        over = [k for k in open_ if left * weights[k] / total > most * sizes[k]]
        if not over:
            for k in open_:
                out[k] = left * weights[k] / total
            break
        for k in over:
            out[k] = float(most * sizes[k])
        open_ -= set(over)
        left -= sum(out[k] for k in over)
    return out


def source_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """sources (source, source_size, …) with target: targets() over a table, of which only sums come to the driver.

    Weights go round in order of code points, null last. Each pass closes the sources whose share at the present rate is over their
    limit, and the rate of the others grows; passes end when none is closed any more.
    """
    named = sources.withColumn("last", F.col("source").isNull()).withColumn("name", F.coalesce("source", F.lit("")))
    placed = global_places(named, ["last", "name"])
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = stored(placed.withColumn("w", F.element_at(cycle, (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))), "sources")
    limit = most * F.col("source_size")
    whole = weighed.agg(F.sum("source_size")).first()[0] or 0
    rate, closed = 0.0, -1
    while True:
        over = F.col("w") * rate > limit if closed >= 0 else F.lit(False)
        now = weighed.agg(F.count_if(over).alias("n"), F.sum(F.when(over, limit)).alias("given"), F.sum(F.when(~over, F.col("w"))).alias("open")).first()
        if now["n"] == closed or not now["open"]:
            break
        closed, rate = now["n"], (whole - (now["given"] or 0)) / now["open"]
    return weighed.withColumn("target", F.least(F.col("w") * rate, limit.cast("double"))).drop("last", "name", "place", "w")


def _pivot(group: pd.DataFrame) -> pd.DataFrame:
    """Rounds a group's probabilities but one. Two documents trade mass (probability times size) until one is 0 or 1; the other goes on.

    The direction is drawn so that both expectations stay as they are, and the sum of mass stays exactly, so all rounding together
    misses the target by less than one document.
    """
    group = group.sort_values(["draw", "size"], kind="stable").reset_index(drop=True)
    p, size, draw = group["p"].tolist(), group["size"].tolist(), group["draw"].tolist()
    held = -1
    for k in range(len(p)):
        if p[k] in (0.0, 1.0):
            continue
        if held < 0:
            held = k
            continue
        x, y = held, k
        up, down = min((1 - p[x]) * size[x], p[y] * size[y]), min(p[x] * size[x], (1 - p[y]) * size[y])
        if draw[k] * (up + down) < down:  # x gains from y
            full, gone = (1 - p[x]) * size[x] <= p[y] * size[y], p[y] * size[y] <= (1 - p[x]) * size[x]
            p[x], p[y] = (1.0 if full else p[x] + up / size[x]), (0.0 if gone else p[y] - up / size[y])
        else:
            gone, full = p[x] * size[x] <= (1 - p[y]) * size[y], (1 - p[y]) * size[y] <= p[x] * size[x]
            p[x], p[y] = (0.0 if gone else p[x] - down / size[x]), (1.0 if full else p[y] + down / size[y])
        open_ = [z for z in (x, y) if 0.0 < p[z] < 1.0]
        held = open_[0] if open_ else -1
    group["p"] = p
    return group


def word_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, tie): size counts runs of anything but the six ASCII blanks, tie is a hash of the text."""
    text = as_text(F.col("text"))
    size = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64(text).alias("tie"))


def mix_sources(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = 11) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) from (doc_id, source, size, tie), one row per input row.

    Sources in order of code points, null last, take the weights in turn. A source's copy rate is its target over its size; each
    document gets the whole part, and the fraction is rounded by pivotal steps in hashed blocks of bounded size. Each block leaves at
    most one fractional document; these meet in blocks again until one is left for a source, which a last draw decides. Draws and
    blocks hash the id, the text's hash and, for rows that repeat both, their number, so reruns agree and neither null ids nor one id
    of many rows crowd a block. Empty documents take nothing; a source without words has target 0. Sources are a table like any
    other: there may be as many as there are hosts.
    """
    same = ["doc_id", "source", "size", "tie"]
    counted = sizes.groupBy(*same).agg(F.count("*").alias("times"))
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    table = source_targets(totals, weights, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    table = table.select(F.col("source").alias("source_"), "source_size", "target", rate.alias("rate"), F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK)).alias("blocks"))
    most_blocks = table.agg(F.max("blocks")).first()[0] or 1
    key = lambda *more: F.xxhash64("doc_id", "tie", "nth", F.lit(seed), *more)
    draw = lambda level: F.shiftrightunsigned(key(F.lit(level)), 11) / F.lit(float(2**53))
    single = counted.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("times"))))
    rows = single.join(table, F.col("source").eqNullSafe(F.col("source_"))).drop("source_")
    whole = F.floor("rate")
    rows = rows.select("doc_id", "source", "size", "source_size", "target", "tie", "nth", whole.cast("long").alias("whole"), F.when(F.col("size") > 0, F.col("rate") - whole).otherwise(0.0).alias("p"), "blocks")
    rows = rows.withColumn("draw", draw(0)).withColumn("block", F.pmod(key(), "blocks"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    done, level = None, 0
    while True:
        level += 1
        rounded = stored(rows.groupBy("source", "block").applyInPandas(_pivot, schema), f"rounded-{level}")
        settled = rounded.filter("p in (0, 1)")
        done = settled if done is None else done.unionByName(settled)
        rows = rounded.filter("p not in (0, 1)").withColumn("draw", draw(level))
        if most_blocks == 1:
            break
        most_blocks = math.ceil(most_blocks / BLOCK)
        rows = rows.withColumn("block", F.floor(F.col("block") / BLOCK))
    last = rows.withColumn("p", F.when(F.col("draw") < F.col("p"), 1.0).otherwise(0.0))
    copies = F.col("whole") + F.when(F.col("size") > 0, F.col("p")).otherwise(0).cast("long")
    out = done.unionByName(last).withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(0))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """mix_sources over documents; sizes are counted once and kept."""
    return mix_sources(stored(word_sizes(docs), "sizes"), **options)
