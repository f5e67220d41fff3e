"""Mixing sources to target weights by entropy balancing.

Sources share ``share`` times all words by weight; no source takes more than ``most`` times
its own words, and what that leaves is reshared by weight. Given the targets T, the rates r
of the documents of a source minimise sum r ln r - r + 1 under sum r * size = T and
r <= most. The solution is an exponential tilt r = min(most, exp(lambda * size / mean size));
lambda, the dual variable of the token constraint, is found by Newton steps that keep to a
bracket. Every step aggregates a histogram (source, size) over the cluster: rates depend on
nothing else, and it grows with the distinct sizes and not with the documents.

Rates become whole copies from large sizes to small ones, each size taking up the rounding
error of those before it, so a source ends within about one small document of its target.
Which documents of one source and size get an extra copy is settled by a hash of the id and
the text (and of the columns carried along), in sub-cells that keep every window bounded
however many documents share a size. Only rows that agree in all of these are interchangeable.

Defined cases: a null text has size 0; documents of size 0 have rate 1 (one copy, no words);
null is a source of its own, ordered last; rows that repeat count and are dealt each; with
no words at all all targets are 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import materialise

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
PER_CELL = 20_000
STEPS, TOLERANCE = 60, 1e-9
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, rank, source_size, target), one row a source."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*(F.lit(w) for w in weights))
    ranked = totals.withColumn("rank", F.row_number().over(by_name).cast("long"))
    ranked = ranked.withColumn("weight", F.element_at(cycle, (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))).withColumn("cap", F.col("source_size") * most)
    whole = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    past = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    level = (F.sum("source_size").over(whole) * share - past("cap")) / (F.sum("weight").over(whole) - past("weight"))
    leveled = ranked.withColumn("level", level).withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    final = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(whole)["level"]
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("final"))
    return leveled.withColumn("final", final).select("source", "rank", "source_size", target.alias("target"), "full")


def tilts(spark: SparkSession, histogram: DataFrame, targets: DataFrame, most: int = MOST) -> DataFrame:
    """(rank, tilt) of the sources below their cap: lambda by bracketed Newton steps."""
    facts = histogram.groupBy("rank").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean"), F.min("size").alias("least"))
    state = targets.where("not full and source_size > 0 and target > 0").join(facts, "rank")
    start, x_min = F.log(F.col("target") / F.col("source_size")), F.col("least") / F.col("mean")
    state = state.select("rank", "target", "mean", F.least(F.lit(0.0), start / x_min).alias("lo"), F.lit(float(np.log(most)) + 1e-12).__truediv__(x_min).alias("hi"), start.alias("tilt"))
    state = materialise(spark, state, "tilts")
    for _ in range(STEPS):
        x = F.col("size") / F.col("mean")
        e = F.exp(F.least(F.col("tilt") * x, F.lit(float(np.log(most)))))
        words = F.col("n") * F.col("size")
        sums = histogram.join(state, "rank").groupBy("rank").agg(F.sum(words * e).alias("got"), F.sum(F.when(F.col("tilt") * x < float(np.log(most)), words * e * x).otherwise(0.0)).alias("slope"))
        gap = F.col("got") - F.col("target")
        lo, hi = F.when(gap <= 0, F.col("tilt")).otherwise(F.col("lo")), F.when(gap >= 0, F.col("tilt")).otherwise(F.col("hi"))
        after = state.join(sums, "rank").withColumn("gap", gap).withColumn("lo", lo).withColumn("hi", hi)
        newton = F.col("tilt") - F.try_divide(F.col("gap"), F.col("slope"))
        step = F.when((newton > F.col("lo")) & (newton < F.col("hi")), newton).otherwise((F.col("lo") + F.col("hi")) / 2)
        after = materialise(spark, after.select("rank", "target", "mean", "lo", "hi", F.when(F.abs("gap") > TOLERANCE * F.col("target"), step).otherwise(F.col("tilt")).alias("tilt"), (F.abs("gap") / F.col("target")).alias("off")), "tilts")
        state = after.drop("off")
        if (after.agg(F.max("off")).first()[0] or 0) <= TOLERANCE:
            break
    return state.select("rank", F.round("tilt", 10).alias("tilt"), "mean")


def _round_task(most: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """From large sizes to small: copies of all documents of a size, with the words still owed."""
        pdf = pdf.sort_values("size", ascending=False, kind="stable")
        owed, out = 0.0, []
        for n, size, tilt, mean, full in zip(pdf["n"], pdf["size"], pdf["tilt"], pdf["mean"], pdf["full"], strict=True):
            rate = float(most) if full else (0.0 if np.isnan(tilt) else min(float(most), float(np.exp(min(tilt * size / mean, 50.0)))))
            m = min(max(int(np.floor(n * rate + owed / size + 0.5)), 0), most * n)
            owed += (n * rate - m) * size
            out.append(m)
        return pdf.assign(m=np.array(out, dtype=np.int64))[["rank", "size", "m"]]

    return run


def mix_sources(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, ``size``, ``source_size``, ``target``, ``copies`` and ``taken``, one row for each row of ``docs``; ``keep`` names columns to carry along."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    carried = [F.col(c).alias(f"kept_{c}") for c in keep]
    sizes = materialise(spark, docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), F.xxhash64(text_col, *keep).alias("mark"), *carried), "sizes")
    targets = materialise(spark, source_targets(sizes, weights, share, most), "targets")
    names = targets.select(F.col("source").alias("name"), "rank", "source_size", "target")
    rows = sizes.join(names, sizes["source"].eqNullSafe(names["name"])).drop("name", "source")
    subs = max(1, sizes.count() // PER_CELL)
    rows = rows.withColumn("sub", F.pmod(F.xxhash64("id", "mark"), F.lit(subs)))
    cells = materialise(spark, rows.where("size > 0").groupBy("rank", "size", "sub").agg(F.count("*").alias("in_sub")), "cells")
    histogram = materialise(spark, cells.groupBy("rank", "size").agg(F.sum("in_sub").alias("n")), "histogram")
    found = tilts(spark, histogram, targets, most)
    whole = histogram.join(targets.select("rank", "full"), "rank").join(found, "rank", "left")
    copies = whole.groupBy("rank").applyInPandas(_round_task(most), "rank long, size long, m long")
    w = Window.partitionBy("rank", "size")
    upto = F.sum("in_sub").over(w.orderBy("sub").rowsBetween(Window.unboundedPreceding, 0))
    split = cells.withColumn("upto", upto).withColumn("all", F.sum("in_sub").over(w)).join(copies, ["rank", "size"])
    part = lambda c: F.expr(f"m * ({c}) div all")
    split = split.select("rank", "size", "sub", "in_sub", (part("upto") - part("upto - in_sub")).alias("m"))
    place = F.row_number().over(Window.partitionBy("rank", "size", "sub").orderBy(F.xxhash64("id", F.lit(1)), "id", "mark"))
    dealt = rows.where("size > 0").withColumn("place", place).join(split, ["rank", "size", "sub"])
    dealt = dealt.withColumn("copies", F.expr("m div in_sub + if(place <= m % in_sub, 1, 0)")).drop("place", "in_sub", "m")
    out = dealt.unionByName(rows.where("size = 0").withColumn("copies", F.lit(1).cast("long")))
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", F.col("copies").cast("long").alias("copies"), (F.col("copies") * F.col("size")).cast("long").alias("taken"), *(F.col(f"kept_{c}") for c in keep))


def op9_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    return mix_sources(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", "copies")
