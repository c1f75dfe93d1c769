"""Clustering metrics as closed forms over the contingency table of key and response.

Inputs are ``key(block, mention, chain)`` and ``response(block, mention,
chain)``; a block is a document or any other unit whose numerators and
denominators are summed.  Chains are sets of mentions: repeated rows count once
(a mention repeated in several response chains keeps its first).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..storage import Scratch
from .assignment import best_cells

MOST_REPEATS = 10


def dedupe_response(response: DataFrame, order: str = "pos") -> DataFrame:
    """Each mention once per block, in its first chain (by ``order``, then chain)."""
    keys = [F.col(order)] if order in response.columns else []
    first = Window.partitionBy("block", "mention").orderBy(*keys, "chain")
    return response.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")


def repeats(response: DataFrame, most: int = MOST_REPEATS) -> DataFrame:
    """Count of repeated mentions per block; raises where there are more than ``most``."""
    n = response.groupBy("block").agg((F.count(F.lit(1)) - F.countDistinct("mention")).alias("n_repeats"))
    bad = F.raise_error(F.concat(F.lit("too many repeated mentions in "), F.col("block").cast("string")))
    return n.withColumn("n_repeats", F.when(F.col("n_repeats") > most, bad.cast("long")).otherwise(F.col("n_repeats")))


def contingency(key: DataFrame, response: DataFrame) -> DataFrame:
    """``block, k, r, n``: sizes of the intersections of key and response chains."""
    k = key.select("block", "mention", F.col("chain").alias("k")).distinct()
    r = response.select("block", "mention", F.col("chain").alias("r")).distinct()
    return k.join(r, ["block", "mention"]).groupBy("block", "k", "r").agg(F.count(F.lit(1)).alias("n"))


def _sizes(side: DataFrame, name: str, size: str) -> DataFrame:
    return side.select("block", "mention", F.col("chain").alias(name)).distinct().groupBy("block", name).agg(F.count(F.lit(1)).alias(size))


def _c2(x: str | Column) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return (x * (x - 1) / 2).cast("double")


def numerators(key: DataFrame, response: DataFrame) -> DataFrame:
    """Recall and precision numerators and denominators of MUC, B-cubed and BLANC, and the chain totals, per block."""
    table = contingency(key, response)
    ks, rs = _sizes(key, "k", "sk"), _sizes(response, "r", "sr")
    cells = table.join(ks, ["block", "k"]).join(rs, ["block", "r"])
    inner = cells.groupBy("block").agg(
        F.sum(F.col("n") - 1).cast("double").alias("muc_num"), F.sum(F.col("n") ** 2 / F.col("sk")).alias("b3_rnum"),
        F.sum(F.col("n") ** 2 / F.col("sr")).alias("b3_pnum"), F.sum(_c2("n")).alias("c2_n"), F.sum("n").cast("double").alias("common"),
    )
    common_k = table.groupBy("block", "k").agg(F.sum("n").alias("n")).groupBy("block").agg(F.sum(_c2("n")).alias("c2_k_common"))
    common_r = table.groupBy("block", "r").agg(F.sum("n").alias("n")).groupBy("block").agg(F.sum(_c2("n")).alias("c2_r_common"))
    side = lambda t, s, p: t.groupBy("block").agg(
        F.sum(s).cast("double").alias(f"{p}_mentions"), F.count(F.lit(1)).cast("double").alias(f"{p}_chains"),
        F.sum(F.col(s) - 1).cast("double").alias(f"{p}_links"), F.sum(_c2(s)).alias(f"c2_{p}"),
    )
    out = side(ks, "sk", "key").join(side(rs, "sr", "resp"), "block", "full")
    for part in (inner, common_k, common_r):
        out = out.join(part, "block", "left")
    return out.fillna(0.0)


def _prf(name: str, rn: Column, rd: Column, pn: Column, pd_: Column) -> list[Column]:
    r, p = (F.coalesce(F.try_divide(a, b), F.lit(0.0)) for a, b in ((rn, rd), (pn, pd_)))
    return [r.alias(f"{name}_r"), p.alias(f"{name}_p"), F.coalesce(F.try_divide(2 * r * p, r + p), F.lit(0.0)).alias(f"{name}_f")]


def cluster_scores(key: DataFrame, response: DataFrame, by: list[str] = (), blocks: DataFrame | None = None, ceaf: bool = True) -> DataFrame:
    """Recall, precision and F of every metric, and the CoNLL mean; numerators are summed over the blocks of a group.

    ``blocks`` maps block to the ``by`` columns where there are any.
    """
    response = dedupe_response(response)
    rows = numerators(key, response)
    if ceaf:
        rows = rows.join(ceaf_sums(key, response), "block", "left").fillna(0.0)
    if by:
        rows = rows.join(blocks, "block")
    sums = rows.groupBy(*by).agg(*[F.sum(c).alias(c) for c in rows.columns if c != "block" and c not in by])
    c = F.col
    non_n = c("common") * (c("common") - 1) / 2 - c("c2_k_common") - c("c2_r_common") + c("c2_n")
    # over several blocks the link counts are sums, so they are kept per block before summing
    per = rows.withColumn("non_n", non_n).withColumn("non_k", _c2("key_mentions") - c("c2_key")).withColumn("non_r", _c2("resp_mentions") - c("c2_resp"))
    links = per.groupBy(*by).agg(F.sum("non_n").alias("non_n"), F.sum("non_k").alias("non_k"), F.sum("non_r").alias("non_r"))
    sums = sums.join(links, list(by)) if by else sums.crossJoin(links)  # without groups each side is one row
    cols = [
        *by, *_prf("ident", c("common"), c("key_mentions"), c("common"), c("resp_mentions")),
        *_prf("muc", c("muc_num"), c("key_links"), c("muc_num"), c("resp_links")),
        *_prf("b3", c("b3_rnum"), c("key_mentions"), c("b3_pnum"), c("resp_mentions")),
        *_prf("bc", c("c2_n"), c("c2_key"), c("c2_n"), c("c2_resp")), *_prf("bn", c("non_n"), c("non_k"), c("non_n"), c("non_r")),
        c("c2_key").alias("_ck"), c("non_k").alias("_nk"),
    ]
    if ceaf:
        cols += _prf("ceafm", c("ceafm_num"), c("key_mentions"), c("ceafm_num"), c("resp_mentions"))
        cols += _prf("ceafe", c("ceafe_num"), c("key_chains"), c("ceafe_num"), c("resp_chains"))
    out = sums.select(*cols)
    for x in "rpf":
        both = (c(f"bc_{x}") + c(f"bn_{x}")) / 2
        out = out.withColumn(f"blanc_{x}", F.when(c("_ck") == 0, c(f"bn_{x}")).when(c("_nk") == 0, c(f"bc_{x}")).otherwise(both))
    out = out.drop("_ck", "_nk", *[f"{p}_{x}" for p in ("bc", "bn") for x in "rpf"])
    return out.withColumn("conll_f", (c("muc_f") + c("b3_f") + c("ceafe_f")) / 3) if ceaf else out


def ceaf_sums(key: DataFrame, response: DataFrame) -> DataFrame:
    """Largest one-to-one assignment of chains per block, by mentions and by entities.

    The overlap graph of a block falls into components.  Where one side of a
    component is a single chain, its best cell is the answer.  The others are
    solved on their cells alone, many components to a task.
    """
    from .graph import connected_components

    table = contingency(key, response)
    cells = table.join(_sizes(key, "k", "sk"), ["block", "k"]).join(_sizes(response, "r", "sr"), ["block", "r"])
    # nodes by hash: where two meet, components are solved together, which gives the same sums
    node = lambda side, col: F.xxhash64(F.lit(side), "block", col)
    cells = cells.select("block", node("k", "k").alias("u"), node("r", "r").alias("v"), "n", (2.0 * F.col("n") / (F.col("sk") + F.col("sr"))).alias("phi"))
    cells = Scratch(key.sparkSession, "ceaf").table(cells, "cells")
    comp = connected_components(cells, "u", "v").withColumnRenamed("node", "u")
    placed = cells.join(comp, "u")
    shape = placed.groupBy("block", "component").agg(
        F.min("u").alias("u0"), F.max("u").alias("u1"), F.min("v").alias("v0"), F.max("v").alias("v1"), F.max("n").cast("double").alias("ceafm_num"), F.max("phi").alias("ceafe_num")
    )
    star = (F.col("u0") == F.col("u1")) | (F.col("v0") == F.col("v1"))
    easy = shape.where(star).select("block", "ceafm_num", "ceafe_num")
    hard = placed.join(shape.where(~star).select("block", "component"), ["block", "component"])

    def solve(t: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (block, _), own in t.groupby(["block", "component"], sort=False):
            u, v = pd.factorize(own.u)[0], pd.factorize(own.v)[0]
            out.append((block, *(best_cells(u, v, own[c].to_numpy(float)) for c in ("n", "phi"))))
        return pd.DataFrame(out, columns=["block", "ceafm_num", "ceafe_num"])

    kind = dict(key.dtypes)["block"]
    tasks = 4 * int(key.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = hard.withColumn("task", F.pmod(F.xxhash64("component"), F.lit(tasks)))
    solved = dealt.groupBy("task").applyInPandas(solve, f"block {kind}, ceafm_num double, ceafe_num double")
    return easy.unionByName(solved).groupBy("block").agg(F.sum("ceafm_num").alias("ceafm_num"), F.sum("ceafe_num").alias("ceafe_num"))


def mention_identification(key: DataFrame, response: DataFrame) -> DataFrame:
    """Key and response mentions side by side: ``block, mention, k, r`` (null where the other side lacks it)."""
    k = key.select("block", "mention", F.col("chain").alias("k")).distinct()
    r = dedupe_response(response).select("block", "mention", F.col("chain").alias("r"))
    return k.join(r, ["block", "mention"], "full")


def truncated_percent(x: str) -> Column:
    """A share as a percentage cut, not rounded, to two places."""
    return F.floor(F.col(x) * 10000) / 100
