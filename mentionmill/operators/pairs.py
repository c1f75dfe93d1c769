"""Candidate mention pairs: blocked self-joins, windows, scopes and labels.

Every pair operator is an equi-join on its block (document, topic or window)
with a residual order condition, so Spark hashes or sorts on the block and AQE
can split a hot one.  Mentions carry the columns of the caller; those of the
first mention come out with prefix ``m1_``, of the second with ``m2_``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F


def _sides(mentions: DataFrame, block: list[str]) -> tuple[DataFrame, DataFrame]:
    names = [c for c in mentions.columns if c not in block]
    one = mentions.select(*block, *[F.col(c).alias(f"m1_{c}") for c in names])
    two = mentions.select(*block, *[F.col(c).alias(f"m2_{c}") for c in names])
    return one, two


def with_position(mentions: DataFrame, block: str | list[str], order: list[str]) -> DataFrame:
    """``pos``: the mention's place in its block (sentence, entities before events, source order)."""
    block = [block] if isinstance(block, str) else block
    return mentions.withColumn("pos", F.row_number().over(Window.partitionBy(*block).orderBy(*order)))


def with_sentence_ordinal(mentions: DataFrame, sentences: DataFrame, doc: str = "doc_id", sent: str = "sent_id") -> DataFrame:
    """``ord``: rank of the mention's sentence among all sentences of its document, mentions or not."""
    ranked = sentences.select(doc, sent).distinct().withColumn("ord", F.dense_rank().over(Window.partitionBy(doc).orderBy(sent)))
    return mentions.join(ranked, [doc, sent])


#: Mentions of a block that meet as many others in one step: of ``within_block`` and of ``similar_pairs``.
STRIPE = TILE = 1024
#: Pairs that a task makes on average at most.
TASK_PAIRS = 1 << 21


def _sized(mentions: DataFrame, block: list[str], size: int) -> DataFrame:
    """The mentions, with ``_n``: in how many parts of about ``size`` rows the block is cut."""
    return mentions.join(mentions.groupBy(*block).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("_n")), block)


def _part(pos: str) -> Column:
    return F.pmod(F.xxhash64(pos), F.col("_n")).cast("int")


def _tasks(df: DataFrame) -> int:
    """The session's shuffle partitions: pairs are many more bytes than the mentions they are made of, so these are not coalesced."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def tasks_of_pairs(mentions: DataFrame, block: str | list[str], least: int | None = None) -> int:
    """So many tasks that each makes about ``TASK_PAIRS`` pairs of a block at most: pairs grow with the square of a block, the session's partitions do not.

    ``least``: at least so many; the session's partitions, if not given.
    """
    block = [block] if isinstance(block, str) else block
    n = F.count(F.lit(1)).cast("double")
    found = mentions.dropna(subset=block).groupBy(*block).agg((n * n / 2).alias("_n")).agg(F.sum("_n")).first()[0]
    return max(_tasks(mentions) if least is None else least, math.ceil((found or 0) / TASK_PAIRS))


def within_block(mentions: DataFrame, block: str | list[str], pos: str = "pos", tile: str | None = None) -> DataFrame:
    """All pairs of a block with the first mention before the second (within-document, cross-document).

    A block is cut in parts of about ``STRIPE`` mentions; two parts that meet are a
    tile, and tiles are dealt to as many tasks as their pairs ask for, so a larger
    block is more tasks and no longer ones.  ``tile``: keep the tile's two parts as
    a column of that name.  All rows of a pair have the same tile, and rows of one
    block and tile lie in one partition.
    """
    block = [block] if isinstance(block, str) else block
    one, two = _sides(_sized(mentions, block, STRIPE), [*block, "_n"])
    n = tasks_of_pairs(mentions, block)
    parts = F.sequence(F.lit(0), F.col("_n") - 1)
    at = lambda k, x: (F.lit(1 << 32) * k + x).alias("_tile")
    one = one.withColumn("_s", F.explode(parts)).select(*block, at(_part(f"m1_{pos}"), F.col("_s")), *[c for c in one.columns if c not in (*block, "_n")])
    two = two.withColumn("_s", F.explode(parts)).select(*block, at(F.col("_s"), _part(f"m2_{pos}")), *[c for c in two.columns if c not in (*block, "_n")])
    one, two = (side.repartition(n, *block, "_tile") for side in (one, two))
    out = one.join(two, [*block, "_tile"]).where(F.col(f"m1_{pos}") < F.col(f"m2_{pos}"))
    return out.withColumnRenamed("_tile", tile) if tile else out.drop("_tile")


def _matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of doubles, and their lengths; -1 for one that is null or holds a null."""
    rows = column.to_pylist() if column.null_count or pc.list_flatten(column).null_count else None
    if rows is None:
        sizes = pc.list_value_length(column).to_numpy().astype(np.int64)
        if len(sizes) and (sizes == sizes[0]).all():
            return pc.list_flatten(column).to_numpy().astype(np.float64).reshape(len(sizes), sizes[0]), sizes
        rows = column.to_pylist()
    sizes = np.array([-1 if r is None or None in r else len(r) for r in rows], np.int64)
    out = np.zeros((len(rows), max(0, sizes.max(initial=0))))
    for i, r in enumerate(rows):
        if sizes[i] > 0:
            out[i, : sizes[i]] = r
    return out, sizes


def _similarities(x: pa.ChunkedArray, y: pa.ChunkedArray) -> np.ndarray:
    """``vectors.similarity`` of all vectors of two columns: 0 where a vector is null, without length or of another size."""
    (a, m), (b, n) = _matrix(x), _matrix(y)
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(v, ((0, 0), (0, width - v.shape[1]))) for v in (a, b))
    with np.errstate(all="ignore"):
        norms = np.sqrt((a * a).sum(1))[:, None] * np.sqrt((b * b).sum(1))
        out = np.maximum(0.0, a @ b.T / norms) * 100
    out[(norms == 0) | (m[:, None] != n) | (m[:, None] < 0)] = 0.0
    return out


def similar_pairs(mentions: DataFrame, block: str, pos: str = "pos", vector: str = "vector", least: float | None = None, fold=None, schema: str | None = None) -> DataFrame:
    """The pairs of ``within_block`` with the ``similarity`` of their vectors (0 to 100) in the vectors' place.

    A block is cut in tiles of about ``TILE`` mentions; two tiles that meet are one
    matrix product.  ``least``: only pairs of at least that similarity.  ``fold``: makes
    an Arrow table of ``schema`` of the pairs of two tiles, which then are no rows.
    """
    names = [c for c in mentions.columns if c not in (block, vector)]
    kinds = dict(mentions.dtypes)
    pairs_ddl = ", ".join([f"`{block}` {kinds[block]}", *(f"`m{k}_{c}` {kinds[c]}" for k in (1, 2) for c in names), "similarity double"])

    def meet(t: pa.Table) -> pa.Table:
        out = [found for _, found in tile_pairs(t, block, pos, vector, least)]
        return pa.concat_tables([fold(found) if fold else found for found in out])

    rows = dealt_in_tiles(mentions, block, pos)
    return rows.repartition(tasks_of_pairs(mentions, block), block, "_i", "_j").groupBy(block, "_i", "_j").applyInArrow(meet, schema or pairs_ddl)


def dealt_in_tiles(mentions: DataFrame, block: str, pos: str = "pos") -> DataFrame:
    """The mentions with their part ``_t`` of the block, once for each two parts ``_i, _j`` that meet in a tile."""
    rows = _sized(mentions.where(F.col(pos).isNotNull()), [block], TILE).withColumn("_t", _part(pos))
    rows = rows.withColumn("_x", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return rows.withColumn("_i", F.least("_t", "_x")).withColumn("_j", F.greatest("_t", "_x")).drop("_x", "_n")


def tile_pairs(t: pa.Table, block: str, pos: str = "pos", vector: str | None = None, least: float | None = None):
    """The pairs of a tile's mentions: those whose first mention is in part ``_i`` (False), then, of two parts, those whose first one is in ``_j`` (True)."""
    i, j = t["_i"][0].as_py(), t["_j"][0].as_py()
    names = [c for c in t.column_names if c not in (block, vector, "_t", "_i", "_j")]
    one, two = (t.filter(pc.equal(t["_t"], k)) for k in (i, j))
    score = _similarities(one[vector], two[vector]) if vector else None
    p, q = one[pos].to_numpy(), two[pos].to_numpy()
    one, two = (side.select([block, *names]) for side in (one, two))  # a vector is not copied for each of its pairs
    wanted = True if least is None else score >= least
    for turned in (False, True) if i != j else (False,):
        a, b = np.nonzero(((p[:, None] > q) if turned else (p[:, None] < q)) & wanted)
        s = [pa.array(score[a, b])] if vector else []
        (x, a), (y, b) = ((two, b), (one, a)) if turned else ((one, a), (two, b))
        x, y = x.take(pa.array(a)), y.take(pa.array(b))
        columns = [x[block], *(x[c] for c in names), *(y[c] for c in names), *s]
        yield turned, pa.table(columns, names=[block, *(f"m{k}_{c}" for k in (1, 2) for c in names), *(["similarity"] if vector else [])])


def adjacent_sentences(mentions: DataFrame, block: str | list[str] = "doc_id", pos: str = "pos", ordinal: str = "ord") -> DataFrame:
    """Pairs in one sentence or in two that follow each other; ``pos`` follows the sentences.

    The first mention of a pair meets the second by sentence: its own and the
    next one, so no pair of sentences further apart is made.  With ``selected``
    among the columns, pairs that touch an unselected sentence are left out: it
    also breaks the carry of the sentence before.
    """
    block = [block] if isinstance(block, str) else block
    if "selected" in mentions.columns:
        mentions = mentions.where("selected")
    one, two = _sides(mentions, block)
    one = one.withColumn("_at", F.explode(F.array(F.col(f"m1_{ordinal}"), F.col(f"m1_{ordinal}") + 1)))
    return one.join(two.withColumn("_at", F.col(f"m2_{ordinal}")), [*block, "_at"]).where(F.col(f"m1_{pos}") < F.col(f"m2_{pos}")).drop("_at")


def sliding_window(mentions: DataFrame, sentences: DataFrame, size: int = 2, doc: str = "doc_id", sent: str = "sent_id", pos: str = "pos") -> DataFrame:
    """Pairs of every window of ``size`` consecutive sentences; a pair recurs once for each window that holds it."""
    n = sentences.groupBy(doc).agg(F.countDistinct(sent).alias("_n"))
    placed = mentions.join(n, doc)
    last = F.greatest(F.lit(0), F.col("_n") - size)
    ordinal = F.col("ord") - 1
    windows = F.sequence(F.greatest(F.lit(0), ordinal - (size - 1)), F.least(ordinal, last))
    return within_block(placed.withColumn("window", F.explode(windows)).drop("_n"), [doc, "window"], pos)


def predicted_topics(mentions: DataFrame, doc_clusters: DataFrame, doc: str = "doc_id", pos: str = "pos") -> DataFrame:
    """Cross-document pairs inside predicted document clusters (``cluster``, ``docs``: array)."""
    members = doc_clusters.select("cluster", F.explode("docs").alias(doc)).distinct()
    return within_block(mentions.join(members, doc), "cluster", pos)


def full_product(mentions: DataFrame, block: str | list[str]) -> DataFrame:
    """All ordered pairs of a block, a mention with itself included."""
    block = [block] if isinstance(block, str) else block
    one, two = _sides(mentions, block)
    return one.join(two, block)


def with_scope(pairs: DataFrame, doc: str = "doc_id", sent: str = "sent_id") -> DataFrame:
    """``scope``: wd or cd; ``seq``: distance of the sentences, null across documents."""
    same = F.col(f"m1_{doc}") == F.col(f"m2_{doc}") if f"m1_{doc}" in pairs.columns else F.lit(True)
    gap = F.abs(F.col(f"m1_{sent}") - F.col(f"m2_{sent}"))
    return pairs.withColumn("scope", F.when(same, "wd").otherwise("cd")).withColumn("seq", F.when(same, gap))


def scope_counts(mentions: DataFrame, block: str, doc: str = "doc_id", sent: str = "sent_id", gold: str = "gold", pos: str = "pos") -> DataFrame:
    """``name, n, links``: how many pairs of ``within_block`` each scope has, and how many of them have one gold tag (null: of none is it known).

    Mentions are counted, no pairs made: a group of n has n * (n - 1) / 2, less those
    at one place.  Pairs of one sentence or the next are those of all windows of two
    sentences, less those of the sentences, which lie in two.  Sentences are whole numbers.
    """
    here = lambda name, inner, at, held=True: F.when(F.lit(held), F.struct(F.lit(name).alias("group"), inner.cast("string").alias("inner"), at.cast("long").alias("at")))
    none, d, t = F.lit(None), F.col(doc), F.col(sent)
    placed = d.isNotNull() & t.isNotNull()
    groups = F.array(here("all", none, none), here("wd", d, none, d.isNotNull()), here("placed", d, none, placed), here("sent", d, t, placed), here("window", d, t - 1, placed), here("window", d, t, placed))
    tag = F.col(gold).cast("string")
    kind = lambda name, value, held=True: F.when(F.lit(held), F.struct(F.lit(name).alias("kind"), value.cast("string").alias("tag")))
    kinds = F.array(kind("n", none), kind("known", none, tag.isNotNull()), kind("links", tag, tag.isNotNull()))
    given = lambda a: F.explode(F.filter(a, lambda x: x.isNotNull()))
    rows = mentions.where(F.col(block).isNotNull() & F.col(pos).isNotNull()).select(F.col(block).alias("_b"), F.col(pos).alias("_p"), groups.alias("_g"), kinds.alias("_k"))
    rows = rows.select("_b", "_p", "_k", given(F.col("_g")).alias("g")).select("_b", "_p", "g.*", given(F.col("_k")).alias("k")).select("_b", "_p", "group", "inner", "at", "k.*")
    key = ["_b", "group", "inner", "at", "kind", "tag"]
    each = rows.groupBy(*key, "_p").agg(F.count(F.lit(1)).alias("c")).groupBy(*key).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("q"))
    sums = each.agg(*[F.coalesce(F.sum(F.when((F.col("group") == g) & (F.col("kind") == k), F.expr("(n * n - q) div 2"))), F.lit(0)).alias(f"{g}_{k}") for g in ("all", "wd", "placed", "sent", "window") for k in ("n", "known", "links")])
    of = {
        "2s": lambda k: F.col(f"window_{k}") - F.col(f"sent_{k}"), "wd-": lambda k: F.col(f"placed_{k}") - F.col(f"window_{k}") + F.col(f"sent_{k}"), "wd+": lambda k: F.col(f"wd_{k}"),
        "cd-": lambda k: F.col(f"all_{k}") - F.col(f"wd_{k}"), "cd+": lambda k: F.col(f"all_{k}"),
    }
    found = [F.struct(F.lit(s).alias("name"), of[s]("n").alias("n"), F.when(of[s]("known") > 0, of[s]("links")).alias("links")) for s in SCOPES]
    return sums.select(F.explode(F.array(*found)).alias("x")).select("x.*")


def indexed(mentions: DataFrame, block: str, pos: str = "pos", name: str = "index", tile: str | None = None) -> DataFrame:
    """The pairs of ``within_block`` with their place from 0 in the order of block and both places.

    A pair's place is what comes before its block, its first mention and its second
    one; these are counted at the mentions, so no pair is sorted.
    """
    from .filters import running_sums

    rows = mentions.where(F.col(block).isNotNull() & F.col(pos).isNotNull())
    order = Window.partitionBy(block).orderBy(pos)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    at = rows.groupBy(block, pos).agg(F.count(F.lit(1)).alias("_c"))
    at = at.select("*", F.sum("_c").over(order).alias("_upto"), F.sum("_c").over(Window.partitionBy(block)).alias("_n"))
    at = at.withColumn("_own", F.col("_c") * (F.col("_n") - F.col("_upto"))).withColumn("_first", F.coalesce(F.sum("_own").over(before), F.lit(0)))
    blocks = running_sums(at.groupBy(block).agg(F.sum("_own").alias("_all"), F.sum("_own").alias("_end")), F.col(block), ["_end"])
    starts = blocks.select(block, (F.col("_end") - F.col("_all")).alias("_start"))
    at = at.join(starts, block).select(block, pos, "_c", "_upto", (F.col("_first") + F.col("_start")).alias("_first"))
    copy = F.row_number().over(Window.partitionBy(block, pos).orderBy(F.lit(0))) - 1
    held = ["_c", "_upto", "_first", "_copy"]
    p = within_block(rows.withColumn("_copy", copy).join(at, [block, pos]), block, pos, tile)
    place = F.expr("m1__first + m1__c * (m2__upto - m2__c - m1__upto) + m1__copy * m2__c + m2__copy")
    return p.withColumn(name, place.cast("long")).drop(*[f"m{k}_{c}" for k in (1, 2) for c in held])


def with_label(pairs: DataFrame, gold: str = "gold") -> DataFrame:
    return pairs.withColumn("label", (F.col(f"m1_{gold}") == F.col(f"m2_{gold}")).cast("int"))


def with_overlap_label(pairs: DataFrame, clusters: str = "clusters") -> DataFrame:
    """Label by a common cluster of the two mentions' tokens."""
    return pairs.withColumn("label", F.arrays_overlap(f"m1_{clusters}", f"m2_{clusters}").cast("int"))


#: Names of the pair scopes.
SCOPES = ("2s", "wd-", "wd+", "cd-", "cd+")


def scope_filter(scope: str) -> Column:
    """2s: one sentence or the next; wd-: the other within-document pairs; cd-: cross-document; + both and the narrower ones."""
    near = F.coalesce(F.col("seq") <= 1, F.lit(False))
    far = F.coalesce(F.col("seq") > 1, F.lit(False))
    wd, cd = F.col("scope") == "wd", F.col("scope") == "cd"
    return {"2s": wd & near, "wd-": wd & far, "wd+": wd, "cd-": cd, "cd+": wd | cd}[scope]


def adjacent_signed(pairs: DataFrame, sent: str = "sent_id") -> DataFrame:
    """Order and adjacency as a signed difference: second sentence at most one after the first."""
    return pairs.where(F.col(f"m2_{sent}") - F.col(f"m1_{sent}") <= 1)


def unordered(a: str, b: str) -> tuple[Column, Column]:
    """Canonical ends of an unordered pair."""
    return F.least(a, b), F.greatest(a, b)


def subset_check(inner: DataFrame, outer: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of the narrower strategy that the wider one lacks; none are expected."""
    return inner.select(*keys).exceptAll(outer.select(*keys))


def strategy_subset(mentions: DataFrame, inner: str, outer: str, pos: str = "pos", mention: str = "mention") -> DataFrame:
    """``subset_check`` of the pairs within ``inner`` blocks against those within ``outer`` blocks of the same mentions.

    A pair within an inner block is lost exactly if its ends have no common outer block, so
    only inner blocks with several outer ones (or none) make pairs, and no pair is
    shuffled.  That holds where a mention has one place and one block of either kind;
    else all pairs of both strategies are compared.
    """
    keys = [f"m1_{mention}", f"m2_{mention}"]
    places = F.countDistinct(F.struct(inner, outer, pos))
    if mentions.where(F.col(mention).isNull()).limit(1).count() or mentions.groupBy(mention).agg(places.alias("n")).where("n > 1").limit(1).count():
        return subset_check(within_block(mentions, inner, pos), within_block(mentions, outer, pos), keys)
    mixed = mentions.groupBy(inner).agg(F.countDistinct(outer).alias("_n"), F.count_if(F.col(outer).isNull()).alias("_none")).where("_n > 1 or _none > 0").select(inner)
    p = within_block(mentions.join(mixed, inner, "left_semi"), inner, pos)
    return p.where(~F.coalesce(F.col(f"m1_{outer}") == F.col(f"m2_{outer}"), F.lit(False))).select(*keys)
