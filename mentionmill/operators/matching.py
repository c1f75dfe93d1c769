"""Joins that align mentions: spans, heads, nearest entities, arguments, predictions and chains."""

from __future__ import annotations

from collections import defaultdict
from itertools import groupby, islice

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from .arrow_rows import rows


def span_match(pred: DataFrame, gold: DataFrame, block: list[str], text: str = "text", start: str = "start") -> DataFrame:
    """Predicted and gold mentions with the same text and start, one to one in source order (``pos``)."""
    keys = [*block, text, start]
    nth = lambda df, name: df.select(*keys, F.col("pos").alias(name), F.row_number().over(Window.partitionBy(*keys).orderBy("pos")).alias("_n"))
    return nth(pred, "pred_pos").join(nth(gold, "gold_pos"), [*keys, "_n"]).drop("_n")


def relaxed_match(pred: DataFrame, gold: DataFrame, block: list[str]) -> DataFrame:
    """Greedy one-to-one match inside each block: equal span, same head, or containment, with a common token.

    Predicted mentions go in source order; each takes the first free gold
    mention that fits.  ``block, pred_pos, gold_pos, how``.  A block is a sentence.
    """
    cols = ["pos", "text", "start", "end", "head", "tokens"]
    tag = lambda df, side: df.select(*block, F.lit(side).alias("side"), *cols)
    kinds = dict(pred.dtypes)

    k = len(block)

    def solve(batches):
        schema, out = None, []

        def packed():
            names = [*block, "pred_pos", "gold_pos", "how"]
            types = [*schema.types[:k], pa.int32(), pa.int32(), pa.string()]
            return pa.record_batch([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names=names)

        def read():
            nonlocal schema
            for batch in batches:
                schema = batch.schema
                yield from rows([batch])

        for own, some in groupby(read(), key=lambda r: r[:k]):
            sides = {"p": [], "g": []}
            for r in some:
                sides[r[k]].append(r[k + 1 :])
            out += [(*own, *m) for m in _greedy(sides["p"], sides["g"])]
            if len(out) >= 1 << 14:
                yield packed()
                out = []
        if out:
            yield packed()

    schema = ", ".join([*(f"{b} {kinds[b]}" for b in block), "pred_pos int", "gold_pos int", "how string"])
    both = tag(pred, "p").unionByName(tag(gold, "g"))
    return both.repartition(*block).sortWithinPartitions(*block, "pos").mapInArrow(solve, schema)


def _greedy(preds: list[tuple], golds: list[tuple]):
    """(pos, gold's pos, how) of a sentence's mentions ``pos, text, start, end, head, tokens`` in order.

    A gold mention that fits has the span or a token of the predicted one, so only such are looked at.
    """
    by: dict = defaultdict(list)  # places of the gold mentions of a span or a token, in order
    for i, (_, text, start, _, _, tokens) in enumerate(golds):
        by[text, start].append(i)
        for t in set(tokens):
            by[t].append(i)
    first: dict = defaultdict(int)  # those before this one in a list are taken
    free = [True] * len(golds)
    for pos, text, start, end, head, tokens in preds:
        best, how = len(golds), None
        for key in ((text, start), *set(tokens)):
            if (near := by.get(key)) is None:
                continue
            at = first[key]
            while at < len(near) and not free[near[at]]:
                at += 1
            first[key] = at
            for i in islice(near, at, None):
                if i >= best:
                    break
                if free[i]:
                    _, t, s, e, h, _ = golds[i]
                    if (kind := "span" if text == t and start == s else "head" if head == h else "inside" if (start >= s and end <= e) or (s >= start and e <= end) else None):
                        best, how = i, kind
                        break
        if how:
            free[best] = False
            yield pos, golds[best][0], how


#: Entity types that are no arguments' neighbours.
PLACE_TIME = ("LOC", "TIM")


def nearest_entity(events: DataFrame, entities: DataFrame, block: list[str], left: bool, skip: tuple[str, ...] = PLACE_TIME) -> DataFrame:
    """Nearest entity on one side of each event, at a distance over 0; the first in source order among equals.

    An as-of join: events and entities are put in one order per block and the
    last entity seen is carried along, so no pairs are made.
    """
    kept = entities.where(~F.col("type").isin(*skip)) if skip else entities
    edge = "end" if left else "start"
    # per end offset the first in source order
    ent = kept.groupBy(*block, F.col(edge).alias("at")).agg(F.min_by("mention", "pos").alias("entity"))
    ask = events.select(*block, F.col("start" if left else "end").alias("at"), F.col("mention").alias("event"))
    rows = ent.withColumn("event", F.lit(None).cast(dict(ask.dtypes)["event"])).unionByName(
        ask.withColumn("entity", F.lit(None).cast(dict(ent.dtypes)["entity"]))
    )
    # an entity at the event's own offset has distance 0 and does not count: events come first
    order = [F.col("at").asc() if left else F.col("at").desc(), F.col("event").isNull().asc()]
    w = Window.partitionBy(*block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("entity").isNotNull(), F.struct("entity", "at")), ignorenulls=True).over(w)
    out = rows.withColumn("near", seen).where("event is not null")
    return out.select(*block, "event", F.col("near.entity").alias("entity"), F.abs(F.col("at") - F.col("near.at")).alias("distance"))


def argument_match(arguments: DataFrame, entities: DataFrame, block: list[str], text_only: bool = False) -> DataFrame:
    """First entity (source order) that each argument matches; time and place roles take only their types.

    ``arguments``: event, role, text, tokens, start, end.  Matches by text, by
    containment either way or by a common token; with ``text_only`` by equal
    tokens, equal text or text inside text.
    """
    a, e = arguments.alias("a"), entities.alias("e")
    same = F.col("a.text") == F.col("e.text")
    if text_only:
        fits = (F.col("a.tokens") == F.col("e.tokens")) | same | F.col("e.text").contains(F.col("a.text")) | F.col("a.text").contains(F.col("e.text"))
    else:
        inside = (F.col("e.start") >= F.col("a.start")) & (F.col("e.end") <= F.col("a.end"))
        around = (F.col("a.start") >= F.col("e.start")) & (F.col("a.end") <= F.col("e.end"))
        fits = same | inside | around | F.arrays_overlap("e.tokens", F.sequence("a.start", "a.end"))
    role = F.when(F.col("a.role") == "AM-TMP", F.col("e.type") == "TIM").when(F.col("a.role") == "AM-LOC", F.col("e.type") == "LOC").otherwise(True)
    on = [F.col(f"a.{b}") == F.col(f"e.{b}") for b in block]
    hits = a.join(e, on).where(fits & role)
    return hits.groupBy(*[F.col(f"a.{b}").alias(b) for b in block], F.col("a.event").alias("event"), F.col("a.role").alias("role")).agg(
        F.min_by(F.struct(F.col("e.text").alias("text"), F.col("e.mention").alias("mention")), F.col("e.pos")).alias("argument")
    )


def overlap_match(pred: DataFrame, gold: DataFrame, block: list[str], share: float = 0.5) -> DataFrame:
    """First gold mention (source order) of whose tokens more than ``share`` are in the predicted mention.

    Tokens are exploded and counted, so only mentions with a common token meet.
    """
    p = pred.select(*block, F.col("mention").alias("pred"), F.explode(F.array_distinct("tokens")).alias("token"))
    g = gold.select(*block, F.col("mention").alias("gold"), F.col("pos"), F.size(F.array_distinct("tokens")).alias("n"), F.explode(F.array_distinct("tokens")).alias("token"))
    shared = p.join(g, [*block, "token"]).groupBy(*block, "pred", "gold", "pos", "n").agg(F.count(F.lit(1)).alias("c"))
    return shared.where(F.col("c") > share * F.col("n")).groupBy(*block, "pred").agg(F.min_by("gold", "pos").alias("gold"))


def left_with_default(gold_pairs: DataFrame, pred_pairs: DataFrame, value: str = "pred", default: int = 0, by: list[str] | None = None) -> DataFrame:
    """Gold pairs with their prediction, ``default`` where there is none; ends in any order.

    ``by``: columns of both that all rows of a pair share.  Pairs that already lie by
    them (``pairs.within_block`` with a tile) meet where they are, a tile at a time.
    """
    key = lambda df: df.withColumn("_x", F.least("a", "b")).withColumn("_y", F.greatest("a", "b"))
    if by is None:
        right = key(pred_pairs).select("_x", "_y", value).dropDuplicates(["_x", "_y"])
        out = key(gold_pairs).join(right, ["_x", "_y"], "left").drop("_x", "_y")
        return out.withColumn(value, F.coalesce(value, F.lit(default)))
    kinds, names = dict(gold_pairs.dtypes) | {value: dict(pred_pairs.dtypes)[value]}, [*gold_pairs.columns, value]

    def meet(gold: pa.Table, pred: pa.Table) -> pa.Table:
        right = pred.group_by(["_x", "_y"], use_threads=False).aggregate([(value, "first", pc.ScalarAggregateOptions(skip_nulls=False))]).rename_columns(["_x", "_y", value])
        out = gold.join(right, ["_x", "_y"], join_type="left outer", use_threads=False).select(names)
        i = names.index(value)
        return out.set_column(i, value, pc.fill_null(out[value], default))

    right = key(pred_pairs).select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(by)], "_x", "_y", value)  # both may be made of the same pairs
    one, two = key(gold_pairs).groupBy(*by), right.groupBy(*[f"_{i}" for i in range(len(by))])
    return one.cogroup(two).applyInArrow(meet, ", ".join(f"`{c}` {kinds[c]}" for c in names))


#: Rows that are sent to all executors to look ends of pairs up; more are joined by a shuffle of the pairs.
LOOKED_UP = 1 << 20


def lookup_ends(pairs: DataFrame, info: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Columns of both ends of each pair, looked up by id; ``info`` is broadcast where it has at most ``LOOKED_UP`` rows, as pairs are many more."""
    info = info.select(key, *columns)
    if info.limit(LOOKED_UP + 1).count() <= LOOKED_UP:
        info = F.broadcast(info)
    out = pairs
    for end, prefix in (("a", "m1_"), ("b", "m2_")):
        out = out.join(info.select(F.col(key).alias(end), *[F.col(c).alias(prefix + c) for c in columns]), end, "left")
    return out


def merge_on_span(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("doc", "sentence", "start", "end")) -> DataFrame:
    return left.join(right, list(keys))


def by_row(left: DataFrame, right: DataFrame, row: str = "row") -> DataFrame:
    """Positional join over an explicit row id; both sides must have the same rows."""
    return left.join(right, row, "full")


def _pairs_digest(df: DataFrame, columns: list[str], key: list[str]) -> tuple | None:
    """Number of rows and sums of 112 bits of hashes, the same for the same rows in any order; None if a key is null or a sum too large."""
    pieces = [(h.bitwiseAND(F.lit((1 << 28) - 1)) if not k else F.shiftright(h, 28).bitwiseAND(F.lit((1 << 28) - 1))) for h in (F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns)) for k in (0, 1)]
    none = F.lit(False)
    for c in key:
        none = none | F.col(c).isNull()
    n, nulls, *sums = df.agg(F.count(F.lit(1)), F.count_if(none), *[F.try_sum(p) for p in pieces]).first()
    return None if nulls or (n and None in sums) else (n, *sums)


def mixed_experiments(near: DataFrame, wd: DataFrame, cd: DataFrame, key: list[str]) -> DataFrame:
    """Each pair with the answer of the experiment for its class: same or next sentence, other within-document, cross-document.

    The experiments must hold the same pairs; a pair that one lacks raises.  Where
    digests say that they do, with the same classes, each answers for its own class
    and nothing is joined; else they are joined by their pairs.
    """
    parts = (near, wd, cd)
    if all({"scope", "seq"} <= set(df.columns) for df in parts) and len({dict(df.dtypes)["pred"] for df in parts}) == 1 and dict(near.dtypes)["pred"] in ("int", "bigint", "double"):
        told = [_pairs_digest(df, [*key, "scope", "seq"], key) for df in parts]
        if told[0] is not None and told[0] == told[1] == told[2]:
            close = F.coalesce(F.col("seq") <= 1, F.lit(False))
            within = ~close & F.coalesce(F.col("scope") == "wd", F.lit(False))
            first, second, third = (df.where(c).select(*key, "scope", "seq", "pred") for df, c in zip(parts, (close, within, ~close & ~within)))
            return first.unionByName(second).unionByName(third)
    a = near.select(*key, "scope", "seq", F.col("pred").alias("near_pred"))
    b = wd.select(*key, F.col("pred").alias("wd_pred"), F.lit(1).alias("_b"))
    c = cd.select(*key, F.col("pred").alias("cd_pred"), F.lit(1).alias("_c"))
    out = a.withColumn("_a", F.lit(1)).join(b, key, "full").join(c, key, "full")
    lost = F.col("_a").isNull() | F.col("_b").isNull() | F.col("_c").isNull()
    pick = F.when(lost, F.raise_error(F.lit("experiments hold different pairs")).cast("int")).when(
        F.coalesce(F.col("seq") <= 1, F.lit(False)), F.col("near_pred")
    ).when(F.col("scope") == "wd", F.col("wd_pred")).otherwise(F.col("cd_pred"))
    return out.select(*key, "scope", "seq", pick.alias("pred"))


def drop_nested(mentions: DataFrame, block: list[str] = ("doc", "chain")) -> DataFrame:
    """Mentions that lie in no other mention of their chain and document; equal spans of two mentions drop each other.

    In the order of starts, the longest first, a span lies in another one exactly
    if some end before it is not smaller: a running maximum, and no pairs.  Rows
    with a null in what is compared stay; repeated rows of a mention are one.
    """
    block = list(block)
    whole = F.lit(True)
    for c in (*block, "mention", "start", "end"):
        whole = whole & F.col(c).isNotNull()
    before = Window.partitionBy(*block).orderBy("start", F.col("end").desc()).rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy(*block, "start", "end")
    rows = mentions.where(whole).withColumn("_reach", F.coalesce(F.max("end").over(before).cast("long"), F.lit(-(1 << 63))))
    rows = rows.withColumn("_reach", F.min("_reach").over(same)).withColumn("_alone", F.min("mention").over(same) == F.max("mention").over(same))
    kept = rows.where((F.col("_reach") < F.col("end")) & F.col("_alone")).drop("_reach", "_alone")
    return kept.unionByName(mentions.where(~whole))


def token_sequence_at(sentence: str | Column, mention: str | Column) -> Column:
    """First place (from 0) at which a mention's tokens stand in a sentence's; null if nowhere."""
    s, m = (F.col(x) if isinstance(x, str) else x for x in (sentence, mention))
    last = F.size(s) - F.size(m)
    starts = F.filter(F.sequence(F.lit(0), last), lambda i: F.slice(s, i + 1, F.size(m)) == m)
    return F.when((F.size(m) > 0) & (last >= 0), F.get(starts, F.lit(0)))


def reindex_tokens(docs: DataFrame, mentions: DataFrame) -> DataFrame:
    """Places of mention tokens in a document's clean tokens.

    ``docs``: doc_id, clean_tokens; ``mentions``: doc_id, m_id, raw_ids, tokens.
    Mentions go by their first raw id.  Each token is searched after the one
    before it: an equal token, else one that it is a prefix of.  The search for
    a mention restarts at the first new place of the one before where that ends at
    or after it.  Tokens that cannot be placed give a null list.
    """

    def solve(doc: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if doc.empty or own.empty:
            return pd.DataFrame(columns=["doc_id", "m_id", "tokens_ids"])
        clean = list(doc.clean_tokens.iloc[0])
        out, at, before = [], 0, None
        for m in sorted(own.to_dict("records"), key=lambda r: (r["raw_ids"][0], r["m_id"])):
            if before is not None and before[1]:
                at = before[1][0] if before[0][-1] >= m["raw_ids"][-1] else before[1][-1]
            places = []
            for token in m["tokens"]:
                rest = range(at + 1, len(clean))
                found = next((i for i in rest if clean[i] == token), None)
                if found is None:
                    found = next((i for i in rest if clean[i].startswith(token)), None)
                if found is None:
                    places = None
                    break
                places.append(found)
                at = found
            out.append((m["doc_id"], m["m_id"], places))
            before = (m["raw_ids"], places)
        return pd.DataFrame(out, columns=["doc_id", "m_id", "tokens_ids"])

    # a document's tokens and its mentions meet once, not the tokens with each mention
    sides = docs.select("doc_id", "clean_tokens").groupBy("doc_id").cogroup(mentions.groupBy("doc_id"))
    return sides.applyInPandas(solve, "doc_id string, m_id string, tokens_ids array<int>")


def align_tokens(gold: DataFrame, pieces: DataFrame, block: str = "doc_id") -> DataFrame:
    """Gold token of every tokenizer piece, by the characters before each (``pos, text`` on both sides).

    Lengths before a token are a running sum; a piece belongs to the gold token
    in whose characters it starts.
    """
    w = Window.partitionBy(block).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    at = lambda df: df.withColumn("at", F.coalesce(F.sum(F.length("text")).over(w), F.lit(0)))
    none = F.lit(None).cast("int")
    rows = at(gold).where(F.length("text") > 0).select(block, "at", F.lit(0).alias("side"), F.col("pos").alias("gold_pos"), none.alias("piece_pos"))
    rows = rows.unionByName(at(pieces).select(block, "at", F.lit(1).alias("side"), none.alias("gold_pos"), F.col("pos").alias("piece_pos")))
    run = Window.partitionBy(block).orderBy("at", "side", "gold_pos", "piece_pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("gold_pos", F.last("gold_pos", ignorenulls=True).over(run)).where("side = 1").select(block, "piece_pos", "gold_pos")


def triangle_legs(pairs: DataFrame, value: str = "pred") -> DataFrame:
    """Value of an unordered pair under both orders of its ends, for lookups of triangle legs."""
    return pairs.select("block", "a", "b", value).unionByName(pairs.select("block", F.col("b").alias("a"), F.col("a").alias("b"), value))


def chains_to_gold(chains: DataFrame, mapping: DataFrame, block: list[str]) -> DataFrame:
    """Predicted chains with their members' gold mentions; unmapped members and empty chains are left out."""
    got = chains.join(mapping, [*block, "pred"])
    return got.groupBy(*block, "chain").agg(F.array_sort(F.collect_set("gold")).alias("mentions"))


def labels_from_clusters(pairs: DataFrame, clusters: DataFrame) -> DataFrame:
    """1 where some cluster holds both ends (``block, mention, chain``)."""
    c = clusters.groupBy("block", "mention").agg(F.collect_set("chain").alias("chains"))
    out = pairs
    for end in "ab":
        out = out.join(c.select("block", F.col("mention").alias(end), F.col("chains").alias(f"_{end}")), ["block", end], "left")
    return out.withColumn("label", F.coalesce(F.arrays_overlap("_a", "_b"), F.lit(False)).cast("int")).drop("_a", "_b")


def chain_rows(chains: DataFrame, tokens: DataFrame) -> DataFrame:
    """Mention rows of chain output: ``doc, chain, spans`` (array of start, end) with tokens and sentence of each span."""
    flat = chains.select("doc", "chain", F.posexplode("spans").alias("nth", "span"))
    t = tokens.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("pos", "token", "sent_id"))).alias("ts"))
    cut = F.slice("ts", F.col("span.start") + 1, F.col("span.end") - F.col("span.start") + 1)
    return flat.join(t, "doc").select(
        "doc", "chain", "nth", F.col("span.start").alias("start"), F.col("span.end").alias("end"),
        F.transform(cut, lambda x: x["token"]).alias("tokens"), F.get(cut, F.lit(0))["sent_id"].alias("sent_id"),
    )


def relation_targets(mentions: DataFrame, relations: DataFrame) -> DataFrame:
    """Each mention with its relation's kind and a full-text cluster id; mentions without a relation are alone.

    INTRA ids get a suffix for events and entities, CROSS ids are the note;
    singleton ids hold the document, so they never meet across documents.
    """
    r = relations.select("doc_id", F.explode("sources").alias("m_id"), "kind", "r_id", "note", "target")
    got = mentions.join(r, ["doc_id", "m_id"], "left")
    kind = F.when(F.col("is_event"), "event").otherwise("entity")
    cid = (
        F.when(F.col("kind").startswith("INTRA"), F.concat_ws("_", F.lit("INTRA"), kind, "r_id", "doc_id"))
        .when(F.col("kind").isNotNull(), F.col("note"))
        .otherwise(F.concat_ws("_", F.lit("Singleton"), kind, "m_id", "doc_id"))
    )
    return got.withColumn("cluster", cid)


def unmatched(mentions: DataFrame, tokens: DataFrame, keys: tuple[str, ...] = ("doc_id", "sent_id")) -> DataFrame:
    """Mentions of which some token is missing in its sentence; none are expected."""
    flat = mentions.select(*keys, "mention", F.explode("tokens").alias("token_id"))
    return flat.join(tokens.select(*keys, "token_id"), [*keys, "token_id"], "left_anti").select(*keys, "mention").distinct()
