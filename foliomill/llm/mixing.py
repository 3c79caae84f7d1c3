"""Mixing sources to target weights by pivotal dependent rounding (DataFrame functions only).

Every item of a source starts with the same number of copies, target / source size. Its
whole part is given outright; the fractional parts are rounded *dependently*: two items
meet, a random amount of size-weighted mass moves from one to the other until one of them
is integral, and the other goes on to the next meeting. Each item keeps its expected
copies, and the size-weighted sum of a source never changes until its last residual is
rounded, so the taken total is off by less than one item.

Meetings happen inside small blocks of a source (a fold over at most a few hundred
items); each block hands at most one residual to the next level, so the levels form a
reduction tree of depth log_48(items) and no task ever holds a whole source.

Edge cases: items of size 0 take no words and are rounded independently; a null source is
a source of its own, ordered last; null text counts as size 0; an empty table gives an
empty result; repeated rows are items of their own. Columns beyond those named are ignored
by the query and kept by the pipeline stage.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliomill.plans.ordering import running
from foliomill.plans.workspace import materialize

WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 48


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(items: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, n_items, target): ``share`` of all sizes split by weight.

    Weights repeat over the sources in code point order, null last; sources are ordered by
    ranges, so their number has no bound in one task. A target stops at
    ``cap`` times its source's size and the excess is shared again by weight. The fixed
    point of that resharing is found in one pass: in order of size / weight the capped
    sources come first, and the first source that the remaining mass per weight does not
    fill settles the level for all after it.
    """
    sums = items.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_items"))
    ranked = running(sums, [F.col("source").asc_nulls_last()]).withColumnRenamed("position", "rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    filled = ranked.withColumn("weight", weight).withColumn("fill", F.col("source_size") / F.col("weight"))
    filled = materialize(running(filled, [F.col("fill"), F.col("rank")], ("source_size", "weight")), "mix-fill")
    total = filled.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    if total.size is None:
        return filled.select("source", "source_size", "n_items", F.lit(0.0).alias("target"))
    level = (F.lit(float(total.size) * share) - F.lit(float(cap)) * F.col("before_source_size")) / (F.lit(total.weight) - F.col("before_weight"))
    is_open = F.col("source_size") * F.lit(float(cap)) > level * F.col("weight")
    first = filled.where(is_open).agg(F.min(F.struct("position", level.alias("level"))).alias("x")).first().x
    full = F.col("source_size") * F.lit(float(cap))
    target = full if first is None else F.when(F.col("position") < first.position, full).otherwise(F.lit(first.level) * F.col("weight"))
    return filled.select("source", "source_size", "n_items", target.alias("target"))


def _uniform(*parts: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") * F.lit(2.0**-53)


def _meet(acc: Column, item: Column, seed: int) -> Column:
    """One meeting: ``acc.cur`` and ``item`` exchange mass; the integral one is put out."""
    cur = acc["cur"]
    up_c, up_i = cur["size"] * (1 - cur["p"]), item["size"] * (1 - item["p"])
    down_c, down_i = cur["size"] * cur["p"], item["size"] * item["p"]
    alpha, beta = F.least(up_c, down_i), F.least(down_c, up_i)
    raise_cur = _uniform(F.lit(seed), cur["id"], item["id"]) * (alpha + beta) < beta
    p_cur = (
        F.when(raise_cur & (up_c <= down_i), F.lit(1.0))
        .when(raise_cur, cur["p"] + alpha / cur["size"])
        .when(down_c <= up_i, F.lit(0.0))
        .otherwise(cur["p"] - beta / cur["size"])
    )
    p_item = (
        F.when(raise_cur & (up_c > down_i), F.lit(0.0))
        .when(raise_cur, item["p"] - alpha / item["size"])
        .when(down_c > up_i, F.lit(1.0))
        .otherwise(item["p"] + beta / item["size"])
    )
    new_cur, new_item = cur.withField("p", p_cur), item.withField("p", p_item)
    cur_done = F.when(raise_cur, up_c <= down_i).otherwise(down_c <= up_i)
    return F.struct(
        F.when(cur_done, new_item).otherwise(new_cur).alias("cur"),
        F.concat(acc["out"], F.array(F.when(cur_done, new_cur).otherwise(new_item))).alias("out"),
    )


def _round_level(items: DataFrame, level: int, seed: int) -> DataFrame:
    """Fold every block of ``BLOCK`` items on average; at most one item of a block stays fractional."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n_items") / F.lit(float(BLOCK) ** (level + 1)))).cast("long")
    dealt = items.withColumn("block", F.pmod(F.xxhash64(F.lit(seed + level), "id"), blocks))
    item = F.struct(F.xxhash64(F.lit(seed), "id").alias("order"), "id", F.col("size").cast("double").alias("size"), "p", "row")
    grouped = dealt.groupBy("source", "block").agg(F.array_sort(F.collect_list(item)).alias("items"), F.max("n_items").alias("n_items"))
    first = F.element_at("items", 1)
    folded = F.aggregate(
        F.slice("items", F.lit(2), F.size("items")),
        F.struct(first.alias("cur"), F.slice("items", 1, 0).alias("out")),
        lambda acc, x: _meet(acc, x, seed + 1000 * (level + 1)),
        lambda acc: F.concat(acc["out"], F.array(acc["cur"])),
    )
    out = grouped.select("source", "n_items", F.explode(folded).alias("x"))
    return out.select("source", "n_items", F.col("x.id").alias("id"), F.col("x.size").alias("size"), F.col("x.p").alias("p"), F.col("x.row").alias("row"))


def mix(items: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 17) -> DataFrame:
    """Decide how often each item is taken.

    ``items`` has id (long, unlike for unlike items), source, size (long) and any payload;
    returned are all its columns with source_size, target and copies (long, at most
    ``cap`` rounded up). The outcome is a function of the ids and the seed.
    """
    payload = [c for c in items.columns if c not in ("id", "source", "size")]
    items = materialize(items, "mix-items")
    targets = materialize(source_targets(items, weights, share, cap), "mix-targets")
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    row = F.struct(F.col("size").alias("item_size"), *payload, "source_size", "target", F.floor("copies").alias("whole"))
    start = items.join(targets, items["source"].eqNullSafe(targets["source"])).drop(targets["source"]).withColumn("copies", copies)
    start = start.select("source", "id", "size", "n_items", (F.col("copies") - F.floor("copies")).alias("p"), row.alias("row"))
    settled = (F.col("size") == 0) | (F.col("p") == 0)
    done = [start.where(settled).withColumn("p", (_uniform(F.lit(seed), F.col("id")) < F.col("p")).cast("double")).select("source", "n_items", "id", F.col("size").cast("double").alias("size"), "p", "row")]
    most = targets.agg(F.max("n_items")).first()[0] or 0
    level, rest = 0, start.where(~settled)
    while True:
        rounded = materialize(_round_level(rest, level, seed), "mix-level")
        whole = F.col("p").isin(0.0, 1.0)
        last = most <= BLOCK ** (level + 1)
        if last:
            done.append(rounded.withColumn("p", F.when(whole, F.col("p")).otherwise((_uniform(F.lit(seed), F.col("id")) < F.col("p")).cast("double"))))
            break
        done.append(rounded.where(whole))
        rest, level = rounded.where(~whole), level + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select(
        "id", "source", F.col("row.item_size").alias("size"), *[F.col("row")[c].alias(c) for c in payload],
        F.col("row.source_size").alias("source_size"), F.col("row.target").alias("target"),
        (F.col("row.whole") + F.col("p")).cast("long").alias("copies"),
    )


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """Every row of ``docs`` as an item: doc_id, source, size, source_size, target, copies, taken.

    An item's draws depend on its doc_id and text; rows alike in both, and in source, are
    numbered, so that they are items of their own and are dealt to different blocks.
    """
    items = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("t"))
    alike = F.row_number().over(Window.partitionBy("doc_id", "source", "t").orderBy("size"))
    items = items.withColumn("id", F.xxhash64("doc_id", "t", alike))
    return mix(items.select("doc_id", "source", "size", "id"), **options).withColumn("taken", F.col("copies") * F.col("size"))


def repeat_by_mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each row standing as often as the mix takes it (not at all for 0 copies).

    Rows alike in doc_id, source and text are one item of their joint size.
    """
    own = "_mix"
    while any(c.startswith(own) for c in docs.columns):
        own += "_"
    d, s, t, size, copies, copy = (f"{own}_{x}" for x in ("doc", "source", "text", "size", "copies", "copy"))
    key = docs.withColumn(t, F.xxhash64("text")).withColumn(size, word_count(F.col("text")))
    units = key.groupBy("doc_id", "source", t).agg(F.sum(size).alias("size"))
    units = units.select("doc_id", "source", F.col(t).alias("t"), "size", F.xxhash64("doc_id", t).alias("id"))
    taken = mix(units, **options).where("copies > 0").select(F.col("doc_id").alias(d), F.col("source").alias(s), "t", F.col("copies").alias(copies))
    same = key["doc_id"].eqNullSafe(taken[d]) & key["source"].eqNullSafe(taken[s]) & key[t].eqNullSafe(taken["t"])
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))
    return key.join(taken, same).withColumn(copy, each).select(*[key[c] for c in docs.columns])
