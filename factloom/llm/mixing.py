"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

A token budget goes down a tree of levels (for instance domain, language, source): each node shares its budget among its
children by weight; a child that can't use its share (its documents times ``max_epochs``) is filled, and what it leaves goes to its
siblings, and to an ancestor's siblings only when the whole subtree is filled. That is water-filling among siblings over
subtree capacities, done with one window a level over the small table of nodes, in exact integers. A leaf takes its
documents for as many whole epochs as its budget holds and a token prefix of the next, whose order is a seeded hash of epoch
and document; the last document may be taken in part.

Prefixes are found from sums of hash buckets, whose number grows with the leaf, so a leaf may hold any share of all rows.
Defined results: null text has no tokens and is never taken; null levels count as empty names; children without a given weight get
``default_weight``, those of weight zero nothing; repeated rows count each; an empty table gives an empty table; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import cut, whole_text
from factloom.llm.quality import words_of

#: Documents in a bucket of a leaf's order, about.
BUCKET_DOCS = 2000

#: Buckets in a run, a power of two: a leaf of 10^12 documents has some 10^6 runs.
RUN = 512


def weight_of(level: str, weights: dict[str, int], default: int) -> Column:
    """Integer weight of a node by its name."""
    out = F.lit(default)
    for name, w in weights.items():
        out = F.when(F.col(level) == name, F.lit(w)).otherwise(out)
    return out.cast("long")


def shared_out(nodes: DataFrame, parents: list[str], level: str) -> DataFrame:
    """``budget`` of each child from its parent's ``parent_budget``: columns parents + level, cap, w, parent_budget.

    Children are taken by capacity per weight; one is filled as long as its capacity is no more than its share of what is left.
    """
    group = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    order = group.orderBy(F.col("cap") / F.col("w"), level)
    nodes = nodes.where("w > 0").withColumns({
        "before": F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "weights": F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    })
    nodes = nodes.withColumn("full", F.expr("cap * weights <= (parent_budget - before) * w"))
    nodes = nodes.withColumns({"used": F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(group), "open": F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(group)})
    nodes = nodes.withColumn("share", F.expr("case when full then cap else (parent_budget - used) * w div open end"))
    rest = F.col("parent_budget") - F.sum("share").over(group)
    turn = F.row_number().over(Window.partitionBy(*parents, "full").orderBy(level)) if parents else F.row_number().over(Window.partitionBy("full").orderBy(level))
    nodes = nodes.withColumns({"rest": rest, "turn": turn})
    return nodes.select(*parents, level, "cap", F.expr("share + case when not full and turn <= rest then 1 else 0 end").alias("budget"))


def budgets(leaves: DataFrame, levels: list[str], total: Column, weights: dict[str, dict[str, int]], default_weight: int, max_epochs: int) -> DataFrame:
    """``levels, tokens, docs, budget`` of each leaf; ``total`` is the wanted budget in terms of ``sum_tokens``."""
    leaves = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    whole = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("sum_tokens"), F.coalesce(F.sum("cap"), F.lit(0)).alias("sum_cap"))
    root = whole.select(F.least(total.cast("long"), "sum_cap").alias("parent_budget"))
    given = None
    for i, level in enumerate(levels):
        parents = levels[:i]
        nodes = leaves.groupBy(*levels[: i + 1]).agg(F.sum("cap").alias("cap")).withColumn("w", weight_of(level, weights.get(level, {}), default_weight))
        nodes = nodes.crossJoin(F.broadcast(root)) if given is None else nodes.join(given.select(*parents, F.col("budget").alias("parent_budget")), parents)  # root: one row
        given = cut(shared_out(nodes, parents, level), "budgets")
    return leaves.drop("cap").join(given.drop("cap"), levels)


def starts(dealt: DataFrame, levels: list[str]) -> DataFrame:
    """``levels, bucket, size, start``: tokens of each bucket of a leaf and of those before it.

    Sums are made in two levels, runs of buckets and buckets of a run, so no window holds all buckets of a large leaf.
    """
    sums = cut(dealt.groupBy(*levels, "bucket").agg(F.sum("n_tokens").alias("size")).withColumn("run", F.col("bucket").bitwiseAND(F.lit(-RUN))), "sums")
    runs = sums.groupBy(*levels, "run").agg(F.sum("size").alias("run_size"))
    runs = runs.withColumn("before", F.sum("run_size").over(Window.partitionBy(*levels).orderBy("run")) - F.col("run_size")).drop("run_size")
    inner = F.sum("size").over(Window.partitionBy(*levels, "run").orderBy("bucket")) - F.col("size")
    return sums.withColumn("inner", inner).join(runs, [*levels, "run"]).select(*levels, "bucket", "size", (F.col("before") + F.col("inner")).alias("start"))


def mix(
    docs: DataFrame, levels: list[str], total: Column, weights: dict[str, dict[str, int]], default_weight: int = 1, max_epochs: int = 2, seed: int = 17,
    id_col: str = "doc_id", n_tokens: Column | None = None, text_col: str = "text", keep: list[str] | None = None,
) -> DataFrame:
    """``id_col, keep, levels, n_tokens, full_epochs, part_tokens`` of every row of which tokens are taken.

    Without ``n_tokens`` tokens are the words of the text. The columns ``keep`` are carried along and break ties of equal ids.
    """
    keep = keep or []
    counted = F.size(words_of(whole_text(text_col))) if n_tokens is None else n_tokens
    names = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in levels]
    rows = cut(docs.select(id_col, *keep, *names, counted.cast("long").alias("n_tokens")).where("n_tokens > 0"), "tokens")
    leaves = rows.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    plan = cut(budgets(leaves, levels, total, weights, default_weight, max_epochs), "plan")
    plan = plan.selectExpr(*levels, "budget div tokens as full_epochs", "budget % tokens as part", f"cast(ceil(docs / {BUCKET_DOCS}) as long) as buckets")
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("full_epochs") + 1, F.col(id_col).cast("string")))
    place = F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.col("buckets")
    dealt = rows.join(plan, levels).withColumn("key", key).withColumn("bucket", F.shiftright(place, 32))
    placed = dealt.join(starts(dealt, levels), [*levels, "bucket"])
    columns = [id_col, *keep, *levels, "n_tokens", "full_epochs"]
    clear = placed.where("start + size <= part or start >= part").select(*columns, F.when(F.col("start") < F.col("part"), F.col("n_tokens")).otherwise(0).alias("part_tokens"))
    inner = Window.partitionBy(*levels, "bucket").orderBy("key", id_col, "n_tokens", *keep).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    torn = placed.where("start < part and start + size > part").withColumn("at", F.col("start") + F.sum("n_tokens").over(inner) - F.col("n_tokens"))
    torn = torn.select(*columns, F.greatest(F.lit(0), F.least("n_tokens", F.col("part") - F.col("at"))).cast("long").alias("part_tokens"))
    return clear.unionByName(torn).where("full_epochs > 0 or part_tokens > 0")
