"""Error-driven split and merge of tree nodes under a node budget."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import in_roi
from ..sources.tables import settled


def family_options(nodes: DataFrame, fan: int = 8, split_factor: float = 0.75, merge_factor: float = 1.1, saved: bool = False, roi: tuple | None = None) -> DataFrame:
    """One row per active node: its family, costs and values of keeping, splitting and merging.

    ``nodes``: node_id, parent_id, leaf, active, culled, error, max_density. Merging needs a family that is wholly
    active or culled; a leaf cannot split, a root cannot merge. A split is expected to lower the error by
    ``split_factor``; with ``saved``, where the first child has an error from an earlier time, the sum of all
    children's errors times densities counts instead. With ``roi`` (lower and upper ends, boxes x0..z1 in ``nodes``)
    only nodes that touch the region may split.
    """
    family = nodes.where("parent_id is not null").groupBy("parent_id").agg(F.min((F.col("active") | F.col("culled")).cast("int")).alias("whole"), F.count_if("active").alias("siblings"), F.sum(F.when(F.col("active"), F.greatest("error", F.lit(0.0)))).alias("err"), F.max(F.when(F.col("active"), F.col("max_density"))).alias("dens"))
    kids = nodes.groupBy(F.col("parent_id").alias("p")).agg(F.count_if("culled").alias("culled_kids"), F.sum(F.col("error") * F.col("max_density")).alias("kids_value"), F.min_by("error", "node_id").alias("first_error"))
    a = nodes.where("active").join(family, "parent_id", "left").join(kids, F.col("node_id") == F.col("p"), "left")
    none = F.col("error") * F.col("max_density")
    split = F.when(F.col("first_error") > 0, F.col("kids_value")).otherwise(split_factor * none) if saved else split_factor * none
    may = ~F.col("leaf") & (in_roi(*roi) if roi else F.lit(True))
    return a.select("node_id", "parent_id", none.alias("none_value"), F.when(may, split).alias("split_value"), (fan - F.coalesce("culled_kids", F.lit(0))).alias("split_cost"), F.when(F.col("whole") == 1, merge_factor * F.col("err") / F.col("siblings") * F.col("dens") * F.col("siblings")).alias("merge_value"))


def _sum(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Least value of two tables together for every number of nodes up to ``most`` beyond the fewest (min-plus)."""
    if not len(a) or not len(b):
        return np.zeros(0)
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    out = np.full(min(len(a) + len(b) - 1, most + 1), np.inf)
    for i, value in enumerate(short[: len(out)]):
        if np.isfinite(value):
            part = out[i : i + len(long)]
            np.minimum(part, value + long[: len(part)], out=part)
    return out


def _share(tables: list[np.ndarray], extra: int) -> list[int]:
    """How many of ``extra`` nodes each table gets where all of them together are least."""
    sums = [tables[0]]
    for t in tables[1:]:
        sums.append(_sum(sums[-1], t, extra))
    given = []
    for before, t in zip(reversed(sums[:-1]), reversed(tables[1:]), strict=True):
        j = np.arange(max(0, extra - len(before) + 1), min(len(t) - 1, extra) + 1)
        given.append(int(j[np.argmin(before[extra - j] + t[j])]))
        extra -= given[-1]
    return [extra, *reversed(given)]


def _member(none: float, split: float, cost: float) -> tuple[int, np.ndarray]:
    """Fewest nodes of one active node, and its table; NaN is what may not be done."""
    ways = [(1, none)] * (none == none) + [(int(cost), split)] * (split == split and cost == cost)
    if not ways:
        return 0, np.zeros(0)
    low = min(c for c, _ in ways)
    out = np.full(max(c for c, _ in ways) - low + 1, np.inf)
    for c, v in ways:
        out[c - low] = min(out[c - low], v)
    return low, out


def _family(rows, most: int) -> tuple[int, np.ndarray, int, list]:
    """Fewest nodes of a family, its table, the fewest without merging, and its members' (fewest, table)."""
    members = [_member(*x) for x in zip(rows["none_value"], rows["split_value"], rows["split_cost"], strict=True)]
    apart = sum(low for low, _ in members)
    out = members[0][1]
    for _, t in members[1:]:
        out = _sum(out, t, most)
    merged = rows["merge_value"].iloc[0]
    if merged != merged:
        return apart, out, apart, members
    low = min(apart, 1) if len(out) else 1
    table = np.full(max(apart + len(out) if len(out) else 0, 2) - low, np.inf)
    if len(out):
        table[apart - low : apart - low + len(out)] = out
    table[1 - low] = min(table[1 - low], merged)
    return low, table[: most + 1], apart, members


def _choices(rows, most: int):
    """Families of one block in order, with their tables."""
    for _, family in rows.sort_values(["family", "node_id"]).groupby("family", sort=True):
        yield family, _family(family, most)


def plan(options: DataFrame, budget: int, block: int = 64, fan_in: int = 16) -> DataFrame:
    """``node_id, action`` (none, split or merge) of least total value within the budget: an exact multiple-choice knapsack.

    A family's table holds its least value for every number of nodes. Tables of some ``block`` families are summed
    (min-plus) in a task, then ``fan_in`` sums in one, up to a single table; from there the nodes are dealt out again
    level by level, each task repeating the sums of its own group. A table holds no more entries than the budget
    leaves above the fewest nodes that all families need, so a task keeps at most ``fan_in`` times that number of
    doubles; the driver sees two counts. Of equal plans the one with fewer nodes is taken, then one by family and id.
    Values that are null or NaN may not be done; an empty table gives an empty plan. All rows of a family hold the
    same ``merge_value``, as ``family_options`` gives them.
    """
    spark = options.sparkSession
    rows = options.select("node_id", F.coalesce("parent_id", -1 - F.col("node_id")).alias("family"), *[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in ("none_value", "split_value", "split_cost", "merge_value")])
    own = F.least(F.when(F.col("none_value").isNotNull(), 1.0), F.when(F.col("split_value").isNotNull(), F.col("split_cost")))
    fewest = rows.groupBy("family").agg(F.when(F.count_if(own.isNull()) == 0, F.sum(own)).alias("apart"), F.first("merge_value").isNotNull().alias("merges")).select(F.least("apart", F.when(F.col("merges"), 1.0)).alias("least"))
    n, none, least = fewest.agg(F.count(F.lit(1)), F.count_if(F.col("least").isNull()), F.sum("least")).first()
    schema = "node_id long, action string"
    if not n:
        return spark.createDataFrame([], schema)
    if none or least > budget:
        raise ValueError("no plan fits the budget")
    most = int(budget - least)
    blocks = -(-n // block)
    rows = settled(rows.withColumn("block", F.pmod(F.xxhash64("family"), F.lit(blocks))))

    def first(key, part):
        total = np.zeros(1)
        for _, (_, table, _, _) in _choices(part, most):
            total = _sum(total, table, most)
        return pd.DataFrame({"block": [key[0]], "table": [total]})

    def together(key, part):
        total = np.zeros(1)
        for table in part.sort_values("block")["table"]:
            total = _sum(total, np.asarray(table), most)
        return pd.DataFrame({"block": [key[0]], "table": [total]})

    def deal(key, part):
        part = part.sort_values("block")
        given = _share([np.asarray(t) for t in part["table"]], int(part["extra"].iloc[0]))
        return pd.DataFrame({"block": part["block"], "extra": given})

    def act(key, part):
        families = list(_choices(part, most))
        ids, acts = [], []
        for (family, (low, _, apart, members)), extra in zip(families, _share([f[1][1] for f in families], int(part["extra"].iloc[0])), strict=True):
            ids += family["node_id"].tolist()
            merged, nodes = family["merge_value"].iloc[0], low + extra
            stay = np.zeros(1)
            for _, t in members:
                stay = _sum(stay, t, most)
            there = nodes - apart
            if nodes == 1 and merged == merged and not (0 <= there < len(stay) and stay[there] <= merged):
                acts += ["merge"] * len(family)
                continue
            for (fewest, table), more, kept, cost in zip(members, _share([t for _, t in members], there), family["none_value"], family["split_cost"], strict=True):
                acts.append("none" if kept == kept and fewest + more == 1 and not (cost == 1 and table[more] < kept) else "split")
        return pd.DataFrame({"node_id": ids, "action": acts})

    levels = [settled(rows.groupBy("block").applyInPandas(first, "block long, table array<double>"))]
    while blocks > 1:
        blocks = -(-blocks // fan_in)
        up = levels[-1].select("block", "table", F.floor(F.col("block") / fan_in).cast("long").alias("up"))
        levels.append(settled(up.groupBy("up").applyInPandas(together, "block long, table array<double>")))
    # the least value of all; where it comes twice, with fewer nodes
    given = levels.pop().select("block", (F.array_position("table", F.array_min("table")) - 1).cast("long").alias("extra"))
    for level in reversed(levels):
        part = level.withColumn("up", F.floor(F.col("block") / fan_in).cast("long")).join(given.withColumnRenamed("block", "up"), "up")
        given = settled(part.groupBy("up").applyInPandas(deal, "block long, extra long"))
    return rows.join(given, "block").groupBy("block").applyInPandas(act, schema)


def converged(new_loss: float, last_loss: float, epoch: int, every: int = 5, factor: float = 0.95) -> bool:
    """Whether the tree may be restructured now: at every k-th epoch, once the loss no longer falls by 5 per cent."""
    return epoch % every == 0 and not new_loss < last_loss * factor


def blend_moments(old: DataFrame, new: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Running mean of images: (1 - 1/n) * old + 1/n * new."""
    f = 1.0 - 1.0 / n
    return old.join(new.withColumnRenamed("value", "__new"), keys).withColumn("value", f * F.col("value") + (1 - f) * F.col("__new")).drop("__new")
