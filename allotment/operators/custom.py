"""User-defined utilities over batches of coalitions, also along paths that stop early."""

from __future__ import annotations

from typing import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from allotment.operators.skew import Split, large
from allotment.operators.utilities import SAMPLE, BatchUtility
from allotment.sources.shared import cut

#: Paths that one call of a utility sees at a time; each keeps its members and a few numbers.
CHUNK = 512


def apply_batches(coalitions: DataFrame, utility: Callable[[pd.DataFrame], pd.Series], keys: list[str]) -> DataFrame:
    """Call `utility` on Arrow batches of coalition rows; it returns one number per row, in order."""
    schema = ", ".join(f"{k} {dict(coalitions.dtypes)[k]}" for k in keys) + ", value DOUBLE"

    def task(batches):
        for pdf in batches:
            value = pd.Series(utility(pdf), dtype="float64")
            if len(value) != len(pdf):
                raise ValueError("the utility must return one value per coalition")
            yield pdf[keys].assign(value=value.to_numpy())

    return coalitions.mapInPandas(task, schema)


def require_finite(values: DataFrame) -> DataFrame:
    """Fail on a missing, NaN or infinite utility; a bad value never turns into 0."""
    bad = F.col("value").isNull() | F.isnan("value") | (F.abs(F.col("value")) == float("inf"))
    return values.withColumn("value", F.when(bad, F.raise_error(F.lit("a utility is not finite")).cast("double")).otherwise(F.col("value")))


def _lists(keys: list[str], rows: DataFrame, utility: BatchUtility, chosen: Column, order: str) -> DataFrame:
    """A coalition per key: members and what they bring, in the order of `order`."""
    own = F.struct(F.col(order).alias("_at"), "player", *utility.columns)
    made = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(chosen, own))).alias("_own"))
    return made.select(*keys, F.col("_own.player").alias("members"), *[F.col(f"_own.{c}").alias(c) for c in utility.columns])


def _valued(coalitions: DataFrame, utility: BatchUtility, keys: list[str]) -> DataFrame:
    """The values, written once: shares and ledgers read them, and the utility is not called again."""
    return cut(require_finite(apply_batches(coalitions, utility.call, keys)), "values")


def evaluate_coalitions(sampled: Split, utility: BatchUtility, with_rest: bool) -> Split:
    """`evaluate` for a utility of whole coalitions: a coalition is one row, valued once, and joined back."""
    rows = sampled.rows()
    out = rows.join(large(_valued(_lists(SAMPLE, rows, utility, F.col("inside"), "player"), utility, SAMPLE)), SAMPLE)
    if with_rest:
        rest = _valued(_lists(SAMPLE, rows, utility, ~F.col("inside"), "player"), utility, SAMPLE)
        out = out.join(large(rest.withColumnRenamed("value", "rest")), SAMPLE)
    return Split(out)


def evaluate_boundary(players: Split, utility: BatchUtility) -> Split:
    """`boundary` for a utility of whole coalitions: 2n + 2 coalitions per game, made of one row with all players."""
    rows = players.rows()
    whole = _lists(["game_id"], rows, utility, F.lit(True), "player")
    n = F.size("members")
    kinds = F.concat(F.array(F.struct(F.lit("empty").alias("kind"), F.lit(-1).alias("at")), F.struct(F.lit("full").alias("kind"), F.lit(-1).alias("at"))),
                     F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array(
                         F.struct(F.lit("single").alias("kind"), i.alias("at")), F.struct(F.lit("without").alias("kind"), i.alias("at"))))))
    cells = whole.select("*", F.explode(kinds).alias("cell")).select("*", "cell.kind", "cell.at")
    taken = lambda i: F.when(F.col("kind") == "full", True).when(F.col("kind") == "single", i == F.col("at")).when(
        F.col("kind") == "without", i != F.col("at")).otherwise(False)
    names = ["members", *utility.columns]
    cells = cells.select("game_id", "kind", F.when(F.col("at") >= 0, F.get("members", F.col("at"))).alias("player"),
                         *[F.filter(F.col(c), lambda x, i: taken(i)).alias(c) for c in names])
    valued = _valued(cells, utility, ["game_id", "kind", "player"])
    pick = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("value")))
    own = valued.where("player is not null").groupBy("game_id", "player").agg(pick("single").alias("single_value"), pick("without").alias("without_value"))
    ends = valued.where("player is null").groupBy("game_id").agg(pick("empty").alias("empty_value"), pick("full").alias("full_value"))
    return Split(rows.join(ends, "game_id").join(large(own), ["game_id", "player"]))


def evaluate_marginals(draws: DataFrame, players: DataFrame, utility: BatchUtility) -> DataFrame:
    """`marginal_values` for a utility of whole coalitions: predecessors with and without the player are two rows."""
    keys = ["game_id", "player", "size", "draw"]
    sides = draws.select(*keys, F.inline(F.array(F.struct(F.lit(0).alias("side"), F.col("predecessors").alias("set")),
                                                 F.struct(F.lit(1).alias("side"), F.array_append("predecessors", F.col("player")).alias("set")))))
    members = sides.select("game_id", F.col("player").alias("of"), "size", "draw", "side", F.explode_outer("set").alias("player"))
    rows = members.join(large(players.select("game_id", "player", *utility.columns)), ["game_id", "player"], "left")
    named = ["game_id", "of", "size", "draw", "side"]
    valued = _valued(_lists(named, rows, utility, F.col("player").isNotNull(), "player"), utility, named).withColumnRenamed("of", "player")
    pick = lambda side: F.max(F.when(F.col("side") == side, F.col("value")))
    both = valued.groupBy(*keys).agg(pick(1).alias("with_value"), pick(0).alias("without_value"))
    return both.join(large(players.select("game_id", "player", "n")), ["game_id", "player"])


def evaluate_paths(paths: Split, utility: BatchUtility, tolerance: float | None = None, relative: bool = True, patience: int = 5) -> Split:
    """`path_values` for a utility of whole coalitions, and with a tolerance `truncate_paths` whose calls really stop.

    A permutation is one row with its players in order. A task takes CHUNK permutations and values their prefixes place by place,
    one call of the utility for all that still run; each keeps its last value and how many prefixes in a row were near
    v(all). With a tolerance a permutation leaves after patience + 1 of them, and the utility is not called for it again; later
    players get the marginal 0, `evaluated` is false and `stop` tells where. v(empty) and v(all) are taken from the boundary.
    """
    rows = paths.rows()
    ends = ["empty_value", "full_value"]
    whole = _lists([*SAMPLE, *ends], rows, utility, F.lit(True), "pos")
    types = dict(rows.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in SAMPLE) + ", player INT, before DOUBLE, value DOUBLE, marginal DOUBLE, evaluated BOOLEAN, stop INT"
    names = ["members", *utility.columns]

    def walked(part: pd.DataFrame) -> pd.DataFrame:
        lists = {c: [list(x) for x in part[c]] for c in names}
        n = np.array([len(x) for x in lists["members"]])
        full = part["full_value"].to_numpy(float)
        value = np.full((len(part), n.max() + 1), np.nan)
        value[:, 0] = part["empty_value"]
        near, stop = np.zeros(len(part), dtype=int), np.zeros(len(part), dtype=int)
        slack = None if tolerance is None else tolerance * np.abs(full) if relative else np.full(len(part), tolerance)
        for at in range(1, n.max() + 1):
            value[(n == at) & (stop == 0), at] = full[(n == at) & (stop == 0)]
            run = np.flatnonzero((n > at) & (stop == 0))
            if len(run):
                seen = part.iloc[run][SAMPLE].assign(**{c: [lists[c][i][:at] for i in run] for c in names})
                got = np.asarray(utility.call(seen.reset_index(drop=True)), dtype=float)
                if len(got) != len(run):
                    raise ValueError("the utility must return one value per coalition")
                if not np.isfinite(got).all():
                    raise ValueError("a utility is not finite")
                value[run, at] = got
            if slack is not None:
                alive = (n >= at) & (stop == 0)
                near = np.where(np.abs(full - value[:, at]) <= slack, near + 1, 0)
                stop[alive & (near > patience)] = at
        own = np.repeat(np.arange(len(part)), n)
        place = np.concatenate([np.arange(1, k + 1) for k in n])
        told = (stop[own] == 0) | (place <= stop[own])
        before, after = value[own, place - 1], value[own, place]
        return part.iloc[own][SAMPLE].assign(
            player=np.concatenate([np.asarray(x) for x in lists["members"]]).astype(np.int32), before=before, value=after,
            marginal=np.where(told, after - before, 0.0), evaluated=told, stop=pd.array(np.where(stop[own] > 0, stop[own], -1), dtype="Int32")).replace({"stop": {-1: None}})

    def task(batches):
        for pdf in batches:
            for first in range(0, len(pdf), CHUNK):
                yield walked(pdf.iloc[first:first + CHUNK])

    carried = [c for c in rows.columns if c not in ("before", "value", "marginal", "evaluated", "stop")]
    return Split(rows.select(*carried).join(large(cut(whole.mapInPandas(task, schema), "paths")), [*SAMPLE, "player"]))
