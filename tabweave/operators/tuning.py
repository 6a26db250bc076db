"""Random search over several families of models, with bad draws dropped early."""

from __future__ import annotations

import json
import random
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml.base import Estimator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweave.operators.model import Frame, fit_all, score
from tabweave.operators.stacking import variant_table
from tabweave.operators.trees import Boost, Boosters, grows

#: Models whose scores go through one AUC pass.
TOGETHER = 20


@dataclass(frozen=True)
class Family:
    """A kind of model: a draw of its parameters, and the estimator for parameters and a number of rounds."""

    draw: Callable[[random.Random], dict]
    make: Callable[[dict, int], Estimator]


def _same_but_rounds(a: Estimator, b: Estimator) -> bool:
    settings = [{p.name: v for p, v in x.extractParamMap().items() if p.name != "maxIter"} for x in (a, b)]
    return type(a) is type(b) and settings[0] == settings[1]


def halving_search(frame: Frame, held: Column, families: dict[str, Family], n_draws: int, rungs: Sequence[int], seed: int = 42, cut: int = 3) -> DataFrame:
    """Draws scored by AUC on the rows ``held`` out: family, draw, rung, rounds, auc, n_held, n_positive, kept, params.

    Every family starts with ``n_draws`` seeded draws at the first rung's number of rounds; the best 1 / ``cut`` of a
    family go on to the next rung.  All fits of a rung share one pool and one written table, and are
    scored together, so the search costs little more than its survivors.  Boosters grow together, and those that go on
    grow from the trees they have: more rounds begin with the same trees.
    """
    spark = frame.data.sparkSession
    fit, hold = frame.train.filter(~held), frame.train.filter(held)
    table, places = frame.whole()
    table = table.filter(F.col("split") == "train")
    boosted: dict[tuple, tuple[Boosters, int]] = {}

    def fits(made: dict) -> dict:
        """Models of the estimators, by draw."""
        new = [a for a, est in made.items() if grows(est, table) and (a not in boosted or not _same_but_rounds(boosted[a][0].jobs[boosted[a][1]].estimator, est))]
        if new:
            grown = Boosters(table, [Boost(made[a], ~held, places) for a in new], pool=fit_all)
            boosted.update({a: (grown, i) for i, a in enumerate(new)})
        parts: dict[int, tuple[Boosters, list]] = {}
        for a in made:
            if a in boosted:
                parts.setdefault(id(boosted[a][0]), (boosted[a][0], []))[1].append(a)

        def together(grown: Boosters, some: list) -> list[tuple]:
            grown.grow({boosted[a][1]: made[a].getMaxIter() for a in some})
            return [*zip(some, grown.models([boosted[a][1] for a in some]), strict=True)]

        tasks = [lambda p=p: together(*p) for p in parts.values()] + [lambda a=a: [(a, made[a].fit(fit))] for a in made if a not in boosted]
        return dict(pair for pairs in fit_all(spark, tasks) for pair in pairs)

    alive = {(name, i): f.draw(random.Random(f"{seed}:{name}:{i}")) for name, f in families.items() for i in range(n_draws)}
    rows = []
    for rung, rounds in enumerate(rungs):
        at = list(alive)
        models = fits({a: families[a[0]].make(alive[a], rounds) for a in at})
        fitted = [models[a] for a in at]
        parts = [range(x, min(x + TOGETHER, len(at))) for x in range(0, len(at), TOGETHER)]
        tables = fit_all(spark, [lambda p=p: variant_table({str(x): score(fitted[x], hold, ["label"]) for x in p}).collect() for p in parts])
        found = {at[int(r["variant"])]: r for t in tables for r in t}
        kept = set()
        for name in families:
            mine = sorted((a for a in at if a[0] == name), key=lambda a: (-(found[a]["auc"] or 0.0), a[1]))
            kept.update(mine[: -(-len(mine) // cut)] if rung + 1 < len(rungs) else mine[:1])
        rows += [(*a, rung, rounds, found[a]["auc"], found[a]["n_pos"] + found[a]["n_neg"], found[a]["n_pos"], a in kept, json.dumps(alive[a], sort_keys=True)) for a in at]
        alive = {a: p for a, p in alive.items() if a in kept}
    schema = "family string, draw int, rung int, rounds int, auc double, n_held long, n_positive long, kept boolean, params string"
    return spark.createDataFrame(rows, schema).orderBy(F.desc("rung"), F.desc("auc"), "family", "draw")
