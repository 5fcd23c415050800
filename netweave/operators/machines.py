"""Linear machines of any number of subjects, fitted by sums.

Subjects stay in their partitions. At each Newton step a task adds up the loss, the gradient and the Hessian of its own
subjects, and one array a task and machine is shuffled. The driver holds the weights alone.

A machine of which one subject is left out is the machine of all subjects, updated, and only where that machine does not
settle its prediction:

* a subject beyond the margin has no part in the weights, so that they do not change without it;
* leaving a subject out never raises its own margin m, so that a wrong one stays wrong;
* the margin falls by no more than twice the shortfall 1 - m times the squared length of the subject's row, since the
  penalty makes the loss strongly convex.

Where these leave a subject open, a bound by the Hessian of the subjects that stay active settles all but those whose margin is within
some of that fall of 0 (``kernels.Solved.stays``): their share falls with the number of subjects. The others are updates.

An update needs the subjects near the margin alone (``kernels.Solved``). They are few, since leaving one of many out moves the weights
little: their number does not grow with the subjects. So all open subjects are one job, each in its partition. Clusters with more of
them than ``NEAR_CELLS`` hold, and subjects whose update leads out of the radius, are fitted in blocks of machines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave.functions import kernels
from netweave.sources.scratch import stored

#: Cells of the Hessians that a task sums at once, and machines that a step fits at once: bounds of a task's memory.
HESSIAN_CELLS = 8_000_000
MACHINES = 512
#: Cells of the subjects near the margin, of all clusters, that are sent to every task (16 MB); and the radius over the longest first step.
NEAR_CELLS, SPREAD = 2_000_000, 2.0
NEAR = kernels.NEAR


@dataclass
class Machine:
    """The machine of a cluster, without the subject ``left``: its weights (last the intercept) and where it is tried next."""

    path: str
    weights: np.ndarray
    left: object = None
    loss: float = np.inf
    step: np.ndarray | None = None
    scale: float = 1.0
    done: bool = False
    at: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.at = self.weights

    def take(self, loss: float, slope: float, least: float, step: list[float]) -> None:
        """What the sums at ``at`` say: goes there and on by ``step``, or half as far if the loss is higher there."""
        if loss <= self.loss * (1 + 1e-12):
            self.weights, self.loss, self.step, self.scale = self.at, loss, np.array(step), 1.0
            self.done = slope <= least
        else:
            self.scale /= 2
            self.done = self.scale < 1e-8
        self.at = self.weights - self.scale * self.step


def sides(batch: pd.DataFrame) -> Iterator[tuple[str, pd.DataFrame, np.ndarray, np.ndarray]]:
    """(path, rows, their values and a 1, -1 or 1 by label) of each cluster in a batch."""
    for path, rows in batch.groupby("path", sort=False):
        x = np.array(rows["values"].tolist(), float)
        yield path, rows, np.hstack([x, np.ones((len(x), 1))]), np.where(rows["label"] == 1, 1.0, -1.0)


def newton_steps(packed: DataFrame, machines: list[Machine], c: float) -> DataFrame:
    """(machine, loss, slope, least, step) at the points where the machines are tried; ``least`` is the slope of an optimum, by rounding."""
    points = [m.at for m in machines]
    left = {(m.path, m.left): k for k, m in enumerate(machines) if m.left is not None}
    own: dict[str, list[int]] = {}
    for k, m in enumerate(machines):
        own.setdefault(m.path, []).append(k)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for path, rows, a, y in sides(batch):
                if path not in own:
                    continue
                first = own[path][0]
                short = np.maximum(1 - y[:, None] * (a @ np.array([points[k] for k in own[path]]).T), 0)
                for i, subject in enumerate(rows["subject"]):
                    if (path, subject) in left:
                        short[i, left[path, subject] - first] = 0
                upper = np.triu_indices(a.shape[1])
                for j, k in enumerate(own[path]):
                    on = short[:, j] > 0
                    active, pull = a[on], (y * short[:, j])[on]
                    part = np.concatenate([[(pull**2).sum(), np.abs(pull).sum()], active.T @ pull, (active.T @ active)[upper]])
                    totals[k] = totals[k] + part if k in totals else part
        for k, total in totals.items():
            yield pd.DataFrame({"machine": [k], "sums": [total]})

    def solved(group: pd.DataFrame) -> pd.DataFrame:
        k, total = int(group["machine"].iloc[0]), group.sort_values("place")["value"].to_numpy()
        at = points[k]
        d = len(at)
        half = np.zeros((d, d))
        half[np.triu_indices(d)] = total[2 + d :]
        hessian = np.eye(d) + 2 * c * (half + np.triu(half, 1).T)
        gradient = at - 2 * c * total[2 : 2 + d]
        return pd.DataFrame({"machine": [k], "loss": 0.5 * at @ at + c * total[0], "slope": np.abs(gradient).max(), "least": 1e-9 + 1e-13 * total[1], "step": [np.linalg.solve(hessian, gradient)]})

    each = packed.mapInPandas(sums, "machine int, sums array<double>").select("machine", F.posexplode("sums").alias("place", "value"))
    added = each.groupBy("machine", "place").agg(F.sum("value").alias("value"))
    return added.groupBy("machine").applyInPandas(solved, "machine int, loss double, slope double, least double, step array<double>")


def fit(packed: DataFrame, machines: list[Machine], c: float = 1.0, steps: int = 100) -> None:
    """Fit ``machines``, those of a path one after another, to (path, subject, label, values); the loss is the squared hinge, ``c`` times."""
    for _ in range(steps):
        going = [m for m in machines if not m.done]
        if not going:
            return
        for row in newton_steps(packed, going, c).collect():  # a row a machine, of as many values as features
            going[row.machine].take(row.loss, row.slope, row.least, row.step)


def quadratics(rows: DataFrame, weights: dict[str, np.ndarray], c: float) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """The Hessian and the pull of the penalty and the active subjects among ``rows``, for each cluster that has weights.

    A task sends one array for each row of its sums; the driver holds a matrix of features by features a cluster.
    """

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for path, _, a, y in sides(batch):
                if path in weights:
                    on = y * (a @ weights[path]) < 1
                    part = np.hstack([a[on].T @ a[on], (a[on].T @ y[on])[:, None]])
                    totals[path] = totals[path] + part if path in totals else part
        for path, total in totals.items():
            yield pd.DataFrame({"path": path, "place": np.arange(len(total)), "sums": list(total)})

    def added(group: pd.DataFrame) -> pd.DataFrame:
        return group.iloc[:1].assign(sums=[np.sum(np.stack(group["sums"].to_list()), axis=0)])

    schema = "path string, place int, sums array<double>"
    found = {path: (np.eye(len(w)), np.zeros(len(w))) for path, w in weights.items()}
    for r in rows.select("path", "label", "values").mapInPandas(sums, schema).groupBy("path", "place").applyInPandas(added, schema).collect():  # a row a feature
        found[r.path][0][r.place] += 2 * c * np.array(r.sums[:-1])
        found[r.path][1][r.place] = 2 * c * r.sums[-1]
    return found


def updated(told: DataFrame, weights: dict[str, np.ndarray], c: float, near_cells: int, spread: float) -> DataFrame:
    """(path, subject, label, predicted, settled) of the unsure rows of ``told``, by updates of their clusters' machines; stored."""
    kind = told.schema["subject"].dataType.simpleString()
    schema = f"path string, subject {kind}, label int, predicted int, settled boolean"
    radii = stored(told.where("not sure").groupBy("path").agg((spread * F.max("reach")).alias("radius")))
    flagged = told.join(radii, "path").withColumn("near", F.col("gap") <= F.col("leverage") * F.col("radius") + NEAR)
    sizes = flagged.groupBy("path").agg(F.first("radius").alias("radius"), F.sum(F.when(F.col("near"), F.size("values") + 1).otherwise(0)).alias("cells")).orderBy("cells").collect()  # a row a cluster
    held = np.cumsum([r.cells for r in sizes]) <= near_cells
    chosen = {r.path: r.radius for r, fits in zip(sizes, held, strict=True) if fits and len(weights[r.path]) ** 2 <= HESSIAN_CELLS}
    own = flagged.where(F.col("path").isin(*chosen))
    fixed = quadratics(own.where("active and not near"), {path: weights[path] for path in chosen}, c)
    close = own.where("near").select("path", "subject", "label", "values").toPandas()  # at most ``near_cells`` cells
    near = {path: (a, y, {s: k for k, s in enumerate(rows["subject"])}) for path, rows, a, y in sides(close)}
    solved, places = {}, {}
    for path, radius in chosen.items():  # also those that have no subject near the margin
        a, y, places[path] = near.get(path, (np.empty((0, len(weights[path]))), np.empty(0), {}))
        solved[path] = kernels.Solved(weights[path], *fixed[path], a, y, radius, c)

    def left(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, rows, a, y in sides(batch):
                machine = solved.get(path)
                own = np.array([places[path].get(subject, -1) for subject in rows["subject"]]) if machine else np.full(len(rows), -1)
                stays = machine.stays(a, y, own) if machine else np.zeros(len(rows), bool)
                found = []
                for row, sign, place, stay in zip(a, y, own.tolist(), stays.tolist(), strict=True):
                    if stay:
                        found.append((int(sign > 0), True))
                        continue
                    v, settled = machine.without(row, sign, place) if machine else (row, False)
                    found.append((int(row @ v > 0), settled))
                yield rows[["path", "subject", "label"]].assign(predicted=[g for g, _ in found], settled=[s for _, s in found])

    return stored(told.where("not sure").select("path", "subject", "label", "values").mapInPandas(left, schema))


def judged(packed: DataFrame, loo: bool = False, c: float = 1.0, together: int = MACHINES, near_cells: int = NEAR_CELLS, spread: float = SPREAD) -> DataFrame:
    """(path, subject, label, predicted) of (path, subject, label, values): by the machine of all subjects of the path, or of all others.

    Labels are 0 and 1. Subjects of one class alone predict it; none predict 0. ``together`` bounds the machines of a step, ``near_cells``
    the cells of the subjects near the margin that updates take; results do not depend on them.
    """
    packed = stored(packed)
    counted = packed.groupBy("path").agg(F.count_if(F.col("label") == 1).alias("ones"), F.count_if(F.col("label") != 1).alias("others"), F.max(F.size("values")).alias("features")).collect()  # a row a cluster
    ones, others = {r.path: r.ones for r in counted}, {r.path: r.others for r in counted}
    whole = [Machine(r.path, np.zeros(r.features + 1)) for r in counted if r.ones and r.others]
    fit(packed, whole, c)
    weights = {m.path: m.weights for m in whole}
    kind = packed.schema["subject"].dataType.simpleString()
    inverses = {path: np.linalg.inv(h) for path, (h, _) in quadratics(packed, weights, c).items()} if loo else {}

    def predicted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, rows, a, y in sides(batch):
                alone = ones[path] + others[path] == 1
                margin, leverage, reach = np.zeros(len(rows)), np.zeros(len(rows)), np.zeros(len(rows))
                if path not in weights:
                    guess, sure = np.full(len(rows), int(bool(ones[path]) and not (loo and alone))), True
                else:
                    score = a @ weights[path]
                    margin = y * score
                    lost = 2 * c * (1 - margin) * (a * a).sum(axis=1)
                    last = np.where(y == 1, ones[path], others[path]) == 1
                    guess = (score > 0).astype(int)
                    if loo:
                        guess = np.where(last, y < 0, guess).astype(int)
                        leverage, reach = kernels.reaches(a, margin, inverses[path], c)
                    sure = not loo or (last | (margin > 1 + NEAR) | (margin < -NEAR) | (margin - lost > NEAR))
                told = rows[["path", "subject", "label"]].assign(predicted=guess)
                yield told.assign(values=rows["values"], sure=sure, active=margin < 1, gap=np.abs(1 - margin), leverage=leverage, reach=reach) if loo else told

    schema = f"path string, subject {kind}, label int, predicted int"
    if not loo:
        return packed.mapInPandas(predicted, schema)
    told = stored(packed.mapInPandas(predicted, f"{schema}, values array<double>, sure boolean, active boolean, gap double, leverage double, reach double"))
    found = told.where("sure").select("path", "subject", "label", "predicted")
    if not told.where("not sure").limit(1).count():
        return found
    tried = updated(told, weights, c, near_cells, spread)
    found = found.unionByName(tried.where("settled").drop("settled"))
    open_rows = packed.join(tried.where("not settled").select("path", "subject"), ["path", "subject"], "left_semi")
    return found.unionByName(fitted_anew(packed, open_rows, weights, c, together))


def fitted_anew(packed: DataFrame, open_rows: DataFrame, weights: dict[str, np.ndarray], c: float, together: int) -> DataFrame:
    """(path, subject, label, predicted) of ``open_rows``, each by a machine fitted without it, in blocks of about ``together`` machines."""
    kind = packed.schema["subject"].dataType.simpleString()
    schema = f"path string, subject {kind}, label int, predicted int"
    open_rows = stored(open_rows)
    n = open_rows.count()
    found = packed.sparkSession.createDataFrame([], schema)
    most = max(1, min(together, HESSIAN_CELLS // max((len(w) for w in weights.values()), default=1) ** 2))
    blocks = -(-n // most)
    for k in range(blocks):
        rows = open_rows.where(F.pmod(F.xxhash64("path", "subject"), F.lit(blocks)) == k).orderBy("path", "subject").collect()  # about ``most`` rows
        if rows:
            machines = [Machine(r.path, weights[r.path], r.subject) for r in rows]
            fit(packed, machines, c)
            guesses = [(r.path, r.subject, r.label, int(np.append(r["values"], 1.0) @ m.weights > 0)) for r, m in zip(rows, machines, strict=True)]
            found = found.unionByName(stored(packed.sparkSession.createDataFrame(guesses, schema)))
    return found
