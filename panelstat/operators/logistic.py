"""Cross-fitted logistic main-effects models of many drugs at once, fitted on counted cells.

A cell is a combination of covariate levels, its model an indicator per level. Every (group, drug,
left-out fold) has its own coefficients. A Newton step is one keyed aggregate over the cells: counts
outside a fold are a cell's totals less the fold's own, so a cell's row serves all folds and drugs, and
tasks add up score and information per pair of levels before they send them. The step from zero is the
least-squares fit; Newton steps follow until no fitted count is off by more than `TOLERANCE`.

A task solves the systems of one (group, drug). Two levels of the same covariate never meet, so the
covariate with most levels has a diagonal block: it is eliminated first and only the levels of the others
make a dense matrix. Memory is that of levels x other levels, whatever the number of isolates or cells.
Coefficients travel to the tasks in groups of drugs whose table stays within `MAX_BROADCAST_BYTES`.

Fitted sums reproduce the observed ones for every level outside the left-out fold.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelstat import session

MAX_BROADCAST_BYTES = 64 << 20
MAX_ITER = 30
TOLERANCE = 1e-4  # of a fitted count; the step that follows makes it smaller still
MAX_STEP = 4.0
BATCH = 512
HELD_PAIRS = 20_000  # pairs of levels a task adds up before it sends them


@dataclass(frozen=True)
class Levels:
    """Numbers of the levels of all groups: (group, "position=level") -> number."""

    numbers: dict[tuple, int]
    covariate: np.ndarray  # of each level
    group: np.ndarray  # number of each level's group
    groups: list[tuple]

    @classmethod
    def of(cls, cells: DataFrame, keys: list[str]) -> Levels:
        """The distinct levels, which are as many as there are coefficients per model."""
        parts = F.posexplode(F.split("cell", r"\|")).alias("at", "level")
        rows = cells.select(*keys, parts).distinct().collect()
        groups = sorted({tuple(r[k] for k in keys) for r in rows}, key=str)
        which = {g: i for i, g in enumerate(groups)}
        found = sorted(rows, key=lambda r: (which[tuple(r[k] for k in keys)], r["at"], r["level"]))
        numbers = {(*(r[k] for k in keys), r["at"], r["level"]): i for i, r in enumerate(found)}
        return cls(
            numbers, np.array([r["at"] for r in found], int), np.array([which[tuple(r[k] for k in keys)] for r in found], int), groups
        )

    def codes(self, batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
        columns = [batch.column(k).to_pylist() for k in keys]
        return np.array(
            [
                [self.numbers[(*key, at, level)] for at, level in enumerate(cell.split("|"))]
                for cell, *key in zip(batch.column("cell").to_pylist(), *columns)
            ],
            int,
        )


@dataclass(frozen=True)
class Model:
    """Coefficients (levels x folds) per drug."""

    levels: Levels
    folds: int
    beta: dict[str, np.ndarray] = field(default_factory=dict)
    iterations: int = 0
    unsettled: frozenset = frozenset()  # (group, drug) that still moved


def fold_array(value, folds: int, fold: str = "fold"):
    """array<double>: the sum of a column in each fold."""
    return F.array(*[F.coalesce(F.sum(F.when(F.col(fold) == h, F.col(value))), F.lit(0)).cast("double") for h in range(folds)])


def cell_rows(rows: DataFrame, keys: list[str], drug: str, n: str, y: str, carried: list[str], everyone: DataFrame | None = None, folds: int = 5) -> DataFrame:
    """One row per (keys, cell) with `items`, an array of (drug, fold, n, y, carried), and `everyone`.

    ``rows`` has the counts per (keys, drug, fold, cell); ``everyone`` (keys, fold, cell, n_all) gives all
    drugs the same counts, cells without a row of the drug included. Items are as many as drugs x folds.
    """
    item = F.struct(
        F.col(drug).alias("drug"), "fold", *([F.col(n).cast("double").alias("n")] if n else []), F.col(y).cast("double").alias("y"), *carried
    )
    out = rows.groupBy(*keys, "cell").agg(F.collect_list(item).alias("items"))
    if everyone is None:
        return out
    counts = everyone.groupBy(*keys, "cell").agg(fold_array("n_all", folds).alias("everyone"))
    same = [F.col(f"e.{k}").eqNullSafe(F.col(f"o.{k}")) for k in (*keys, "cell")]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return counts.alias("e").join(out.alias("o"), on, "left").select(*[f"e.{k}" for k in keys], "e.cell", "e.everyone", "o.items")


class _Cells:
    """Counts of a batch of cells as arrays: `n` and `y` outside each fold, cells x drugs x folds."""

    def __init__(self, batch: pa.RecordBatch, drugs: list[str], folds: int):
        size = batch.num_rows
        items = batch.column("items")  # null in cells without a row
        self.of = np.repeat(np.arange(size), np.asarray(pc.fill_null(pc.list_value_length(items), 0)))
        self.flat = items.flatten()
        number = pc.index_in(self.flat.field("drug"), value_set=pa.array(drugs, pa.string()))
        self.drug = np.asarray(pc.fill_null(number, -1))
        self.fold = np.asarray(self.flat.field("fold"))
        known = self.drug >= 0
        at = (self.of[known], self.drug[known], self.fold[known])

        def outside(values: pa.Array) -> np.ndarray:
            out = np.zeros((size, len(drugs), folds))
            out[at] = np.asarray(values)[known]
            return out.sum(axis=2, keepdims=True) - out

        self.y = outside(self.flat.field("y"))
        if "everyone" in batch.schema.names:
            each = np.array(batch.column("everyone").to_pylist(), float).reshape(size, 1, folds)
            self.n = np.broadcast_to(each.sum(axis=2, keepdims=True) - each, self.y.shape)
        else:
            self.n = outside(self.flat.field("n"))


def _probability(beta: np.ndarray, codes: np.ndarray) -> np.ndarray:
    eta = beta[codes[:, 0]].copy()
    for at in range(1, codes.shape[1]):
        eta += beta[codes[:, at]]
    return 1 / (1 + np.exp(-np.clip(eta, -500, 500)))


def _sums(keys: list[str], drugs: list[str], folds: int, state):
    """Cells to sums per (drug, level, level): the score where the second is -1, else the information."""

    def run(batches):
        levels, beta = state.value
        held: dict[tuple[int, int], np.ndarray] = {}

        def send():
            pairs = np.array(list(held), int).reshape(-1, 2)
            values = np.array(list(held.values())).reshape(len(held), len(drugs), folds)
            pair, drug = np.nonzero(values.any(axis=2))
            arrays = [pa.array(x, pa.int32()) for x in (levels.group[pairs[pair, 0]], drug, pairs[pair, 0], pairs[pair, 1])]
            arrays += [pa.array(values[pair, drug, h]) for h in range(folds)]
            held.clear()
            return pa.RecordBatch.from_arrays(arrays, ["group", "drug", "f1", "f2", *(f"v{h}" for h in range(folds))])

        def add(f1, f2, values):
            joint, of = np.unique(np.stack([f1, f2]), axis=1, return_inverse=True)
            sums = np.zeros((joint.shape[1], *values.shape[1:]))
            np.add.at(sums, of.ravel(), values)
            for pair, value in zip(map(tuple, joint.T.tolist()), sums):
                held[pair] = held[pair] + value if pair in held else value

        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                codes, cells = levels.codes(batch, keys), _Cells(batch, drugs, folds)
                p = _probability(beta, codes)
                score, info = cells.y - cells.n * p, cells.n * p * (1 - p)
                for i in range(codes.shape[1]):
                    add(codes[:, i], np.full(len(codes), -1), score)
                    for j in range(i, codes.shape[1]):
                        add(codes[:, i], codes[:, j], info)
                if len(held) > HELD_PAIRS:
                    yield send()
        yield send()

    return run


def newton_step(info: np.ndarray, score: np.ndarray, covariate: np.ndarray) -> np.ndarray:
    """Solves the system of indicator levels: the covariate with most levels is diagonal and goes first.

    Levels without information keep still. Where levels are redundant the smallest step is taken.
    """
    live = np.diag(info) > 1e-10
    step = np.zeros(len(score))
    counts = Counter(covariate[live].tolist())
    if not counts:
        return step
    most = max(counts, key=lambda c: (counts[c], -c))
    first, rest = np.flatnonzero(live & (covariate == most)), np.flatnonzero(live & (covariate != most))
    a = np.diag(info)[first]
    cross = info[np.ix_(first, rest)]
    if len(rest):
        dense = info[np.ix_(rest, rest)] - cross.T @ (cross / a[:, None])
        step[rest] = np.linalg.lstsq(dense, score[rest] - cross.T @ (score[first] / a), rcond=1e-9)[0]
    step[first] = (score[first] - cross @ step[rest]) / a
    return step


def _solver(folds: int, covariate: np.ndarray):
    values = [f"v{h}" for h in range(folds)]

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        names = np.unique(rows["f1"])
        at = {f: i for i, f in enumerate(names)}
        is_score = (rows["f2"] == -1).to_numpy()
        s, g = rows[is_score], rows[~is_score]
        first, second = g["f1"].map(at).to_numpy(int), g["f2"].map(at).to_numpy(int)
        steps, largest = np.zeros((len(names), folds)), 0.0
        for h, v in enumerate(values):
            score, info = np.zeros(len(names)), np.zeros((len(names), len(names)))
            score[s["f1"].map(at).to_numpy(int)] = s[v]
            info[first, second] = g[v]
            info[second, first] = g[v]
            step = newton_step(info, score, covariate[names])
            size = np.abs(step).max(initial=0.0)
            steps[:, h] = step * min(1.0, MAX_STEP / size) if size else step
            largest = max(largest, np.abs(score).max(initial=0.0))
        out = {"group": rows["group"].iloc[0], "drug": rows["drug"].iloc[0], "f": names, "largest": largest}
        return pd.DataFrame(out | {f"v{h}": steps[:, h] for h in range(folds)})[["group", "drug", "f", *values, "largest"]]

    return solve


def fit(cells: DataFrame, keys: list[str], drugs: list[str], folds: int, max_iter: int = MAX_ITER) -> Model:
    """The models of all drugs on :func:`cell_rows`, which are read once a step. Runs a job a step."""
    spark = cells.sparkSession
    levels = Levels.of(cells, keys)
    size = len(levels.covariate)
    at_once = max(1, MAX_BROADCAST_BYTES // max(1, 8 * size * folds))
    model, unsettled, steps = {}, set(), 0
    schema = "group int, drug int, f1 int, f2 int, " + ", ".join(f"v{h} double" for h in range(folds))
    solved_schema = "group int, drug int, f int, " + ", ".join(f"v{h} double" for h in range(folds)) + ", largest double"
    for begin in range(0, len(drugs), at_once):
        some = drugs[begin : begin + at_once]
        beta = np.zeros((size, len(some), folds))
        for step in range(1, max_iter + 1):
            state = spark.sparkContext.broadcast((levels, beta))
            sums = cells.mapInArrow(_sums(keys, some, folds, state), schema)
            sums = sums.groupBy("group", "drug", "f1", "f2").agg(*[F.sum(f"v{h}").alias(f"v{h}") for h in range(folds)])
            solved = sums.groupBy("group", "drug").applyInPandas(_solver(folds, levels.covariate), solved_schema)
            rows = solved.toPandas()  # a row per drug and level
            state.destroy()
            beta = beta.copy()
            beta[rows["f"], rows["drug"]] += rows[[f"v{h}" for h in range(folds)]].to_numpy()
            steps = max(steps, step)
            moving = rows[~(rows["largest"] < TOLERANCE)]
            if moving.empty:
                break
        else:
            unsettled |= {(levels.groups[g], some[d]) for g, d in zip(moving["group"], moving["drug"])}
        model |= {drug: beta[:, i] for i, drug in enumerate(some)}
    return Model(levels, folds, model, steps, frozenset(unsettled))


def predict(cells: DataFrame, keys: list[str], model: Model, drug: str, carried: list[str], out: str = "p") -> DataFrame:
    """(keys, drug, fold, cell, carried, out): each item's probability by the model that leaves its fold out."""
    return _mapped(cells, keys, model, drug, carried, out, everywhere=False)


def predict_everywhere(cells: DataFrame, keys: list[str], model: Model, drug: str, out: str = "p") -> DataFrame:
    """(keys, drug, fold, cell, n, out): every model in every cell, with the counts outside its fold."""
    return _mapped(cells, keys, model, drug, [], out, everywhere=True)


def _mapped(cells: DataFrame, keys: list[str], model: Model, drug: str, carried: list[str], out: str, everywhere: bool) -> DataFrame:
    spark = cells.sparkSession
    item = cells.schema["items"].dataType.elementType
    names = sorted(model.beta)
    per = max(1, MAX_BROADCAST_BYTES // max(1, 8 * len(model.levels.covariate) * model.folds))
    extra = ["n"] if everywhere else carried
    fields = [*[cells.schema[k] for k in keys], T.StructField(drug, T.StringType()), T.StructField("fold", T.IntegerType()), T.StructField("cell", T.StringType())]
    fields += [T.StructField("n", T.DoubleType())] if everywhere else [item[c] for c in carried]
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in [*fields, T.StructField(out, T.DoubleType())]])
    parts = []
    for begin in range(0, len(names), per):
        some = names[begin : begin + per]
        beta = np.stack([model.beta[d] for d in some], axis=1)
        state = spark.sparkContext.broadcast((model.levels, beta))
        parts.append(cells.mapInArrow(_predictor(keys, some, model.folds, state, extra, [*keys, drug, "fold", "cell", *extra, out], everywhere), schema))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _predictor(keys, drugs, folds, state, extra, names, everywhere):
    def run(batches):
        levels, beta = state.value
        for whole in batches:
            for begin in range(0, whole.num_rows, BATCH):
                batch = whole.slice(begin, BATCH)
                cells = _Cells(batch, drugs, folds)
                p = _probability(beta, levels.codes(batch, keys))
                if everywhere:
                    row, drug, fold = (x.ravel() for x in np.indices(p.shape))
                    values = [pa.array(cells.n[row, drug, fold])]
                else:
                    known = np.flatnonzero(cells.drug >= 0)
                    row, drug, fold = cells.of[known], cells.drug[known], cells.fold[known]
                    values = [cells.flat.field(c).take(pa.array(known)) for c in extra]
                at = pa.array(row)
                columns = [batch.column(k).take(at) for k in keys]
                columns += [pa.array(drugs, pa.string()).take(pa.array(drug)), pa.array(fold, pa.int32()), batch.column("cell").take(at), *values]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(p[row, drug, fold])], names)

    return run


def cross_fitted(
    rows: DataFrame, keys: list[str], drug: str, n: str, y: str, carried: list[str], folds: int, out: str, everyone: DataFrame | None = None
) -> DataFrame:
    """(keys, drug, fold, cell, carried, out) for every row: its probability by a model that left its fold out."""
    cells = session.checkpoint(cell_rows(rows, keys, drug, n, y, carried, everyone, folds))
    drugs = sorted(r[0] for r in rows.select(drug).distinct().collect())
    if not drugs:
        return rows.select(*keys, drug, "fold", "cell", *carried, F.lit(None).cast("double").alias(out))
    return predict(cells, keys, fit(cells, keys, drugs, folds), drug, carried, out)
