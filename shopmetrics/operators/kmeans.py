"""KMeans of many sizes and starts at once, one pass over the points for all of them.

The points are the distinct feature rows with their numbers of products, written
once. A pass reads them and moves the centres of every model that still moves: each
task adds up, for each centre of each model, the weight, the weighted coordinates
and the squared distances of its points, and one small aggregate joins the tasks'
sums. So a pass costs one scan for all sizes and restarts, and the driver holds
centres only.

Starts are seeded and don't depend on how rows are partitioned: the points with the
smallest hashes form a sample of at most ``SAMPLE`` (all points of small tables). Each
model draws centres from it one after the other, far points being likelier, and
refines them until they rest; every other start sees its own quarter of the
sample only, so that starts differ. Then come the passes over all points, until no
model's cost falls by more than ``TOLERANCE`` of itself. The sample serves the starts
only; results are of all points.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopmetrics.operators.score import scale_features
from shopmetrics.operators.silhouettes import Silhouette, euclidean_silhouettes
from shopmetrics.schema import SCALED_FEATURES
from shopmetrics.sources.staging import stage

SAMPLE = 4000
PART_FROM = 1000
ROUGH = 1e-5
ROUGH_PASSES = 10
KEPT = 3
TOLERANCE = 1e-9
MAX_PASSES = 300
# Points compared with all centres at once.
ROWS_AT_ONCE = 4096
_WEIGHT = "n_points"


@dataclass
class Model:
    """Centres of one size and start; ``sizes`` and ``cost`` are those of the last pass."""

    k: int
    centres: np.ndarray
    cost: float = np.inf
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0))
    passes: int = 0


def weighted_points(df: DataFrame) -> DataFrame:
    """Distinct scaled feature rows and how many products have each.

    Dealt to as many parts as shuffles have: passes cost far more than their few
    bytes let adaptive execution expect.
    """
    if SCALED_FEATURES[0] not in df.columns:
        df = scale_features(df)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = df.groupBy(*SCALED_FEATURES).agg(F.count(F.lit(1)).alias(_WEIGHT))
    return counted.repartition(parts)  # written before it is read, so never dealt twice


# --- one pass -----------------------------------------------------------------


def squared_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Of each point (row) to each centre (column)."""
    total = np.zeros((len(x), len(centres)))
    step = np.empty_like(total)
    for j in range(centres.shape[1]):
        np.subtract(x[:, j, None], centres[None, :, j], out=step)
        step *= step
        total += step
    return total


def _sums(x: np.ndarray, weight: np.ndarray, models: list[np.ndarray]) -> np.ndarray:
    """A row for each centre of the models in turn: weight, coordinates, squared distances."""
    every = np.concatenate(models)
    sums = np.zeros((len(every), x.shape[1] + 2))
    for low in range(0, len(x), ROWS_AT_ONCE):
        part, w = x[low : low + ROWS_AT_ONCE], weight[low : low + ROWS_AT_ONCE]
        distances = squared_distances(part, every)
        terms = [w, *(w * part[:, j] for j in range(x.shape[1]))]
        first = 0
        for centres in models:
            k = len(centres)
            own = distances[:, first : first + k]
            label = own.argmin(axis=1)
            for j, term in enumerate([*terms, w * own[np.arange(len(part)), label]]):
                sums[first : first + k, j] += np.bincount(label, term, k)
            first += k
    return sums


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    x = np.stack([batch.column(i).to_numpy() for i in range(len(SCALED_FEATURES))], axis=1)
    return x, batch.column(len(SCALED_FEATURES)).to_numpy().astype(float)


def _add_up(models: list[np.ndarray]):
    """Map task: the sums of its points, one row for each centre."""
    width = len(SCALED_FEATURES) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((sum(map(len, models)), width))
        for batch in batches:
            total += _sums(*_arrays(batch), models)
        yield pa.RecordBatch.from_pydict(
            {"centre": np.arange(len(total))} | {f"s{j}": total[:, j] for j in range(width)}
        )

    return run


def move_centres(points: DataFrame, models: list[Model]) -> None:
    """One pass: every model's centres move to the means of their points.

    A centre without points stays. ``cost`` and ``sizes`` become those of the
    centres before the move.
    """
    width = len(SCALED_FEATURES) + 2
    schema = "centre long, " + ", ".join(f"s{j} double" for j in range(width))
    rows = (
        points.select(*SCALED_FEATURES, _WEIGHT)
        .mapInArrow(_add_up([m.centres for m in models]), schema)
        .groupBy("centre")
        .agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(width)])
        .collect()  # one row for each centre
    )
    sums = np.array([list(r)[1:] for r in sorted(rows)])
    first = 0
    for model in models:
        own = sums[first : first + model.k]
        first += model.k
        model.sizes, model.cost = own[:, 0], float(own[:, -1].sum())
        held = model.sizes > 0
        model.centres = model.centres.copy()
        model.centres[held] = own[held, 1:-1] / own[held, :1]
        model.passes += 1


# --- starts -------------------------------------------------------------------


def _sample(points: DataFrame, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The points of smallest hash, in the order of their hashes."""
    rows = (
        points.orderBy(F.xxhash64(F.lit(seed), *SCALED_FEATURES), *SCALED_FEATURES)
        .limit(SAMPLE)
        .select(*SCALED_FEATURES, _WEIGHT)
        .collect()
    )
    values = np.array([list(r) for r in rows], dtype=float).reshape(len(rows), -1)
    return values[:, :-1], values[:, -1]


def _draw(
    x: np.ndarray, weight: np.ndarray, k: int, trials: int, rng: np.random.Generator
) -> np.ndarray:
    """k of the points, one after the other, by weight and squared distance to those drawn.

    Of ``trials`` points drawn for each place the one that leaves the least cost is kept.
    """
    chosen = [rng.choice(len(x), p=weight / weight.sum())]
    nearest = squared_distances(x, x[chosen])[:, 0]
    while len(chosen) < k:
        share = weight * nearest
        if not share.sum():
            break  # no other point is left
        drawn = rng.choice(len(x), size=trials, p=share / share.sum())
        after = np.minimum(nearest[:, None], squared_distances(x, x[drawn]))
        kept = int((weight @ after).argmin())
        chosen.append(drawn[kept])
        nearest = after[:, kept]
    return x[chosen]


def _refine(x: np.ndarray, weight: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Centres of the sample after they come to rest."""
    cost = np.inf
    for _ in range(MAX_PASSES):
        sums = _sums(x, weight, [centres])
        held = sums[:, 0] > 0
        centres = centres.copy()
        centres[held] = sums[held, 1:-1] / sums[held, :1]
        if sums[:, -1].sum() >= cost * (1 - TOLERANCE):
            break
        cost = sums[:, -1].sum()
    return centres


def starts(points: DataFrame, ks: list[int], seed: int, restarts: int) -> list[Model]:
    """Models of every size and restart; sizes beyond the number of points are left out."""
    x, weight = _sample(points, seed)
    spark = points.sparkSession

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, restart in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
                rng = np.random.default_rng([seed, k, restart])
                some, trials = slice(None), 2 + int(np.log(k))
                if restart % 2 and len(x) >= PART_FROM:
                    some, trials = rng.choice(len(x), len(x) // 4, replace=False), 1
                centres = _draw(x[some], weight[some], k, trials, rng)
                if len(centres) == k:
                    refined = _refine(x[some], weight[some], centres)
                    yield pa.RecordBatch.from_pydict(
                        {"k": [k], "restart": [restart], "centres": [refined.tolist()]}
                    )

    wanted = [(k, r) for k in ks for r in range(restarts)]
    if not len(x):
        return []
    tasks = spark.createDataFrame(wanted, "k long, restart long").repartition(len(wanted))
    found = tasks.mapInArrow(make, "k long, restart long, centres array<array<double>>")
    rows = sorted(found.collect())  # one row for each model
    return [Model(r.k, np.array(r.centres)) for r in rows]


# --- fits ---------------------------------------------------------------------


def fit(
    points: DataFrame, models: list[Model], tolerance: float = TOLERANCE, max_passes: int = MAX_PASSES
) -> list[Model]:
    """Move all models until their costs rest; each pass leaves out those that do."""
    moving = list(models)
    for _ in range(max_passes):
        if not moving:
            break
        before = [m.cost for m in moving]
        rest = [m.centres for m in moving]
        move_centres(points, moving)
        still = []
        for model, cost, centres in zip(moving, before, rest):
            if np.isinf(cost) or model.cost < cost * (1 - tolerance):
                still.append(model)
            else:  # the last pass measured these centres
                model.centres = centres
        moving = still
    return models


def from_starts(
    df: DataFrame, starts: list[list[list[float]]], passes: int
) -> tuple[DataFrame, list[Model]]:
    """The written points, and models with given centres after exactly so many moves."""
    points = stage(weighted_points(df), "points")
    models = [Model(len(centres), np.array(centres, dtype=float)) for centres in starts]
    for _ in range(passes):
        move_centres(points, models)
    rest = [m.centres for m in models]
    move_centres(points, models)  # measures the centres before it moves them
    for model, centres in zip(models, rest):
        model.centres = centres
    return points, models


def best_models(
    df: DataFrame, ks: list[int], seed: int, restarts: int
) -> tuple[DataFrame, dict[int, Model]]:
    """The written points, and the model of least cost for each size that has enough of them."""
    points = stage(weighted_points(df), "points")
    models = fit(points, starts(points, ks, seed, restarts), ROUGH, ROUGH_PASSES)
    ordered = sorted(models, key=lambda m: m.cost)
    kept = [m for k in ks for m in [m for m in ordered if m.k == k][:KEPT]]
    best: dict[int, Model] = {}
    for model in fit(points, kept):
        if model.k not in best or model.cost < best[model.k].cost:
            best[model.k] = model
    return points, best


# --- labels -------------------------------------------------------------------


def labelled_points(points: DataFrame, models: list[Model]) -> DataFrame:
    """The points with ``labels``, the nearest centre of each model; written."""
    centres = [m.centres for m in models]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, _ = _arrays(batch)
            labels = np.stack([squared_distances(x, c).argmin(axis=1) for c in centres], axis=1)
            offsets = np.arange(len(x) + 1) * len(centres)
            lists = pa.ListArray.from_arrays(
                pa.array(offsets.astype(np.int32)), pa.array(labels.ravel().astype(np.int32))
            )
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, lists], names=[*SCALED_FEATURES, _WEIGHT, "labels"]
            )

    schema = ", ".join(f"{n} double" for n in SCALED_FEATURES)
    found = points.select(*SCALED_FEATURES, _WEIGHT).mapInArrow(
        label, f"{schema}, {_WEIGHT} long, labels array<int>"
    )
    return stage(found, "labelled-points")


def silhouettes(points: DataFrame, models: list[Model]) -> list[Silhouette]:
    """Mean Euclidean silhouette of each model's segments, with its limits."""
    if not models:
        return []
    labelled = labelled_points(points, models)
    return euclidean_silhouettes(labelled, [m.k for m in models])
