"""Penalised spline surfaces with random intercepts, from summed cross-products.

A model per group (any number of key columns): biomass (log1p) on a smooth surface of salinity (cubic) and day of year
(cyclic), plus random intercepts for years and stations. A first pass places each group's knots at quantiles of its distinct
values and lists its years; a second one sums cross-products, batch by batch, in the tasks that read the rows, for the
group and for each of its stations at once. Stations may be many, so their intercepts are eliminated station by station,
for a few candidate variances at once, and summed as well. What is left per group is a small system: the 20 surface
weights and the calendar years. Smoothing is chosen by restricted likelihood over a grid.

A fit carries its knots and years, so predictions need nothing but the fits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brackish.operators.attach import attach
from brackish.operators.quantiles import exact_quantiles
from brackish.session import settle

# Knots per direction, number and seed of posterior draws.
KNOTS = 5
DRAWS = 1000
SEED = 999
STATION_RIDGE = tuple(10.0**e for e in range(-2, 5))
LOG_RIDGES = np.arange(-4.0, 7.0)


# --- bases ----------------------------------------------------------------------------


def _second_derivatives(h: np.ndarray, cyclic: bool) -> tuple[np.ndarray, np.ndarray]:
    """Map from knot values to second derivatives there, and the bending penalty."""
    k = len(h) if cyclic else len(h) + 1
    d = np.zeros((k, k))
    b = np.eye(k)
    rows = range(k) if cyclic else range(1, k - 1)
    for i in rows:
        before, after = (i - 1) % k, (i + 1) % k
        hb, ha = h[i - 1], h[i % len(h)]
        b[i, i] = (hb + ha) / 3
        b[i, before] += hb / 6
        b[i, after] += ha / 6
        d[i, before] += 1 / hb
        d[i, i] -= 1 / hb + 1 / ha
        d[i, after] += 1 / ha
    f = np.linalg.solve(b, d)
    return f, d.T @ f


@dataclass(frozen=True)
class Spline:
    """Cubic spline through its values at the knots ``at``; natural, or joined at the ends."""

    at: tuple[float, ...]
    cyclic: bool = False

    @classmethod
    def even(cls, low: float, high: float, knots: int = KNOTS, cyclic: bool = False) -> Spline:
        return cls(tuple(np.linspace(low, high, knots).tolist()), cyclic)

    @property
    def low(self) -> float:
        return self.at[0]

    @property
    def high(self) -> float:
        return self.at[-1]

    @property
    def size(self) -> int:
        return len(self.at) - 1 if self.cyclic else len(self.at)

    def _parts(self):
        at = np.array(self.at)
        h = np.diff(at)
        return at, h, *_second_derivatives(h, self.cyclic)

    def basis(self, x: np.ndarray) -> np.ndarray:
        at, h, f, _ = self._parts()
        x = np.asarray(x, float)
        if self.cyclic:
            x = self.low + np.mod(x - self.low, self.high - self.low)
        inside = np.clip(x, self.low, self.high)
        j = np.clip(np.searchsorted(at, inside, side="right") - 1, 0, len(h) - 1)
        width, right, left = h[j], at[j + 1] - inside, inside - at[j]
        unit = np.eye(self.size)
        nxt = (j + 1) % self.size if self.cyclic else j + 1
        values = (right / width)[:, None] * unit[j] + (left / width)[:, None] * unit[nxt]
        bend = ((right**3 / width - width * right) / 6)[:, None] * f[j]
        bend += ((left**3 / width - width * left) / 6)[:, None] * f[nxt]
        out = values + bend
        beyond = x - inside  # straight on outside the knots
        if np.any(beyond != 0):
            edge = np.where(beyond < 0, 0, len(h) - 1)
            w = h[edge]
            slope = (unit[edge + 1] - unit[edge]) / w[:, None]
            at_left = -(w / 3)[:, None] * f[edge] - (w / 6)[:, None] * f[edge + 1]
            at_right = (w / 6)[:, None] * f[edge] + (w / 3)[:, None] * f[edge + 1]
            slope = slope + np.where((beyond < 0)[:, None], at_left, at_right)
            out = out + beyond[:, None] * slope
        return out

    def penalty(self) -> np.ndarray:
        s = self._parts()[3]
        # A small pull on level and slope too, so that a useless direction can vanish.
        return s / np.linalg.norm(s, 2) + 1e-3 * np.eye(self.size) * (0 if self.cyclic else 1)


@dataclass(frozen=True)
class Surface:
    """The bases of a group's model and its years."""

    salinity: Spline
    day: Spline
    years: tuple[int, ...] = ()

    @classmethod
    def of(cls, row) -> Surface:
        """From the columns sal_knots, day_knots and years of a fit or a design."""
        knots = [tuple(float(v) for v in row[c]) for c in ("sal_knots", "day_knots")]
        return cls(Spline(knots[0]), Spline(knots[1], cyclic=True), tuple(int(y) for y in row["years"]))

    @property
    def terms(self) -> int:
        return self.salinity.size * self.day.size

    @property
    def size(self) -> int:
        return self.terms + len(self.years)

    def basis(self, salinity: np.ndarray, day: np.ndarray) -> np.ndarray:
        s, d = self.salinity.basis(salinity), self.day.basis(day)
        return (s[:, :, None] * d[:, None, :]).reshape(len(s), -1)

    def design(self, salinity, day, year) -> np.ndarray:
        dummies = np.asarray(year)[:, None] == np.array(self.years)[None, :]
        return np.hstack([self.basis(salinity, day), dummies.astype(float)])

    def penalties(self) -> list[np.ndarray]:
        """Salinity, day and year penalties over the whole coefficient vector."""
        s, d = self.salinity.penalty(), self.day.penalty()
        parts = [np.kron(s, np.eye(len(d))), np.kron(np.eye(len(s)), d)]
        out = []
        for p in parts:
            whole = np.zeros((self.size, self.size))
            whole[: self.terms, : self.terms] = p
            out.append(whole)
        years = np.zeros((self.size, self.size))
        years[self.terms :, self.terms :] = np.eye(len(self.years))
        return [*out, years]


DESIGN = ("sal_knots", "day_knots", "years")


def _struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


# --- knots ----------------------------------------------------------------------------


def place_knots(rows: DataFrame, keys: Sequence[str], column: str, knots: int = KNOTS, name: str = "knots") -> DataFrame:
    """(keys, name): knots of each group at even quantiles of its distinct values, the ends at the smallest and largest.

    A group with fewer distinct values than knots gets even ones over its range, or over a unit range if it has but one.
    """
    keys = list(keys)
    values = settle(rows.select(*keys, F.col(column).cast("double").alias("__x")).dropna(subset=["__x"]).distinct(), "values")
    quantiles = exact_quantiles(values, keys, "__x", {f"__k{i}": i / (knots - 1) for i in range(knots)})
    count = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    low, width = F.col("__k0"), F.col(f"__k{knots - 1}") - F.col("__k0")
    width = F.when(width > 0, width).otherwise(1.0)
    even = F.array(*[low + width * (i / (knots - 1)) for i in range(knots)])
    placed = F.when(F.col("__n") >= knots, F.array(*[F.col(f"__k{i}") for i in range(knots)])).otherwise(even)
    return attach(quantiles, count, keys, "inner").select(*keys, placed.alias(name))


def surface_design(rows: DataFrame, keys: Sequence[str], x: tuple[str, str], knots: int = KNOTS) -> DataFrame:
    """(keys, sal_knots, day_knots, years) of each group; the years of a calendar are few."""
    keys = list(keys)
    years = rows.groupBy(*keys).agg(F.array_sort(F.collect_set("year")).alias("years"))
    for column, name in zip(x, ("sal_knots", "day_knots")):
        years = attach(years, place_knots(rows, keys, column, knots, name), keys, "inner")
    return years.select(*keys, "sal_knots", "day_knots", "years")


# --- sums over rows -------------------------------------------------------------------


def _sum_arrays(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Element-wise sum of arrays per key; a key has an array, or a few, for each task that made them."""
    held = df.groupBy(*keys).agg(F.collect_list(column).alias("__all"))
    total = F.aggregate(
        F.slice("__all", 2, F.size("__all")), F.col("__all")[0], lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    )
    return held.select(*keys, total.alias(column))


def _fields(df: DataFrame, columns: Sequence[str]) -> list[T.StructField]:
    return [T.StructField(c, df.schema[c].dataType) for c in columns]


def batch_groups(batch: pd.DataFrame, keys: Sequence[str]) -> Iterator[tuple[tuple, np.ndarray]]:
    """Key and row numbers of each group in a batch, missing keys among them."""
    codes = batch.groupby(list(keys), dropna=False, sort=False).ngroup().to_numpy()
    for code in np.unique(codes):
        at = np.flatnonzero(codes == code)
        yield tuple(None if pd.isna(v) else v for v in batch[list(keys)].iloc[at[0]]), at


GROUP, STATION = 0, 1
HELD = 50_000  # rows of station sums that a task holds, some megabytes


def _by_station(names: pa.Array, sums: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Each station once, with the sum of its rows."""
    coded = names.dictionary_encode()
    codes = coded.indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    starts = np.searchsorted(codes[order], np.arange(len(coded.dictionary)))
    return coded.dictionary, np.add.reduceat(sums[order], starts)


def arrow_groups(batch: pa.RecordBatch, keys: Sequence[str]) -> Iterator[tuple[tuple, np.ndarray]]:
    """Key and row numbers of each group in a batch, missing keys among them."""
    codes = np.zeros(batch.num_rows, np.int64)
    for k in keys:
        coded = batch.column(k).dictionary_encode(null_encoding="encode")
        codes = codes * max(1, len(coded.dictionary)) + coded.indices.to_numpy()
        codes = np.unique(codes, return_inverse=True)[1]
    order = np.argsort(codes, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(codes[order])) + 1) if len(order) else ():
        yield tuple(batch.column(k)[int(at[0])].as_py() for k in keys), at


def surface_sums(
    rows: DataFrame, design: DataFrame, keys: Sequence[str], x: tuple[str, str], y: str, most: int = HELD
) -> DataFrame:
    """(keys, kind, station, sums) in one pass: of each group the cross-product of design, response and one, as one flat
    array, and of each of its stations their column sums.

    Narrow rows are dealt by group and station, large ones over several tasks. So a task hands on a row of sums for about each
    station that it met; it holds ``most`` of them at once. Spark adds up what several tasks found.
    """
    keys = list(keys)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: dict[tuple, np.ndarray] = {}
        surfaces: dict[tuple, Surface] = {}
        held: dict[tuple, list] = {}
        count, types = 0, []

        def table(found, kind, station, sums):
            columns = [pa.array([key[i] for key in found], t) for i, t in enumerate(types)]
            lists = pa.ListArray.from_arrays(np.arange(len(sums) + 1, dtype=np.int32) * sums.shape[1], pa.array(sums.ravel()))
            kinds = pa.array(np.full(len(sums), kind, np.int32))
            return pa.RecordBatch.from_arrays([*columns, kinds, station, lists], [*keys, "kind", "station", "sums"])

        def settled():
            for key, parts in held.items():
                names, sums = _by_station(pa.concat_arrays([n for n, _ in parts]), np.vstack([v for _, v in parts]))
                yield key, names, sums

        for batch in batches:
            types = [batch.schema.field(k).type for k in keys]
            first, second, year, response = (batch.column(c).to_numpy() for c in ("__x0", "__x1", "year", "__y"))
            for key, at in arrow_groups(batch, keys):
                if key not in surfaces:
                    surfaces[key] = Surface.of({c: batch.column(c)[int(at[0])].as_py() for c in DESIGN})
                bases = surfaces[key].design(first[at], second[at], year[at])
                full = np.hstack([bases, response[at][:, None], np.ones((len(at), 1))])
                whole[key] = whole.get(key, 0) + full.T @ full
                held.setdefault(key, []).append(_by_station(batch.column("station").take(pa.array(at)), full))
                count += len(held[key][-1][0])
            if count > most:
                held = {key: [(names, sums)] for key, names, sums in settled()}
                count = sum(len(parts[0][0]) for parts in held.values())
                if 2 * count > most:
                    for key, [(names, sums)] in held.items():
                        yield table([key] * len(names), STATION, names, sums)
                    held, count = {}, 0
        for key, names, sums in settled():
            yield table([key] * len(names), STATION, names, sums)
        for key, m in whole.items():
            yield table([key], GROUP, pa.array([None], pa.string()), m.reshape(1, -1))

    numbers = [F.col(c).cast("double").alias(n) for c, n in zip((*x, y), ("__x0", "__x1", "__y"))]
    narrow = rows.select(*keys, F.col("station").cast("string").alias("station"), "year", *numbers)
    dealt = narrow.dropna(subset=["station", "year", "__x0", "__x1", "__y"]).hint("rebalance", *keys, "station")
    schema = T.StructType([*_fields(rows, keys), *_struct("kind int, station string, sums array<double>").fields])
    return _sum_arrays(attach(dealt, design, keys, "inner").mapInArrow(partial, schema), [*keys, "kind", "station"], "sums")


def station_corrections(stations: DataFrame, keys: Sequence[str], ridges: Sequence[float] = STATION_RIDGE) -> DataFrame:
    """Per group and candidate ridge: what eliminating the station intercepts subtracts.

    The array ends with the sum of log(n + ridge) over stations and their number.
    """
    keys = list(keys)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for key, at in batch_groups(batch, keys):
                u = np.vstack(batch["sums"].iloc[at].to_numpy())
                n = u[:, -1]
                for r in ridges:
                    outer = (u / (n + r)[:, None]).T @ u
                    tail = [np.log(n + r).sum(), float(len(u))]
                    held[(key, r)] = held.get((key, r), 0) + np.concatenate([outer.ravel(), tail])
        if held:
            found = pd.DataFrame([k for k, _ in held], columns=keys, dtype=object)
            yield found.assign(ridge=[r for _, r in held], sums=list(held.values()))

    schema = T.StructType([*_fields(stations, keys), *_struct("ridge double, sums array<double>").fields])
    return _sum_arrays(stations.select(*keys, "sums").mapInPandas(partial, schema), [*keys, "ridge"], "sums")


# --- small solves -----------------------------------------------------------------------


def _log_pseudo_det(s: np.ndarray) -> float:
    values = np.linalg.eigvalsh(s)
    keep = values > values.max() * 1e-10 if len(values) else []
    return float(np.log(values[keep]).sum())


def _restricted_score(xx, xy, yy, n, penalty, log_det_extra):
    """Minus twice the restricted log-likelihood (up to a constant), and the solution."""
    a = xx + penalty
    a = a + np.eye(len(a)) * 1e-9 * np.trace(xx) / len(a)
    chol = np.linalg.cholesky(a)
    beta = np.linalg.solve(chol.T, np.linalg.solve(chol, xy))
    free = len(a) - np.linalg.matrix_rank(penalty, tol=1e-8 * np.abs(penalty).max()) if penalty.any() else len(a)
    dof = max(n - free, 1.0)
    deviance = max(yy - float(beta @ xy), 1e-12)
    score = dof * np.log(deviance / dof) + 2 * np.log(np.diag(chol)).sum() - _log_pseudo_det(penalty) + log_det_extra
    return score, beta, chol, deviance / dof


def _choose(xx, xy, yy, n, penalties, extra):
    """Coordinate search of the ridge exponents on a grid, until the score has settled."""
    logs = np.ones(len(penalties)) * 2.0

    def at(logs):
        return _restricted_score(xx, xy, yy, n, sum(10.0**e * p for e, p in zip(logs, penalties)), extra)

    best = at(logs)
    while True:  # ends, since every sweep but the last lowers the score on a finite grid
        before = best[0]
        for i in range(len(penalties)):
            for e in LOG_RIDGES:
                trial = logs.copy()
                trial[i] = e
                candidate = at(trial)
                if candidate[0] < best[0] - 1e-9:
                    best, logs = candidate, trial
        if before - best[0] < 1e-6:
            return best, logs


SURFACE_SCHEMA = (
    "n double, stations double, sigma2 double, log_ridges array<double>, station_ridge double, beta array<double>, "
    "covariance array<double>, centre array<double>, sal_knots array<double>, day_knots array<double>, years array<int>"
)


def response_surface(
    rows: DataFrame,
    keys: Sequence[str] = ("ibmr",),
    x: tuple[str, str] = ("salsurf", "doy"),
    y: str = "bpue_log1p",
    knots: int = KNOTS,
) -> DataFrame:
    """Fit the surface of every group: weights, their covariance, the mean basis row, the knots and the years.

    ``rows`` has the keys, station, year, both predictors and the response; rows that lack one of these are left out, a missing
    key is a key. A group with a single station gets no station intercepts. The input is settled once; what is read twice
    is the settled columns.
    """
    keys = list(keys)
    wanted = [F.col("station").cast("string").alias("station"), F.col("year").cast("int").alias("year"), *x, y]
    rows = settle(rows.select(*keys, *wanted).dropna(subset=["station", "year", *x, y]), "surface-rows")
    design = settle(surface_design(rows, keys, x, knots), "surface-design")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        surface = Surface.of(pdf.iloc[0])
        size, terms, penalties = surface.size, surface.terms, surface.penalties()
        whole = np.array(pdf.loc[pdf["ridge"].isna(), "sums"].iloc[0]).reshape(size + 2, size + 2)
        n = whole[-1, -1]
        best = None
        for ridge, sums in zip(pdf["ridge"], pdf["sums"]):
            if np.isnan(ridge):
                continue
            sums = np.array(sums)
            stations = sums[-1]
            m, extra = whole, 0.0
            if stations > 1:
                m = whole - sums[:-2].reshape(size + 2, size + 2)
                extra = sums[-2] - stations * np.log(ridge)
            fit, logs = _choose(m[:size, :size], m[:size, size], m[size, size], n, penalties, extra)
            if best is None or fit[0] < best[0][0]:
                best = (fit, logs, ridge if stations > 1 else float("nan"), stations)
            if stations <= 1:
                break
        (_, beta, chol, sigma2), logs, ridge, stations = best
        inverse = np.linalg.inv(chol)
        covariance = (inverse.T @ inverse) * sigma2
        found = pdf[keys].iloc[:1].reset_index(drop=True)
        values = {
            "n": n, "stations": stations, "sigma2": sigma2, "log_ridges": logs, "station_ridge": ridge, "beta": beta[:terms],
            "covariance": covariance[:terms, :terms].ravel(), "centre": whole[-1, :terms] / n,
            "sal_knots": list(surface.salinity.at), "day_knots": list(surface.day.at), "years": list(surface.years),
        }
        return found.assign(**{name: [value] for name, value in values.items()})

    sums = settle(surface_sums(rows, design, keys, x, y), "surface-sums")
    whole = sums.where(F.col("kind") == GROUP).select(*keys, F.lit(None).cast("double").alias("ridge"), "sums")
    parts = whole.unionByName(station_corrections(sums.where(F.col("kind") == STATION), keys))
    schema = T.StructType([*_fields(rows, keys), *_struct(SURFACE_SCHEMA).fields])
    # The sums are few but their solves are not: by number, so that small partitions are not put together.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return attach(parts, design, keys, "inner").repartition(tasks, *keys).groupBy(*keys).applyInPandas(solve, schema)



def surface_terms(
    grid: DataFrame, fits: DataFrame, keys: Sequence[str] = ("ibmr",), x: tuple[str, str] = ("salsurf", "doy")
) -> DataFrame:
    """Centred surface and its standard error on a grid that has the keys and both predictors."""
    keys, columns = list(keys), grid.columns

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fit, se = np.empty(len(batch)), np.empty(len(batch))
            for _, at in batch_groups(batch, keys):
                part, model = batch.iloc[at], batch.iloc[at[0]]
                surface = Surface.of(model)
                b = surface.basis(part[x[0]].to_numpy(float), part[x[1]].to_numpy(float)) - np.asarray(model["centre"])
                v = np.asarray(model["covariance"]).reshape(surface.terms, surface.terms)
                fit[at] = b @ np.asarray(model["beta"])
                se[at] = np.sqrt(np.clip(np.einsum("ij,jk,ik->i", b, v, b), 0, None))
            yield batch[columns].assign(fit=fit, se=se)

    joined = attach(grid, fits.select(*keys, "beta", "covariance", "centre", *DESIGN), keys, "inner")
    schema = T.StructType([*grid.schema, T.StructField("fit", T.DoubleType()), T.StructField("se", T.DoubleType())])
    return joined.mapInPandas(predict, schema)


def coefficient_draws(model, n: int, seed: int) -> np.ndarray:
    """Weights by draws of a fit's normal posterior, seeded by its keys (``group_hash``): the same wherever they are made."""
    beta = np.asarray(model["beta"])
    values, vectors = np.linalg.eigh(np.asarray(model["covariance"]).reshape(len(beta), len(beta)))
    root = vectors * np.sqrt(np.clip(values, 0, None))
    rng = np.random.default_rng([seed, int(model["group_hash"]) & 0x7FFFFFFF])
    return beta[:, None] + root @ rng.standard_normal((len(beta), n))


def with_fits(rows: DataFrame, fits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with what draws of their group need: 20 weights, their covariance and the knots."""
    model = fits.select(*keys, "beta", "covariance", *DESIGN, F.hash(*keys).alias("group_hash"))
    return attach(rows, model, list(keys), "inner")


def posterior_draws(
    grid: DataFrame,
    fits: DataFrame,
    keys: Sequence[str] = ("ibmr",),
    x: tuple[str, str] = ("salsurf", "doy"),
    n: int = DRAWS,
    seed: int = SEED,
) -> DataFrame:
    """Draws of the surface (random intercepts left out) at each grid row, as an array.

    Weights are drawn from their normal posterior with a seed per group, so the rows of a
    group agree on the draws wherever they are computed.
    """
    keys, columns = list(keys), grid.columns

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights: dict = {}
        for batch in batches:
            draws = np.empty((len(batch), n))
            for key, at in batch_groups(batch, keys):
                part, model = batch.iloc[at], batch.iloc[at[0]]
                if key not in weights:
                    weights[key] = coefficient_draws(model, n, seed)
                b = Surface.of(model).basis(part[x[0]].to_numpy(float), part[x[1]].to_numpy(float))
                draws[at] = b @ weights[key]
            yield batch[columns].assign(draws=list(draws))

    schema = T.StructType([*grid.schema, T.StructField("draws", T.ArrayType(T.DoubleType()))])
    return with_fits(grid, fits, keys).mapInPandas(predict, schema)


# --- one dimension ------------------------------------------------------------------------


def smooth_curves(df: DataFrame, keys: Sequence[str], x: str, y: str, knots: int = 25, steps: int = 80) -> DataFrame:
    """Penalised cubic spline of y on x per group, on an even grid over the group's x range.

    The knots of a group lie at quantiles of its distinct x.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"))
    rows = settle(rows.dropna(subset=["__x", "__y"]), "curve-rows")
    design = settle(place_knots(rows, keys, "__x", knots), "curve-knots")
    key_fields = _fields(df, keys)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for key, at in batch_groups(batch, keys):
                part = batch.iloc[at]
                b = Spline(tuple(part["knots"].iloc[0])).basis(part["__x"].to_numpy())
                full = np.hstack([b, part["__y"].to_numpy()[:, None], np.ones((len(part), 1))])
                held[key] = held.get(key, 0) + full.T @ full
        if held:
            yield pd.DataFrame(list(held), columns=keys, dtype=object).assign(sums=[m.ravel() for m in held.values()])

    made = T.StructType([*key_fields, T.StructField("sums", T.ArrayType(T.DoubleType()))])
    sums = _sum_arrays(attach(rows, design, keys, "inner").mapInPandas(partial, made), keys, "sums")
    moments = attach(sums, design, keys, "inner")

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i in range(len(batch)):
                row = batch.iloc[i]
                spline = Spline(tuple(row["knots"]))
                m = np.array(row["sums"]).reshape(knots + 2, knots + 2)
                scale = np.sqrt(max(m[knots, knots] / m[-1, -1], 1e-300))
                m[knots, :] /= scale
                m[:, knots] /= scale
                fit, _ = _choose(m[:knots, :knots], m[:knots, knots], m[knots, knots], m[-1, -1], [spline.penalty()], 0.0)
                _, beta, chol, sigma2 = fit
                at = np.linspace(spline.low, spline.high, steps)
                b = spline.basis(at)
                half = np.linalg.solve(chol, b.T)
                part = pd.DataFrame([[row[k] for k in keys]] * steps, columns=keys, dtype=object)
                part["x"], part["fit"] = at, b @ beta * scale
                part["se"] = np.sqrt(np.clip((half**2).sum(axis=0) * sigma2, 0, None)) * scale
                out.append(part)
            if out:
                yield pd.concat(out)

    fields = [T.StructField(c, T.DoubleType()) for c in ("x", "fit", "se")]
    return moments.mapInPandas(solve, T.StructType([*key_fields, *fields]))
