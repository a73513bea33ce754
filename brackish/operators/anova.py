"""Additive two-factor models from cell statistics.

Raw rows are only ever summed: one aggregation gives n, sum and sum of squares per cell
(factor A by factor B), and everything else is computed from those cells, model by model,
in grouped tasks. Factors are calendar units and named regions, so cells are few.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brackish.functions.laws import f_tail, range_table, studentized_range_tail, t_quantile
from brackish.functions.text import p_label
from brackish.operators.attach import attach
from brackish.session import settle

LEVEL = 0.05  # fixed value: of the limits and of the comparison letters


def anova_cells(df: DataFrame, y: str, models: dict[str, tuple[str | Column, str | Column]]) -> DataFrame:
    """Cell statistics of every model: model, a, b, n, sum, sum of squares and maximum.

    ``models`` names the two factors of each model. All models are aggregated in one pass
    over the rows.
    """

    def factor(f):
        return (F.col(f) if isinstance(f, str) else f).cast("string")

    entries = F.array(
        *[
            F.struct(F.lit(name).alias("model"), factor(a).alias("a"), factor(b).alias("b"))
            for name, (a, b) in models.items()
        ]
    )
    long = df.select(F.col(y).cast("double").alias("y"), F.inline(entries)).dropna("any")
    return long.groupBy("model", "a", "b").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("y").alias("sum_y"),
        F.sum(F.col("y") * F.col("y")).alias("sum_y2"),
        F.max("y").alias("max_y"),
    )


def _levels(cells: pd.DataFrame, column: str) -> list[str]:
    return sorted(cells[column].unique())


def _design(cells: pd.DataFrame, a_levels: list[str], b_levels: list[str]) -> np.ndarray:
    """Intercept, then the levels of A and of B after the first, by cell."""
    a = cells["a"].to_numpy()[:, None] == np.array(a_levels[1:], dtype=object)[None, :]
    b = cells["b"].to_numpy()[:, None] == np.array(b_levels[1:], dtype=object)[None, :]
    return np.hstack([np.ones((len(cells), 1)), a, b]).astype(float)


def _residual_ss(x: np.ndarray, cells: pd.DataFrame) -> tuple[float, np.ndarray, np.ndarray]:
    """Residual sum of squares, coefficients and inverse normal matrix.

    The response is centred on its mean first, so that large means cost no precision.
    """
    n, s = cells["n"].to_numpy(float), cells["sum_y"].to_numpy(float)
    centre = s.sum() / n.sum()
    centred = s - n * centre
    total = float((cells["sum_y2"].to_numpy(float) - 2 * centre * s + n * centre**2).sum())
    inverse = np.linalg.pinv((x * n[:, None]).T @ x)
    beta = inverse @ (x.T @ centred)
    rss = total - float(beta @ (x.T @ centred))
    beta = beta.copy()
    beta[0] += centre
    return rss, beta, inverse


def _fit(cells: pd.DataFrame):
    a_levels, b_levels = _levels(cells, "a"), _levels(cells, "b")
    x = _design(cells, a_levels, b_levels)
    rss, beta, inverse = _residual_ss(x, cells)
    df_resid = int(cells["n"].sum()) - x.shape[1]
    return a_levels, b_levels, x, rss, beta, inverse, df_resid


ANOVA_SCHEMA = "model string, parameter string, sum_sq double, df int, f_value double, p_value double"


def _anova_table(cells: pd.DataFrame) -> pd.DataFrame:
    a_levels, b_levels, x, rss, _, _, df_resid = _fit(cells)
    split = len(a_levels)
    rss_a = _residual_ss(x[:, :split], cells)[0]
    rss_b = _residual_ss(np.hstack([x[:, :1], x[:, split:]]), cells)[0]
    rows = []
    for name, ss, df in (("a", rss_b - rss, len(a_levels) - 1), ("b", rss_a - rss, len(b_levels) - 1)):
        f = (ss / df) / (rss / df_resid) if df_resid > 0 and df > 0 and rss > 0 else float("nan")
        rows.append((cells["model"].iloc[0], name, ss, df, f, f_tail(f, df, df_resid)))
    rows.append((cells["model"].iloc[0], "Residuals", rss, df_resid, float("nan"), float("nan")))
    return pd.DataFrame(rows, columns=["model", "parameter", "sum_sq", "df", "f_value", "p_value"])


def anova2(cells: DataFrame, names: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Type II table of each model; ``names`` gives the factor names to show."""
    table = cells.groupBy("model").applyInPandas(_anova_table, ANOVA_SCHEMA)
    for c in ("f_value", "p_value"):
        table = table.withColumn(c, F.nullif(F.col(c), F.lit(float("nan"))))
    if names:
        shown = F.col("parameter")
        for model, (a, b) in names.items():
            here = F.col("model") == model
            shown = (
                F.when(here & (F.col("parameter") == "a"), a)
                .when(here & (F.col("parameter") == "b"), b)
                .otherwise(shown)
            )
        table = table.withColumn("parameter", shown)
    return table


def anova_stack(table: DataFrame) -> DataFrame:
    """The tables with p written out: '< 0.001' or four decimals."""
    return table.select(
        "parameter", "sum_sq", "df", "f_value", p_label(F.col("p_value")).alias("p_text"), "model"
    )


def partial_r2(table: DataFrame) -> DataFrame:
    """Share of each factor in what it and the residuals leave."""
    residual = table.filter("parameter = 'Residuals'").select("model", F.col("sum_sq").alias("__resid"))
    factors = table.filter("parameter <> 'Residuals'")
    joined = attach(factors, residual, ["model"], "inner")
    return joined.select(
        "model", "parameter", (F.col("sum_sq") / (F.col("sum_sq") + F.col("__resid"))).alias("partial_r2")
    )


COEFFICIENT_SCHEMA = "model string, a string, b string, fitted double"


def _fitted_cells(cells: pd.DataFrame) -> pd.DataFrame:
    _, _, x, _, beta, _, _ = _fit(cells)
    return cells[["model", "a", "b"]].assign(fitted=x @ beta)


def fitted_residuals(
    df: DataFrame, cells: DataFrame, y: str, model: str, a: str, b: str
) -> DataFrame:
    """Rows with the fitted value of their cell and the residual."""
    fitted = cells.filter(F.col("model") == model).groupBy("model").applyInPandas(_fitted_cells, COEFFICIENT_SCHEMA)
    keyed = df.dropna(subset=[y, a, b]).withColumns({"__a": F.col(a).cast("string"), "__b": F.col(b).cast("string")})
    table = fitted.select(F.col("a").alias("__a"), F.col("b").alias("__b"), "fitted")
    rows = attach(keyed, table, ["__a", "__b"], "inner").drop("__a", "__b")
    return rows.withColumn("resid", F.col(y) - F.col("fitted"))


MARGINAL_SCHEMA = (
    "model string, factor string, level string, emmean double, se double, df int, "
    "lower_cl double, upper_cl double, letters string, max_y double"
)


def compact_letters(different: np.ndarray) -> list[str]:
    """Letters such that two levels share one only if they do not differ.

    Start from one letter for all, split it for every differing pair, and drop a letter
    whose members all share another one.
    """
    k = len(different)
    columns = [frozenset(range(k))]
    for i in range(k):
        for j in range(i + 1, k):
            if not different[i, j]:
                continue
            split = []
            for c in columns:
                split += [c - {i}, c - {j}] if i in c and j in c else [c]
            unique = set(split)
            columns = [c for c in unique if not any(c < other for other in unique)]
    columns.sort(key=lambda c: sorted(c))
    alphabet = string.ascii_lowercase + string.ascii_uppercase
    # from the 53rd on a letter has a number, so that no name reads as two others
    names = [alphabet[i % 52] + (str(i // 52) if i >= 52 else "") for i in range(len(columns))]
    return ["".join(name for name, c in zip(names, columns) if i in c) for i in range(k)]


def _marginal_means(cells: pd.DataFrame) -> pd.DataFrame:
    a_levels, b_levels, x, rss, beta, inverse, df_resid = _fit(cells)
    covariance = inverse * rss / df_resid
    a_part, b_part = np.eye(len(a_levels))[:, 1:], np.eye(len(b_levels))[:, 1:]
    out = []
    for factor, levels in (("a", a_levels), ("b", b_levels)):
        own, other = (a_part, b_part) if factor == "a" else (b_part, a_part)
        rest = np.tile(other.mean(axis=0), (len(levels), 1))
        parts = [own, rest] if factor == "a" else [rest, own]
        contrast = np.hstack([np.ones((len(levels), 1)), *parts])
        means = contrast @ beta
        spread = contrast @ covariance @ contrast.T
        se = np.sqrt(np.clip(np.diag(spread), 0, None))
        variance = np.diag(spread)[:, None] + np.diag(spread)[None, :] - 2 * spread
        q = np.abs(means[:, None] - means[None, :]) * np.sqrt(2 / np.clip(variance, 1e-300, None))
        k = len(levels)
        table = range_table(k)
        order = np.argsort(means, kind="stable")
        different = np.zeros((k, k), dtype=bool)
        for i in range(k):
            for j in range(i):
                different[i, j] = different[j, i] = studentized_range_tail(q[i, j], table, df_resid) < LEVEL
        ranked = compact_letters(different[np.ix_(order, order)])
        letters = [""] * k
        for position, original in enumerate(order):
            letters[original] = ranked[position]
        reach = t_quantile(LEVEL / 2, df_resid) * se
        top = cells.groupby(factor)["max_y"].max().reindex(levels).to_numpy()
        out.append(
            pd.DataFrame(
                {
                    "model": cells["model"].iloc[0],
                    "factor": factor,
                    "level": levels,
                    "emmean": means,
                    "se": se,
                    "df": df_resid,
                    "lower_cl": means - reach,
                    "upper_cl": means + reach,
                    "letters": letters,
                    "max_y": top,
                }
            )
        )
    return pd.concat(out)


def marginal_means(cells: DataFrame) -> DataFrame:
    """Marginal mean of every level, the other factor weighted equally, with 95 % limits,
    letters of the pairwise comparison (Tukey) and the largest observed value."""
    return cells.groupBy("model").applyInPandas(_marginal_means, MARGINAL_SCHEMA)


def recent_labels(df: DataFrame, columns: Sequence[str], year: str = "year", recent: Sequence[int] = (2020, 2021)) -> DataFrame:
    """Add ``{c}_recent``: the year itself for recent years, else the column's own label."""

    def label(c):
        expr = F.col(c).cast("string")
        for y in recent:
            expr = F.when(F.col(year) == y, str(y)).otherwise(expr)
        return expr

    return df.withColumns({f"{c}_recent": label(c) for c in columns})


def year_attributes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct attribute rows of a table."""
    return df.select(*columns).distinct()


def settled_cells(df: DataFrame, y: str, models: dict) -> DataFrame:
    """Cell statistics written once for the several tables drawn from them."""
    return settle(anova_cells(df, y, models), "cells")
