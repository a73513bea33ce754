"""Straight-line regression by group, from Spark's own sums."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brackish.functions.laws import f_tail, t_tail
from brackish.functions.strict import is_member, positive_log, strict_avg, strict_sd
from brackish.operators.attach import attach
from brackish.operators.reshape import lengthen

# Taxa modelled on the raw scale. The second is spelt so in the list this
# follows, so the taxon "Limnoithona tetraspina Adult" is modelled on the log scale.
RAW_SCALE_TAXA = ("Acartiella sinensis Adult", "Lomnoithona tetraspina Adult")


def taxa_long(matrix: DataFrame, years: DataFrame, year: str = "year", index: str = "index") -> DataFrame:
    """Taxa matrix by year joined to the year table and unpivoted.

    The index is standardised over the years of the matrix before the unpivot, so each
    year counts once. One missing year makes all standardised values missing.
    """
    taxa = [c for c in matrix.columns if c != year]
    joined = attach(matrix, years, [year])
    mean = joined.select(strict_avg(index)).scalar()
    spread = joined.select(strict_sd(index)).scalar()
    scaled = joined.withColumn(f"{index}_s", (F.col(index) - mean) / spread)
    return lengthen(scaled, taxa, "taxa", "bpue")


def response(taxa: Column, bpue: Column, raw_scale: Sequence[str] = RAW_SCALE_TAXA) -> Column:
    """Log response, except for the taxa kept on the raw scale."""
    return F.when(is_member(taxa, raw_scale), bpue).otherwise(positive_log(bpue))


def grouped_lm(df: DataFrame, keys: Sequence[str], y: str, x: str) -> DataFrame:
    """Least squares of y on x per group with its usual summary.

    Pairs with a missing member are left out. One aggregation with map-side sums; the rest
    is arithmetic on one row per group.
    """
    sums = df.groupBy(*keys).agg(
        F.regr_count(y, x).alias("n"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
        F.regr_sxx(y, x).alias("sxx"),
        F.regr_sxy(y, x).alias("sxy"),
        F.regr_syy(y, x).alias("syy"),
        F.regr_avgx(y, x).alias("avgx"),
    )
    df_resid = F.col("n") - 2
    zero = F.lit(0.0)
    variance = F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), zero) / F.nullif(df_resid, F.lit(0))
    fitted = sums.withColumns({"df_resid": df_resid, "sigma": F.sqrt(variance)}).filter("df_resid >= 0")
    n, sxx, sigma = F.col("n"), F.nullif(F.col("sxx"), zero), F.col("sigma")
    errors = fitted.withColumns(
        {
            "se_slope": sigma / F.sqrt(sxx),
            "se_intercept": sigma * F.sqrt(1 / n + F.col("avgx") * F.col("avgx") / sxx),
            "adj_r2": 1 - (1 - F.col("r2")) * (n - 1) / F.nullif(F.col("df_resid"), F.lit(0)),
        }
    )
    return errors.withColumns(
        {
            "t_slope": F.col("slope") / F.nullif(F.col("se_slope"), zero),
            "t_intercept": F.col("intercept") / F.nullif(F.col("se_intercept"), zero),
        }
    ).withColumn("f_value", F.col("t_slope") * F.col("t_slope")).drop("avgx")


def with_p_values(models: DataFrame) -> DataFrame:
    """Two-sided p of each coefficient and p of F, on the one-row-per-group summary."""

    @F.pandas_udf("double")
    def p_t(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([2 * t_tail(abs(a), b) for a, b in zip(t, df)])

    @F.pandas_udf("double")
    def p_f(f: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([f_tail(a, 1, b) for a, b in zip(f, df)])

    return models.withColumns(
        {
            "p_slope": p_t("t_slope", "df_resid"),
            "p_intercept": p_t("t_intercept", "df_resid"),
            "p_f": p_f("f_value", "df_resid"),
        }
    )


def lm_residuals(df: DataFrame, models: DataFrame, keys: Sequence[str], y: str, x: str) -> DataFrame:
    """Observed minus fitted for every complete pair."""
    line = models.select(*keys, "slope", "intercept")
    rows = attach(df.dropna(subset=[y, x]), line, keys, "inner")
    resid = F.col(y) - (F.col("intercept") + F.col("slope") * F.col(x))
    return rows.withColumn("resid", resid).drop("slope", "intercept")
