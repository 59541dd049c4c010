"""Unit-root, level and white-noise tests of long series, from lagged cross-products.

A series is cut into blocks of rows; each block also gets the last rows of the one
before, so all products of values up to a number of lags apart are sums over blocks.
The regressions of the tests need these sums alone: their normal matrices are added
up over the blocks, and the first rows, which shorter lags use as well, are few.

The Dickey-Fuller regression has a constant and the number of lags with the least AIC
of those up to 12 (n / 100) ** (1 / 4); its p-value is MacKinnon's polynomial.  The
KPSS test is about a level, its number of lags that of Hobijn, Franses and Ooms.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.sources.staging import staged

#: Rows of a block, at least.
SPAN = 10_000
#: Lags of the white-noise test's first round, and how many times more each further round takes.
FIRST_LAGS, MORE_LAGS = 64, 8
#: MacKinnon's polynomials of the p-value for a constant, below and above TAU, and the bounds beyond which it is 0 or 1.
SMALL_P, LARGE_P = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)
TAU, TAU_LEAST, TAU_MOST = -1.61, -18.83, 2.74
#: Critical values of the KPSS statistic and their p-values.
KPSS_AT, KPSS_P = (0.347, 0.463, 0.574, 0.739), (0.10, 0.05, 0.025, 0.01)
SIGNIFICANT = 0.05
#: The verdicts by whether the first and the second test say stationary.
VERDICTS = {(False, False): "Not Stationary", (False, True): "Trend Stationary", (True, False): "Difference Stationary", (True, True): "Stationary"}
CONSTANT, TOO_SHORT = "Constant Data", "Not Enough Data for stationarity test"


def most_lags(n: int) -> int:
    return min(n // 2 - 2, math.ceil(12 * (n / 100) ** 0.25))


def kpss_lags(n: int) -> int:
    """As many lags as a series without negative correlations can ask for."""
    first = int(n ** (2 / 9))
    return min(n - 1, int(1.1447 * ((first + 1) / 2) ** (2 / 3) * n ** (1 / 3)) + 2)


def numbered_series(df: DataFrame, group: list[str], source: str, order: str) -> DataFrame:
    """_e (the group as text), _n, the place _i from 0 and the value _x, less the mean and in standard deviations, of the values that are there."""
    value = F.nanvl(F.col(source).cast("double"), F.lit(None).cast("double"))
    rows = df.select(F.to_json(F.struct(*group)).alias("_e"), F.col(order).alias("_o"), value.alias("_v")).where("_v is not null")
    whole = Window.partitionBy("_e")
    spread = F.stddev_pop("_v").over(whole)
    scaled = F.when(F.min("_v").over(whole) == F.max("_v").over(whole), 0.0).otherwise((F.col("_v") - F.avg("_v").over(whole)) / spread)
    return rows.select("_e", F.count(F.lit(1)).over(whole).alias("_n"), (F.row_number().over(whole.orderBy("_o", "_v")) - 1).cast("long").alias("_i"), scaled.alias("_x"))


def _dealt(rows: DataFrame, lags: str, span: int) -> DataFrame:
    """``rows`` by block _b, those before a block that its lags reach among them (_own false)."""
    width = F.greatest(F.lit(span), F.col(lags) + 1).cast("long")
    block = F.expr("_i div _s")
    last = F.col("_i") - F.col("_s") * (block + 1) >= -(F.col(lags) + 1)
    both = F.when(last, F.array(F.struct(block.alias("b"), F.lit(True).alias("own")), F.struct((block + 1).alias("b"), F.lit(False).alias("own")))).otherwise(F.array(F.struct(block.alias("b"), F.lit(True).alias("own"))))
    return rows.withColumn("_s", width).withColumn("_d", F.explode(both)).select("_e", F.col("_d.b").alias("_b"), F.col("_d.own").alias("_own"), "_i", "_x", F.col(lags).cast("int").alias("_l"))


NO_SUMS = pd.DataFrame({"_e": pd.Series(dtype=object), "_k": pd.Series(dtype="int32"), "_s": pd.Series(dtype=float)})


def _lagged_sums(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("_i")
    x, own, lags = pdf["_x"].to_numpy(), pdf["_own"].to_numpy(), int(pdf["_l"].iloc[0])
    halo = int((~own).sum())
    mine = x[halo:]
    if not len(mine):
        return NO_SUMS
    sums = [float(mine[max(0, k - halo) :] @ x[max(0, halo - k) : max(0, halo - k) + len(mine) - max(0, k - halo)]) if k < halo + len(mine) else 0.0 for k in range(lags + 1)]
    return pd.DataFrame({"_e": pdf["_e"].iloc[0], "_k": np.arange(lags + 1), "_s": sums})


def lagged_sums(rows: DataFrame, lags: str, span: int = SPAN) -> DataFrame:
    """_e, the lag _k from 0 to the column ``lags`` and the sum _s of products of values that far apart."""
    sums = _dealt(rows, lags, span).groupBy("_e", "_b").applyInPandas(_lagged_sums, "_e string, _k int, _s double")
    return sums.groupBy("_e", "_k").agg(F.sum("_s").alias("_s"))


def _design(x: np.ndarray, lags: int) -> np.ndarray:
    """Rows of the Dickey-Fuller regression: 1, the value before, ``lags`` differences before, and the difference."""
    d = np.diff(x)
    at = np.arange(lags, len(d))
    return np.column_stack([np.ones(len(at)), x[at], *(d[at - k] for k in range(1, lags + 1)), d[at]])


def _normal_sums(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("_i")
    lags = int(pdf["_l"].iloc[0])
    if len(pdf) < lags + 2 or not pdf["_own"].any():
        return NO_SUMS
    rows = _design(pdf["_x"].to_numpy(), lags)
    matrix = (rows.T @ rows).ravel()
    return pd.DataFrame({"_e": pdf["_e"].iloc[0], "_k": np.arange(len(matrix)), "_s": matrix})


def normal_sums(rows: DataFrame, lags: str, span: int = SPAN) -> DataFrame:
    """_e and the entries _s, numbered _k, of the regression's normal matrix."""
    sums = _dealt(rows, lags, span).groupBy("_e", "_b").applyInPandas(_normal_sums, "_e string, _k int, _s double")
    return sums.groupBy("_e", "_k").agg(F.sum("_s").alias("_s"))


def dickey_fuller(matrix: np.ndarray, head: np.ndarray, n: int) -> tuple[float, int]:
    """The t statistic of the value before and the lags taken, from the matrix of all lags and the first lags + 1 values."""
    most = matrix.shape[0] - 3

    def solved(m: np.ndarray, lags: int, rows: int) -> tuple[float, float]:
        used = [*range(lags + 2), m.shape[0] - 1]
        g = m[np.ix_(used, used)]
        inverse = np.linalg.pinv(g[:-1, :-1])
        beta = inverse @ g[:-1, -1]
        rest = max(1e-300, float(g[-1, -1] - beta @ g[:-1, -1]))
        return rest, float(beta[1] / math.sqrt(max(1e-300, rest / max(1, rows - lags - 2) * inverse[1, 1])))

    rows = n - 1 - most
    taken = min((rows * math.log(solved(matrix, lags, rows)[0] / rows) + 2 * (lags + 2), lags) for lags in range(most + 1))[1]
    used = [*range(taken + 2), most + 2]
    whole = matrix[np.ix_(used, used)].copy()
    if taken < most:
        first = _design(head, taken)
        whole += first.T @ first
    return solved(whole, taken, n - 1 - taken)[1], taken


def dickey_fuller_p(t: float) -> float:
    if t > TAU_MOST or t < TAU_LEAST:
        return float(t > TAU_MOST)
    z = sum(c * t**i for i, c in enumerate(SMALL_P if t <= TAU else LARGE_P))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def kpss_wants(sums: np.ndarray, n: int) -> int:
    """The number of lags of the long-run variance."""
    first = int(n ** (2 / 9))
    products = sums[1 : first + 1] / (n / 2)
    ratio = float((products * np.arange(1, len(products) + 1)).sum()) / max(1e-300, abs(sums[0] / n + products.sum())) * (1 if sums[0] / n + products.sum() > 0 else -1)
    return min(n - 1, int(1.1447 * (ratio**2) ** (1 / 3) * n ** (1 / 3)))


def kpss(sums: np.ndarray, squares: float, n: int, lags: int) -> float:
    k = np.arange(1, lags + 1)
    variance = (sums[0] + 2 * (sums[1 : lags + 1] * (1 - k / (lags + 1))).sum()) / n
    return squares / n**2 / variance if variance else math.inf


def kpss_p(value: float) -> float:
    return float(np.interp(value, KPSS_AT, KPSS_P))


def stationarity(df: DataFrame, group: list[str], source: str, order: str, span: int = SPAN) -> DataFrame:
    """_e, ``stationarity``, the statistics ``adf`` and ``kpss`` and their p-values of each group of two values or more."""
    series = staged(numbered_series(df, group, source, order))
    long = series.where("_n >= 4")
    lagged = F.least(F.expr("_n div 2 - 2"), F.ceil(12 * F.pow(F.col("_n") / 100, F.lit(0.25))))
    first = F.floor(F.pow(F.col("_n").cast("double"), F.lit(2 / 9)))
    level = F.least(F.col("_n") - 1, F.floor(1.1447 * F.pow((first + 1) / 2, F.lit(2 / 3)) * F.pow(F.col("_n").cast("double"), F.lit(1 / 3))) + 2)
    long = long.withColumns({"_adf": lagged.cast("int"), "_level": level.cast("int")})
    whole = Window.partitionBy("_e").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    path = series.withColumn("_w", F.sum("_x").over(whole))
    ends = path.groupBy("_e", "_n").agg(F.sum(F.col("_w") * F.col("_w")).alias("_squares"), F.sum(F.abs("_x")).alias("_size"))
    head = long.where(F.col("_i") <= F.col("_adf")).groupBy("_e").agg(F.array_sort(F.collect_list(F.struct("_i", "_x"))).alias("_head")).select("_e", F.col("_head._x").alias("_head"))
    listed = lambda sums, name: sums.groupBy("_e").agg(F.array_sort(F.collect_list(F.struct("_k", "_s"))).alias(name)).select("_e", F.col(f"{name}._s").alias(name))
    parts = ends.join(head, "_e", "left").join(listed(normal_sums(long, "_adf", span), "_matrix"), "_e", "left").join(listed(lagged_sums(long, "_level", span), "_sums"), "_e", "left")
    parts = staged(parts)
    # series with strong negative correlations ask for more lags than were summed
    asked = parts.where("_n >= 4 and _size > 0").select("_e", _asked("_sums", "_n").alias("_more")).join(parts.select("_e", F.size("_sums").alias("_had")), "_e").where("_more >= _had")
    more = listed(lagged_sums(long.join(asked.select("_e", "_more"), "_e"), "_more", span), "_again")
    joined = parts.join(more, "_e", "left").withColumn("_sums", F.coalesce("_again", "_sums")).drop("_again")
    return joined.mapInPandas(_judged, "_e string, stationarity string, adf double, adf_p double, kpss double, kpss_p double")


def _asked(sums: str, n: str):
    @F.pandas_udf("int")
    def run(s: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([kpss_wants(np.asarray(a, float), int(b)) for a, b in zip(s, n)])

    return run(sums, n)


def _judged(batches):
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            e, n, squares, size, head, matrix, sums = r
            if n < 4:
                out.append((e, TOO_SHORT, None, None, None, None))
            elif size == 0:
                out.append((e, CONSTANT, None, None, None, None))
            else:
                side = math.isqrt(len(matrix))
                t, _ = dickey_fuller(np.asarray(matrix, float).reshape(side, side), np.asarray(head, float), n)
                sums = np.asarray(sums, float)
                level = kpss(sums, squares, n, kpss_wants(sums, n))
                p, q = dickey_fuller_p(t), kpss_p(level)
                out.append((e, VERDICTS[p < SIGNIFICANT, q >= SIGNIFICANT], t, p, level, q))
        yield pd.DataFrame(out, columns=["_e", "stationarity", "adf", "adf_p", "kpss", "kpss_p"])


# series of a single block


def scaled(v: np.ndarray) -> np.ndarray:
    return np.zeros(len(v)) if v.min() == v.max() else (v - v.mean()) / v.std()


def _products(x: np.ndarray, lags: int) -> np.ndarray:
    return np.array([float(x[k:] @ x[: len(x) - k]) for k in range(lags + 1)])


def series_stationarity(v: np.ndarray) -> str:
    """The verdict of ``stationarity`` on one series."""
    n = len(v)
    if n < 4:
        return TOO_SHORT
    x = scaled(v)
    if not x.any():
        return CONSTANT
    lags = most_lags(n)
    rows = _design(x, lags)
    t, _ = dickey_fuller(rows.T @ rows, x[: lags + 1], n)
    sums = _products(x, kpss_lags(n))
    wanted = kpss_wants(sums, n)
    if wanted >= len(sums):
        sums = _products(x, wanted)
        wanted = kpss_wants(sums, n)
    level = kpss(sums, float((np.cumsum(x) ** 2).sum()), n, wanted)
    return VERDICTS[dickey_fuller_p(t) < SIGNIFICANT, kpss_p(level) >= SIGNIFICANT]


def series_white_noise(v: np.ndarray, lags: int = FIRST_LAGS) -> bool | None:
    """The answer of ``white_noise`` on one series."""
    n = len(v)
    if n < 2:
        return None
    x = scaled(v)
    if not x.any():
        return True
    while True:
        told = ljung_box(_products(x, min(n - 1, lags)), n)[0]
        if told is not None:
            return bool(told)
        lags *= MORE_LAGS


# white noise


def upper_gamma(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function: a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1 - scale * total
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 100_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


def ljung_box(sums: np.ndarray, n: int) -> tuple[bool | None, np.ndarray]:
    """Whether the lags summed so far (all products, lag 0 first) leave room for white noise, null if more lags decide; and the statistics."""
    k = np.arange(1, len(sums))
    q = n * (n + 2) * np.cumsum((sums[1:] / sums[0]) ** 2 / (n - k))
    if any(upper_gamma(i / 2, v / 2) >= SIGNIFICANT for i, v in zip(k.tolist(), q.tolist())):
        return True, q
    # the statistic only grows: if it is significant for the most lags already, it is for all to come
    return (False if len(k) >= n - 1 or upper_gamma((n - 1) / 2, q[-1] / 2) < SIGNIFICANT else None), q


def white_noise(df: DataFrame, group: list[str], source: str, order: str, span: int = SPAN, lags: int = FIRST_LAGS) -> DataFrame:
    """_e and ``white_noise`` of each group of two values or more: false where a Ljung-Box test rejects at every number of lags.

    Lags are summed in rounds, more of them only for the series that they decide;
    series of one value can't be told from noise.
    """
    series = staged(numbered_series(df, group, source, order)).where("_n >= 2")
    out, left = None, series
    while True:
        sums = lagged_sums(left.withColumn("_l", F.least(F.col("_n") - 1, F.lit(lags)).cast("int")), "_l", span)
        sizes = left.select("_e", "_n").distinct()
        listed = sums.groupBy("_e").agg(F.array_sort(F.collect_list(F.struct("_k", "_s"))).alias("_sums")).select("_e", F.col("_sums._s").alias("_sums")).join(sizes, "_e")
        found = staged(listed.mapInPandas(_told, "_e string, white_noise boolean"))
        done = found.where("white_noise is not null")
        out = done if out is None else out.unionByName(done)
        open_ = found.where("white_noise is null").select("_e")
        if not open_.take(1):
            return out
        left, lags = left.join(open_, "_e", "left_semi"), lags * MORE_LAGS


def _told(batches):
    for pdf in batches:
        told = [True if s[0] == 0 else ljung_box(np.asarray(s, float), int(n))[0] for s, n in zip(pdf["_sums"], pdf["_n"])]
        yield pd.DataFrame({"_e": pdf["_e"], "white_noise": pd.Series(told, index=pdf.index, dtype=object)})
