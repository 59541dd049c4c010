"""Forecast metrics as aggregate Columns, and series losses for grouped arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_SMALL = 1e-15


def _d(y: Column, p: Column) -> Column:
    return p.cast("double") - y.cast("double")


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg(_d(y, p) * _d(y, p)))


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(_d(y, p)))


def nrmse(y: Column, p: Column, norm: str = "mean") -> Column:
    return F.try_divide(rmse(y, p), F.abs(F.avg(y)) if norm == "mean" else F.max(y) - F.min(y))


def mape(y: Column, p: Column) -> Column:
    """In percent over truths that are not zero; null where there are none."""
    return F.avg(F.when(y != 0, F.abs(F.try_divide(_d(y, p), y.cast("double"))))) * 100


def smape(y: Column, p: Column) -> Column:
    half = (F.abs(y) + F.abs(p)) / 2
    return F.avg(F.abs(_d(y, p)) / F.when(half == 0, F.lit(_SMALL)).otherwise(half)) * 100


def wape(y: Column, p: Column) -> Column:
    return F.sum(F.abs(_d(y, p))) / F.nullif(F.sum(F.abs(y)), F.lit(0.0))


def bias(y: Column, p: Column) -> Column:
    return F.avg(_d(y, p))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(F.sum(a * b), F.sqrt(F.sum(a * a)) * F.sqrt(F.sum(b * b)))


METRICS = {"RMSE": rmse, "MAE": mae, "NRMSE": nrmse, "MAPE": mape, "SMAPE": smape, "WAPE": wape, "Bias": bias, "cosine_similarity": cosine}


# losses between two series of one group


def second_lag_difference(x: np.ndarray) -> np.ndarray:
    return x[2:] - x[:-2]


# Each compares a first series with a second one, whose own spectrum or correlation is the measure.


def _correlation(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sums of a[t + lag] b[t] over all lags, from -(n - 1) to n - 1."""
    n = len(a)
    size = 1 << (2 * n - 1).bit_length()
    full = np.fft.irfft(np.fft.rfft(a, size) * np.fft.rfft(b, size).conj(), size)
    return np.roll(full, n - 1)[: 2 * n - 1]


def amplitude_loss(first: np.ndarray, second: np.ndarray) -> float:
    """Mean distance, over all lags, of the second's normalised auto-correlation from the normalised cross-correlation."""
    long_a, long_b = np.sqrt((first**2).sum()), np.sqrt((second**2).sum())
    own = _correlation(second, second) / (long_b**2 or 1e-9)
    cross = _correlation(second, first) / (long_a * long_b or 1e-9)
    return float(np.abs(own - cross).mean())


def shift_loss(first: np.ndarray, second: np.ndarray) -> float:
    """How far the softmax of the signed differences is from uniform, summed over the series."""
    d = first - second
    e = np.exp(d - d.max())
    return float(np.abs(1.0 / len(d) - e / e.sum()).sum())


def phase_loss(first: np.ndarray, second: np.ndarray) -> float:
    """Spectrum distance at the second's dominant frequencies plus the first's strength at all others.

    Dominant are the mean, powers above the length and the floor(sqrt(n)) strongest.
    Each part is an average over its own frequencies; the sum is divided by sqrt(n).
    """
    n, fa, fb = len(first), np.fft.fft(first), np.fft.fft(second)
    power = np.abs(fb) ** 2
    dominant = power > n
    dominant[np.argsort(-power, kind="stable")[: int(np.sqrt(n))]] = True
    dominant[0] = True
    near = np.abs(fa - fb)[dominant].mean()
    rest = np.abs(fa)[~dominant].mean() if not dominant.all() else 0.0
    return float((near + rest) / np.sqrt(n))


def tildeq(first: np.ndarray, second: np.ndarray) -> float:
    return 0.5 * phase_loss(first, second) + 0.5 * shift_loss(first, second) + 0.01 * amplitude_loss(first, second)


def trend(first: np.ndarray, second: np.ndarray, alpha: float = 0.5) -> float:
    """Errors weighed by how far the steps disagree, and the distance times 1 less the correlation of the slopes."""
    agree = np.tanh(np.diff(first) * np.diff(second))
    stepped = float((np.abs(second - first)[1:] * (1.0 - agree)).mean())
    a, b = (x - x.mean() for x in (second_lag_difference(first), second_lag_difference(second)))
    along = float((a * b).sum() / (max(1e-8, np.sqrt((a**2).sum())) * max(1e-8, np.sqrt((b**2).sum()))))
    return stepped + alpha * (1.0 - along) * float(np.sqrt(((first - second) ** 2).sum()))


#: By (outputs, targets): the targets are the first series and the outputs the second.
LOSSES = {
    "TILDEQ": lambda out, target: tildeq(target, out), "TILDEQ_AMP": lambda out, target: amplitude_loss(target, out), "TILDEQ_ASHIFT": lambda out, target: shift_loss(target, out),
    "TILDEQ_PHASE": lambda out, target: phase_loss(target, out), "TREND": lambda out, target: trend(target, out),
}


def series_losses(df, group: list[str], order: str, target: str, output: str, names: list[str] | None = None):
    """Losses of each group's two series in the given order (nulls dropped); groups under 4 rows, too short to compare, give 0."""
    names = names or list(LOSSES)
    key = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in group)

    def run(pdf):
        import pandas as pd

        rows = pdf.dropna(subset=[target, output]).sort_values(order)
        y, p = rows[target].to_numpy(float), rows[output].to_numpy(float)
        found = {n.lower(): (LOSSES[n](p, y) if len(y) > 3 else 0.0) for n in names}
        return pd.DataFrame([{**{c: pdf[c].iloc[0] for c in group}, **found}])

    schema = key + ", " + ", ".join(f"{n.lower()} double" for n in names)
    return df.select(*group, order, target, output).groupBy(*group).applyInPandas(run, schema)
