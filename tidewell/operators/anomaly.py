"""Unsupervised scores of a metric per entity.

Scores that are window formulas stay DataFrame plans.  The others look at an
entity's whole series: one template sorts it, fills it in time, scores sliding
windows with numpy and stretches the scores back over the rows; Spark deals and
sorts the rows by entity and runs the template on Arrow batches, in which series of
one length are scored together.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.catalog import listed, operator
from tidewell.functions.scalars import micros, window_and_overlap
from tidewell.operators import long_series
from tidewell.operators.joins import small
from tidewell.sources.staging import staged

Scorer = Callable[[np.ndarray, np.ndarray, int], np.ndarray]

#: Rows of whole series that a task gathers before it scores them, and values of the windows that are worked on together.
GATHERED, TOGETHER = 200_000, 400_000


# scores as window formulas


def z_score(c: Column, group: Window) -> Column:
    """Distance from the mean in population standard deviations; 0 in a constant series."""
    spread = F.stddev_pop(c).over(group)
    return F.coalesce(F.abs(c - F.avg(c).over(group)) / F.nullif(spread, F.lit(0.0)), F.lit(0.0))


@operator("AnomalyScorer", inputs=("input_item",), outputs=("output_items",))
def base_score(df, ctx, input_item, output_items, windowsize=12):
    from tidewell.operators.windows import interpolate

    out = interpolate(df, ctx, input_item, "_x").withColumn("_x", F.coalesce("_x", F.lit(0.0)))
    return out.withColumns({n: z_score(F.col("_x"), Window.partitionBy(ctx.entity)) for n in listed(output_items)}).drop("_x")


@operator("NoDataAnomalyScoreExt", inputs=("input_item",), outputs=("output_item",))
def no_data_score_ext(df, ctx, input_item, output_item, windowsize=12):
    """The score of the spacing of times: half the distance between both neighbours."""
    order = Window.partitionBy(ctx.entity).orderBy(ctx.timestamp)
    t = micros(F.col(ctx.timestamp)) / 1e6
    out = df.withColumns({"_b": F.lag(t).over(order), "_a": F.lead(t).over(order), "_t": t})
    gap = F.coalesce((F.col("_a") - F.col("_b")) / 2, F.col("_a") - F.col("_t"), F.col("_t") - F.col("_b"), F.lit(0.0))
    out = out.withColumn("_g", gap)
    return out.withColumn(output_item, z_score(F.col("_g"), Window.partitionBy(ctx.entity))).drop("_a", "_b", "_t", "_g")


def robust_bounds(df: DataFrame, ctx, item: str, threshold: float) -> DataFrame:
    """Per entity the outlier bounds and the median and scaled absolute deviation.

    A threshold inside (0, 1) is a two-sided quantile, another one asks for the fence
    2.5 q1 - 1.5 q3 to 2.5 q3 - 1.5 q1.
    """
    c = F.col(item)
    if 0 < threshold < 1:
        low, high = sorted((threshold, 1 - threshold))
        bounds = F.percentile(c, [low, high])
        stats = df.groupBy(ctx.entity).agg(bounds.alias("_q"), F.median(c).alias("median"))
        stats = stats.select(ctx.entity, F.col("_q")[0].alias("low"), F.col("_q")[1].alias("high"), "median")
    else:
        stats = df.groupBy(ctx.entity).agg(F.percentile(c, [0.25, 0.75]).alias("_q"), F.median(c).alias("median"))
        q1, q3 = F.col("_q")[0], F.col("_q")[1]
        stats = stats.select(ctx.entity, (2.5 * q1 - 1.5 * q3).alias("low"), (2.5 * q3 - 1.5 * q1).alias("high"), "median")
    spread = df.select(ctx.entity, item).join(stats.select(ctx.entity, "median"), ctx.entity).groupBy(ctx.entity).agg((F.median(F.abs(F.col(item) - F.col("median"))) * 1.4826).alias("mad"))
    return stats.join(spread, ctx.entity)


@operator("RobustThreshold", inputs=("input_item",), outputs=("outlier", "anomaly"))
def robust_threshold(df, ctx, input_item, threshold, outlier="outlier", anomaly="anomaly", history_table=None):
    """Outside the bounds, and more than 2 scaled deviations from the median; over the history where given."""
    past = ctx.table(df.sparkSession, history_table) if history_table else df
    joined = df.join(robust_bounds(past, ctx, input_item, threshold), ctx.entity, "left")
    c = F.col(input_item)
    out = joined.withColumns({outlier: (c < F.col("low")) | (c > F.col("high")), anomaly: F.abs(c - F.col("median")) > 2 * F.col("mad")})
    return out.drop("low", "high", "median", "mad")


@operator("EnsembleAnomalyScore", inputs=("scores",), outputs=("output_item",))
def ensemble_score(df, ctx, scores, thresholds, output_item):
    """Mean over scores of 0, 1, 2, 3 or 4 by multiples 0.75, 1, 1.5 and 2 of the score's threshold."""

    def level(c: str, t: float) -> Column:
        out = F.lit(0)
        for step, times in enumerate((0.75, 1.0, 1.5, 2.0), start=1):
            out = F.when(F.coalesce(F.col(c), F.lit(0.0)) >= times * t, F.lit(step)).otherwise(out)
        return out

    total = sum((level(c, t) for c, t in zip(scores, thresholds)), F.lit(0))
    return df.withColumn(output_item, total / float(len(scores)))


# scores of windows, with numpy


def windows_of(x: np.ndarray, size: int, step: int = 1) -> np.ndarray:
    """The windows of a series, or of each of several as long as each other."""
    return np.lib.stride_tricks.sliding_window_view(x, size, axis=-1)[..., ::step, :]


def stretch(score: np.ndarray, length: int) -> np.ndarray:
    """A score per row from fewer scores, by a line between them; negative scores become 0."""
    if len(score) != length:
        score = np.interp(np.linspace(0, 1, length), np.linspace(0, 1, len(score)), score) if len(score) else np.zeros(length)
    return np.maximum(score, 0.0)


def robust_distance(x: np.ndarray, seed: int = 1, tries: int = 20, refine: int = 10, best_few: int = 3) -> np.ndarray:
    """Squared Mahalanobis distances from the centre of the half of rows with the least spread.

    Random starts are concentrated: the nearest half gives the next centre and
    covariance.  All starts take two such steps, then the best few go on until the
    determinant no longer falls.
    """
    n, d = x.shape
    half, rng, best = max(d + 1, (n + d + 1) // 2), np.random.default_rng(seed), None
    ridge = 1e-9 * (np.trace(np.cov(x, rowvar=False).reshape(d, d)) / d + 1e-12) * np.eye(d)

    def centre(rows):
        return rows.mean(axis=0), np.cov(rows, rowvar=False).reshape(d, d) + ridge

    def distance(mean, cov):
        off = x - mean
        return np.einsum("ij,ij->i", off @ np.linalg.pinv(cov), off)

    if half >= n:
        return distance(*centre(x))

    def nearer(mean, cov):
        mean, cov = centre(x[np.argpartition(distance(mean, cov), half - 1)[:half]])
        return np.linalg.slogdet(cov)[1], mean, cov

    starts = [nearer(*nearer(*centre(x[rng.choice(n, min(n, d + 1), replace=False)]))[1:]) for _ in range(tries)]
    for last, mean, cov in sorted(starts, key=lambda s: s[0])[:best_few]:
        for _ in range(refine):
            now = nearer(mean, cov)
            if not now[0] < last - 1e-9:
                break
            last, mean, cov = now
        if best is None or last < best[0]:
            best = last, mean, cov
    return distance(best[1], best[2])


@functools.lru_cache(4096)
def _starts(n: int, d: int, seed: int, tries: int) -> np.ndarray:
    """The rows that ``robust_distance`` starts from, as weights (tries x rows) of 1 and 0."""
    rng, out = np.random.default_rng(seed), np.zeros((tries, n))
    for row in out:
        row[rng.choice(n, min(n, d + 1), replace=False)] = 1.0
    return out


def robust_distances(x: np.ndarray, seed: int = 1, tries: int = 20, refine: int = 10, best_few: int = 3) -> np.ndarray:
    """``robust_distance`` of several series (series x rows x values), all starts of all of them at once.

    Means and products of the chosen rows are sums by weights of 1 and 0, of values
    less their medians, whose rounding is far below the ridge.
    """
    e, n, d = x.shape
    x = x - np.median(x, axis=1, keepdims=True)
    half = max(d + 1, (n + d + 1) // 2)
    ridge = 1e-9 * (x.var(axis=1, ddof=1).sum(axis=1) / d + 1e-12)
    upper = np.triu_indices(d)
    products = x[:, :, upper[0]] * x[:, :, upper[1]]
    flat = np.empty((d, d), int)
    flat[upper] = flat[upper[::-1]] = np.arange(len(upper[0]))

    def centre(of, chosen, count):
        """Means, roots of the inverse covariances and logarithms of the determinants of the rows chosen (series x starts x rows)."""
        mean = chosen @ x[of] / count
        cov = ((chosen @ products[of])[..., flat] - count * mean[..., :, None] * mean[..., None, :]) / (count - 1)
        low = np.linalg.cholesky(cov + ridge[of][:, None, None, None] * np.eye(d))
        return 2 * np.log(np.diagonal(low, axis1=-2, axis2=-1)).sum(axis=-1), mean, np.linalg.inv(low).swapaxes(-1, -2)

    def distance(of, mean, root):
        out, few = np.empty((len(mean), mean.shape[1], n)), max(1, TOGETHER // (len(mean) * n * d))
        for s in range(0, mean.shape[1], few):
            z = x[of][:, None] @ root[:, s : s + few] - (mean[:, s : s + few, None] @ root[:, s : s + few])
            out[:, s : s + few] = np.einsum("esij,esij->esi", z, z)
        return out

    every = np.arange(e)
    if half >= n:
        _, mean, root = centre(every, np.ones((e, 1, n)), n)
        return distance(every, mean, root)[:, 0]

    def nearer(of, mean, root):
        near = np.argpartition(distance(of, mean, root), half - 1, axis=-1)[..., :half]
        chosen = np.zeros((len(mean), mean.shape[1], n))
        np.put_along_axis(chosen, near, 1.0, axis=-1)
        return centre(of, chosen, half)

    found = centre(every, np.broadcast_to(_starts(n, d, seed, tries), (e, tries, n)), min(n, d + 1))
    for _ in range(2):
        found = nearer(every, *found[1:])
    few = np.argsort(found[0], axis=1, kind="stable")[:, :best_few]
    last, mean, root = (f[every[:, None], few] for f in found)
    falls = np.ones(last.shape, bool)
    for _ in range(refine):
        of = np.nonzero(falls.any(axis=1))[0]
        if not len(of):
            break
        now = nearer(of, mean[of], root[of])
        falls[of] &= now[0] < last[of] - 1e-9
        for old, new in zip((last, mean, root), now):
            old[falls] = new[falls[of]]
    best = last.argmin(axis=1)[:, None]
    return distance(every, mean[every[:, None], best], root[every[:, None], best])[:, 0]


def window_energy(w: np.ndarray) -> np.ndarray:
    """Energy of each window's Hann-windowed spectrum without a line, weighted by frequency."""
    size = w.shape[1]
    at = np.arange(size) - (size - 1) / 2
    slope = (w * at).sum(axis=1, keepdims=True) / max(1e-12, (at * at).sum())
    flat = w - w.mean(axis=1, keepdims=True) - slope * at
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    power = np.abs(np.fft.rfft(flat * hann, axis=1)) ** 2 / max(1e-12, (hann**2).sum())
    return (power * np.fft.rfftfreq(size)).sum(axis=1)


def spectral(x, t, size, parts=("score",)):
    """Energy of each window as z-scores times 100 / 2.8."""
    size, overlap = window_and_overlap(size)
    energy = window_energy(windows_of(x, size, max(1, size - overlap)))
    score = lambda e: np.abs(e - e.mean()) / (e.std() or 1.0) * 100 / 2.8
    found = {"score": score(energy), "inverse": score(1.0 / np.maximum(energy, 1e-9)), "energy": energy}
    return [found[p] for p in parts]


def k_means(w: np.ndarray, clusters: int = 15, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Centres after 30 rounds at most, and the cluster of each row as of the last."""
    k = max(1, min(clusters, len(w) // 2))
    rng = np.random.default_rng(seed)
    centres = w[rng.choice(len(w), k, replace=False)].astype(float)
    for _ in range(30):
        of = _nearest(w, centres).argmin(axis=1)
        new = np.array([w[of == j].mean(axis=0) if (of == j).any() else centres[j] for j in range(k)])
        if np.allclose(new, centres):
            break
        centres = new
    return centres, of


def kmeans_scores(x, t, size, clusters=15, seed=1):
    """``kmeans_score`` of several series as long as each other (series x rows)."""
    w = np.ascontiguousarray(windows_of(x, size), float)
    e, n, _ = w.shape
    k = max(1, min(clusters, n // 2))
    squares = (w * w).sum(axis=2)[:, :, None]
    near = lambda i, c: np.maximum(0, squares[i] - 2 * w[i] @ c.swapaxes(1, 2) + (c * c).sum(axis=2)[:, None])
    centres = w[:, np.random.default_rng(seed).choice(n, k, replace=False)]
    counts, moving = np.zeros((e, k)), np.arange(e)
    for _ in range(30):
        of = near(moving, centres[moving]).argmin(axis=2)
        mine = (of[:, :, None] == np.arange(k)).astype(float)
        counts[moving] = held = mine.sum(axis=1)
        old = centres[moving]
        new = np.where(held[:, :, None] > 0, mine.swapaxes(1, 2) @ w[moving] / np.maximum(1, held)[:, :, None], old)
        moved = ~np.isclose(new, old).all(axis=(1, 2))
        moving = moving[moved]
        centres[moving] = new[moved]
        if not len(moving):
            break
    large = np.zeros((e, k), bool)
    for i in range(e):
        large[i, large_clusters(counts[i])] = True
    return np.sqrt(np.where(large[:, None], near(np.arange(e), centres), np.inf).min(axis=2))


def kmeans_score(x, t, size, clusters=15, seed=1):
    """Distance of each window from the centre of the nearest large cluster of k-means."""
    w = windows_of(x, size)
    centres, of = k_means(w, clusters, seed)
    k = len(centres)
    return np.sqrt(_nearest(w, centres[large_clusters(np.bincount(of, minlength=k))]).min(axis=1))


def large_clusters(counts: np.ndarray) -> list[int]:
    """The clusters that hold nine tenths of the windows, or stand before a fivefold drop, largest first."""
    order = np.argsort(-counts, kind="stable")
    held, large = 0, []
    for place, j in enumerate(order):
        large.append(int(j))
        held += counts[j]
        following = counts[order[place + 1]] if place + 1 < len(order) else 0
        if held >= 0.9 * counts.sum() or following and counts[j] >= 5 * following:
            break
    return large


def _nearest(w, centres):
    return np.maximum(0, (w * w).sum(axis=1)[:, None] - 2 * w @ centres.T + (centres * centres).sum(axis=1))


# what the robust distances look at, of one series or of several as long as each other


def value_windows(x, t, size):
    return windows_of(x - x.mean(axis=-1, keepdims=True), size)


def gap_windows(x, t, size):
    gap = np.gradient(t, axis=-1)
    return windows_of(gap - gap.mean(axis=-1, keepdims=True), size)


def spectrum_windows(x, t, size):
    return np.abs(np.fft.rfft(value_windows(x, t, size), axis=-1))


def plain_windows(x, t, size):
    return windows_of(x, size)


def covariance_score(x, t, size, scale=300.0):
    return robust_distance(value_windows(x, t, size)) / scale


def no_data_score(x, t, size):
    return robust_distance(gap_windows(x, t, size))


def fft_score(x, t, size):
    return robust_distance(spectrum_windows(x, t, size))


def saliency(x: np.ndarray, width: int = 3) -> np.ndarray:
    """The series rebuilt from what its log spectrum has beyond the mean of its last ``width`` values (of fewer at the start)."""
    spectrum = np.fft.fft(x)
    size = np.maximum(np.abs(spectrum), 1e-8)
    log = np.log(size)
    total = np.concatenate(([0.0], np.cumsum(log)))
    end = np.arange(1, len(log) + 1)
    start = np.maximum(0, end - width)
    return np.abs(np.fft.ifft(spectrum / size * np.exp(log - (total[end] - total[start]) / (end - start))))


def saliency_score(x, t, size):
    """Robust distances of the plain windows: the saliency map is offered beside this score and takes no part in it."""
    return robust_distance(plain_windows(x, t, size))


def by_distances(windows: Callable, divide: float = 1.0) -> Scorer:
    """Robust distances of the windows of several series as long as each other."""

    def run(x, t, size):
        w = windows(x, t, size)
        try:
            return robust_distances(w) / divide
        except np.linalg.LinAlgError:
            return np.stack([robust_distance(one) for one in w]) / divide

    return run


def matrix_profile(x, t, size):
    """Distance of each window to its nearest one that does not overlap by over half."""
    w = windows_of(x, size).astype(float)
    out, apart = np.empty(len(w)), max(1, size // 2)
    for a in range(0, len(w), 512):
        d = _nearest(w[a : a + 512], w)
        rows = np.arange(a, min(len(w), a + 512))
        d[np.abs(rows[:, None] - np.arange(len(w))) < apart] = np.inf
        out[a : a + 512] = np.sqrt(d.min(axis=1))
    out[~np.isfinite(out)] = 0.0
    return np.concatenate((out, np.full(len(x) - len(out), 1e-15)))


def merged_segments(edges: list[int], sums: np.ndarray, count: int) -> list[int]:
    """Of segments between ``edges``, merged at the least rise of squared error (of equal ones the first), the ``count`` inner edges that stay.

    ``sums`` are the sums of values and of squares before each edge.
    """
    s1, s2 = sums
    cost = lambda i, j: s2[j] - s2[i] - (s1[j] - s1[i]) ** 2 / (edges[j] - edges[i])
    before, after = list(range(-1, len(edges) - 1)), list(range(1, len(edges) + 1))
    now: dict[int, float] = {}

    def rise(i: int) -> float:
        a, c = before[i], after[i]
        now[i] = float(cost(a, c) - cost(a, i) - cost(i, c))
        return now[i]

    heap = [(rise(i), i) for i in range(1, len(edges) - 1)]
    heapq.heapify(heap)
    while len(now) > count:
        value, i = heapq.heappop(heap)
        if now.get(i) != value:  # merged already, or a neighbour was
            continue
        del now[i]
        after[before[i]], before[after[i]] = after[i], before[i]
        for j in (before[i], after[i]):
            if j in now:
                heapq.heappush(heap, (rise(j), j))
    return [edges[i] for i in sorted(now)]


def change_points(x: np.ndarray, count: int = 15, jump: int = 2) -> list[int]:
    """Bottom-up segmentation from pieces of ``jump`` values."""
    edges = [*range(0, len(x), jump), len(x)]
    sums = np.concatenate(([[0.0], [0.0]], np.cumsum((x, x * x), axis=1)), axis=1)[:, edges]
    return merged_segments(edges, sums, count)


def change_score(x, t, size):
    """A bump around each change point, as wide as half a window."""
    rows, out = np.arange(len(x)), np.zeros(len(x))
    for p in change_points(x):
        out = np.maximum(out, np.exp(-0.5 * ((rows - p) / max(1.0, size / 2)) ** 2))
    return out


def kde_density(points: np.ndarray, at: np.ndarray, block: int = 1024) -> np.ndarray:
    """Gaussian kernel density (rows x dimensions) with Scott's bandwidth."""
    n, d = points.shape
    cov = np.cov(points, rowvar=False).reshape(d, d) * n ** (-2 / (d + 4)) + 1e-12 * np.eye(d)
    inv, norm = np.linalg.inv(cov), np.sqrt((2 * np.pi) ** d * np.linalg.det(cov)) * n
    root = np.linalg.cholesky(inv)
    a, b = points @ root, at @ root
    return np.concatenate([np.exp(-0.5 * _nearest(b[i : i + block], a)).sum(axis=1) for i in range(0, len(b), block)]) / norm


def filled_in_time(x: np.ndarray, t: np.ndarray) -> np.ndarray:
    """A series with what is missing by a line in time, at the end by the last value, at the start by 0."""
    there = ~np.isnan(x)
    if there.all():
        return x
    if not there.any():
        return np.zeros(len(x))
    x = np.where(there, x, np.interp(t, t[there], x[there]))
    x[: there.argmax()] = 0.0
    return x


def whole_series(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole series of sorted batches, GATHERED rows or few more, and where each series starts and the last ends."""
    held, rows = [], 0

    def starts(table):
        e = table.column("_e").combine_chunks()
        return np.concatenate(([0], np.nonzero(pc.not_equal(e[1:], e[:-1]).to_numpy(zero_copy_only=False))[0] + 1, [len(e)]))

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= GATHERED:
            table = pa.Table.from_batches(held).combine_chunks()
            edges = starts(table)
            if len(edges) > 2:
                yield table.slice(0, edges[-2]), edges[:-1]
                table = table.slice(edges[-2])
            held, rows = table.to_batches(), table.num_rows if len(edges) > 2 else 0
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, starts(table)


def _scored(names: list[str], run: Callable, size: int, scale: bool, together: Scorer | None):
    """Rows (_e, _t, _x) sorted by entity and time to scores of each entity's times."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in whole_series(batches):
            us = table.column("_t").cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy()
            x, t = table.column("_x").fill_null(np.nan).to_numpy().astype(float), us / 1e6
            out = np.full((len(names), len(x)), np.nan)
            lengths: dict[int, list[int]] = {}
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if b - a > size:
                    lengths.setdefault(b - a, []).append(a)
                    x[a:b] = filled_in_time(x[a:b], t[a:b])
            for length, firsts in lengths.items():
                few = max(1, TOGETHER // (20 * size * length))
                for i in range(0, len(firsts), few):
                    at = np.array(firsts[i : i + few])[:, None] + np.arange(length)
                    xs = x[at]
                    if scale:
                        spread = xs.std(axis=1, keepdims=True)
                        xs = (xs - xs.mean(axis=1, keepdims=True)) / np.where(spread > 0, spread, 1.0)
                    if together is not None:
                        found = [[s] for s in together(xs, t[at], size)]
                    else:
                        found = [f if isinstance(f, list) else [f] for f in (run(*one, size) for one in zip(xs, t[at]))]
                    for rows, scores in zip(at, found):
                        for k, s in enumerate(scores):
                            out[k, rows] = stretch(np.asarray(s, float), length)
            first = np.ones(len(x), bool)
            first[1:] = us[1:] != us[:-1]
            first[edges[:-1]] = True
            kept = pa.Table.from_arrays([table.column("_e"), table.column("_t"), *map(pa.array, out)], ["_e", "_t", *names]).filter(pa.array(first))
            yield from kept.to_batches(max_chunksize=20_000)

    return score


def score_series(df: DataFrame, ctx, item: str, names: list[str], run: Callable, size: int, scale: bool = False, long: Callable | None = None, together: Scorer | None = None) -> DataFrame:
    """The template: per entity score the series in time order and join the scores back by key.

    Nulls are filled in time and at the start with 0.  A series of no more rows than
    the window is not scored: null.  Only key, time and metric go through Python.
    ``run`` scores one series, ``together`` several of one length at once.  Entities of
    over ``long_series.LONG`` rows are scored in blocks by ``long(rows, size, scale)``,
    where there is one.
    """
    rows = df.select(F.col(ctx.entity).alias("_e"), F.col(ctx.timestamp).alias("_t"), F.col(item).cast("double").alias("_x")).where("_e is not null")
    fields = ", ".join(f"`{n}` double" for n in names)

    beyond = None
    if long is not None:
        many = rows.groupBy("_e").count().where(F.col("count") > long_series.LONG).select("_e")
        if many.take(1):
            many = staged(many)
            beyond = long(rows.join(small(many), "_e", "left_semi"), size, scale)
            rows = rows.join(small(many), "_e", "left_anti")
    # dealt by a fixed number: adaptive merging goes by bytes and would put work of minutes in one task
    spread = rows.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_e").sortWithinPartitions("_e", F.asc_nulls_last("_t"), "_x")
    scored = spread.mapInArrow(_scored(names, run, size, scale, together), f"_e {rows.schema['_e'].dataType.simpleString()}, _t {rows.schema['_t'].dataType.simpleString()}, {fields}")
    if beyond is not None:
        scored = scored.unionByName(beyond.toDF("_e", "_t", *names))
    scored = scored.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in names})
    joined = df.join(scored, (F.col(ctx.entity) == F.col("_e")) & (F.col(ctx.timestamp) == F.col("_t")), "left")
    return joined.drop("_e", "_t")


def _scorer(name: str, run: Callable, versions: bool = True, long: Callable | None = None, together: Scorer | None = None) -> None:
    @operator(name, inputs=("input_item",), outputs=("output_item",))
    def score(df, ctx, input_item, output_item, windowsize=12, expr=None):
        return score_series(df, ctx, input_item, [output_item], run, windowsize, long=long, together=together)

    if versions:

        @operator(f"{name}V2", inputs=("input_item",), outputs=("output_item",))
        def score_scaled(df, ctx, input_item, output_item, windowsize=12, normalize=True, expr=None):
            return score_series(df, ctx, input_item, [output_item], run, windowsize, scale=normalize, long=long, together=together)


_scorer("SpectralAnomalyScore", spectral, versions=False, long=lambda rows, size, scale: long_series.spectral_scores(rows, size, scale, {"score": "score"}))
_scorer("KMeansAnomalyScore", kmeans_score, long=lambda rows, size, scale: long_series.cluster_scores(rows, size, scale), together=kmeans_scores)
_scorer("GeneralizedAnomalyScore", covariance_score, long=lambda rows, size, scale: long_series.robust_scores(rows, size, scale, divide=300.0), together=by_distances(value_windows, 300.0))
_scorer("NoDataAnomalyScore", no_data_score, versions=False, long=lambda rows, size, scale: long_series.robust_scores(rows, size, scale, of_gaps=True), together=by_distances(gap_windows))
_scorer("FFTbasedGeneralizedAnomalyScore", fft_score, long=lambda rows, size, scale: long_series.robust_scores(rows, size, scale, "spectrum"), together=by_distances(spectrum_windows))
_scorer("SaliencybasedGeneralizedAnomalyScore", saliency_score, long=lambda rows, size, scale: long_series.robust_scores(rows, size, scale, centred=False), together=by_distances(plain_windows))
_scorer("MatrixProfileAnomalyScore", matrix_profile, versions=False, long=long_series.profile_scores)
_scorer("ChangePointDetector", change_score, versions=False, long=lambda rows, size, scale: long_series.change_scores(rows, size, scale))


@operator("SpectralAnomalyScoreExt", inputs=("input_item",), outputs=("output_item", "inv_zscore", "signal_energy"))
def spectral_score_ext(df, ctx, input_item, output_item, inv_zscore, signal_energy=None, windowsize=12):
    names = [output_item, inv_zscore] + ([signal_energy] if signal_energy else [])
    parts = ("score", "inverse", "energy")[: len(names)]
    long = lambda rows, size, scale: long_series.spectral_scores(rows, size, scale, dict(zip(parts, parts)))
    return score_series(df, ctx, input_item, names, lambda x, t, size: spectral(x, t, size, parts), windowsize, long=long)


def dampen(x: np.ndarray, power: float = 0.9) -> np.ndarray:
    """Steps of a score raised to a power below 1, with their sign, and summed again."""
    if power == 1 or len(x) < 2:
        return x
    step = np.gradient(x)
    return np.cumsum(np.sign(step) * np.abs(step) ** power)
