"""Window scores of entities with very many rows, in blocks of their series.

A block holds the windows that start in it, with the values they reach into.  What
the scores need of a whole series is summed over blocks:

- Robust distances come from nested FastMCD.  Subsets of a few hundred windows, drawn
  by a hash, each give their best centres; these are improved on the subsets together;
  and the best one takes ``STEPS`` concentration steps over all windows, each a
  quantile of the distances and a sum of outer products by block.
- Spectral energies are local to a window; their mean and spread are aggregates.
- Clusters start from those of the drawn windows and take ``STEPS`` rounds over all
  windows, each a sum and a count by centre and block.
- Change points: a block's pieces are merged to ``SEGMENTS``, whose sums are merged on
  for the entity.
- The matrix profile holds each block against each other one of its entity and
  merges the minima.

Scores of windows are laid over the rows by a line between them, as for short series.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.scalars import micros, window_and_overlap
from tidewell.operators.joins import small
from tidewell.sources.staging import staged

#: Rows of an entity up to which its series is scored in one task, and windows of a block beyond.
LONG, BLOCK = 20_000, 8192
#: Subsets, their windows, the centres that each gives, and the final steps over all windows.
SUBSETS, SUBSET, CENTRES, STEPS = 5, 300, 10, 3
#: Segments to which a block is merged before its entity's are.
SEGMENTS = 200


def filled(rows: DataFrame, scale: bool) -> DataFrame:
    """_e, _t, place _i from 0, rows _n, seconds _s and value _x of ``rows`` (_e, _t, _x): filled in time, at the start with 0, at the end with the last value."""
    order = Window.partitionBy("_e").orderBy("_t")
    seconds = micros(F.col("_t")) / 1e6
    point = F.when(F.col("_x").isNotNull() & ~F.isnan("_x"), F.struct(F.col("_s").alias("s"), F.col("_x").alias("x")))
    before = F.last(point, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(point, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    near = rows.withColumn("_s", seconds).withColumns({"_b": before, "_a": after, "_i": (F.row_number().over(order) - 1).cast("long"), "_n": F.count(F.lit(1)).over(Window.partitionBy("_e"))})
    part = (F.col("_s") - F.col("_b.s")) / F.nullif(F.col("_a.s") - F.col("_b.s"), F.lit(0.0))
    value = F.when(F.col("_b").isNull(), 0.0).when(F.col("_a").isNull(), F.col("_b.x")).otherwise(F.col("_b.x") + F.coalesce(part, F.lit(0.0)) * (F.col("_a.x") - F.col("_b.x")))
    out = near.select("_e", "_t", "_i", "_n", "_s", value.alias("_x"))
    if not scale:
        return out
    whole = Window.partitionBy("_e")
    return out.withColumn("_x", (F.col("_x") - F.avg("_x").over(whole)) / F.coalesce(F.nullif(F.stddev_pop("_x").over(whole), F.lit(0.0)), F.lit(1.0)))


def blocks(series: DataFrame, size: int, value: str = "_x", block: int = BLOCK) -> DataFrame:
    """_e, _b, the rows _n and the values _v of each block: of its windows' starts, and of the ``size`` - 1 rows after."""
    own = F.struct(F.expr(f"_i div {block}").alias("b"))
    before = F.struct(F.expr(f"_i div {block} - 1").alias("b"))
    reached = (F.col("_i") % block < size - 1) & (F.col("_i") >= block)
    dealt = series.withColumn("_d", F.explode(F.when(reached, F.array(own, before)).otherwise(F.array(own))))
    listed = dealt.groupBy("_e", F.col("_d.b").alias("_b"), "_n").agg(F.array_sort(F.collect_list(F.struct("_i", F.col(value).alias("v")))).alias("_l"))
    return listed.select("_e", "_b", "_n", F.col("_l.v").alias("_v")).where(F.size("_v") >= size)


def _windows(values, size: int, step: int = 1) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(np.asarray(values, float), size)[::step]


#: What each kind looks at: the windows themselves, or the sizes of their spectra.
FEATURES: dict[str, Callable[[np.ndarray], np.ndarray]] = {"plain": lambda w: w, "spectrum": lambda w: np.abs(np.fft.rfft(w, axis=1))}


# robust distances


def centre_of(rows: np.ndarray, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    d = rows.shape[1]
    return rows.mean(axis=0), np.cov(rows, rowvar=False).reshape(d, d) + ridge * np.eye(d)


def distances(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    off = x - mean
    return np.einsum("ij,ij->i", off @ np.linalg.pinv(cov), off)


def concentrated(x: np.ndarray, mean: np.ndarray, cov: np.ndarray, ridge: float, steps: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Steps to the centre of the nearest half, until the determinant no longer falls."""
    n, d = x.shape
    half, last = min(n, max(d + 1, (n + d + 1) // 2)), np.inf
    for _ in range(steps):
        new = centre_of(x[np.argpartition(distances(x, mean, cov), half - 1)[:half]], ridge)
        now = float(np.linalg.slogdet(new[1])[1])
        if not now < last - 1e-9:
            break
        last, (mean, cov) = now, new
    return last, mean, cov


def _ridge(x: np.ndarray) -> float:
    d = x.shape[1]
    return float(1e-9 * (np.trace(np.cov(x, rowvar=False).reshape(d, d)) / d + 1e-12))


def _drawn(kind: str, size: int, block: int, seed: int = 1):
    """Blocks to windows of the subsets: each window by a hash of its place, about SUBSETS * SUBSET of an entity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for e, b, n, v in zip(*(c.to_pylist() for c in batch.columns)):
                w = FEATURES[kind](_windows(v, size)[:block])
                places = np.arange(len(w), dtype=np.uint64) + np.uint64(b * block)
                with np.errstate(over="ignore"):
                    h = (places + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
                    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
                    h ^= h >> np.uint64(32)
                share = min(1.0, SUBSETS * SUBSET / max(1, n - size + 1))
                for k in np.nonzero(h.astype(float) / 2**64 < share)[0]:
                    out.append({"_e": e, "_k": int(h[k] % np.uint64(SUBSETS)), "_w": w[k].tolist()})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("_e", batch.schema.field(0).type), ("_k", pa.int32()), ("_w", pa.list_(pa.float64()))]))

    return run


def _few_centres(pdf: pd.DataFrame) -> pd.DataFrame:
    """One subset's best centres after two steps from random starts."""
    x = np.array(pdf["_w"].tolist())
    rng, ridge, found = np.random.default_rng(1), _ridge(x), []
    for _ in range(3 * CENTRES):
        start = centre_of(x[rng.choice(len(x), min(len(x), x.shape[1] + 1), replace=False)], ridge)
        found.append(concentrated(x, *start, ridge, 2))
    best = sorted(found, key=lambda f: f[0])[:CENTRES]
    return pd.DataFrame({"_e": pdf["_e"].iloc[0], "_m": [m.tolist() for _, m, _ in best], "_c": [c.ravel().tolist() for _, _, c in best]})


def _pooled(left: pa.Table, right: pa.Table) -> pa.Table:
    """The best centre after steps over an entity's subsets together, from the best of each."""
    x = np.array(left["_w"].to_pylist())
    d, ridge = x.shape[1], _ridge(x)
    tried = [concentrated(x, np.array(m), np.array(c).reshape(d, d), ridge, 2) for m, c in zip(right["_m"].to_pylist(), right["_c"].to_pylist())]
    best = min((concentrated(x, m, c, ridge, 10) for _, m, c in sorted(tried, key=lambda f: f[0])[:3]), key=lambda f: f[0])
    return pa.table({"_e": left["_e"][:1], "_m": [best[1].tolist()], "_c": [best[2].ravel().tolist()], "_r": [ridge]})


def _measured(kind: str, size: int, block: int):
    """Blocks with their centre to the distance of each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                e, b, v, m, c = (batch.column(k)[i].as_py() for k in range(5))
                x = FEATURES[kind](_windows(v, size)[:block])
                found = distances(x, np.array(m), np.array(c).reshape(len(m), len(m)))
                yield pa.RecordBatch.from_arrays([pa.array([e] * len(found), batch.schema.field(0).type), pa.array(np.arange(len(found)) + b * block), pa.array(found)], ["_e", "_i", "_d"])

    return run


def _outer_sums(kind: str, size: int, block: int):
    """Blocks with their centre and a bound to sums over the windows within it: their number, values and products."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                e, b, v, m, c, bound = (batch.column(k)[i].as_py() for k in range(6))
                x, mean = FEATURES[kind](_windows(v, size)[:block]), np.array(m)
                x = x[distances(x, mean, np.array(c).reshape(len(m), len(m))) <= bound] - mean
                sums = np.concatenate(([len(x)], x.sum(axis=0), (x.T @ x).ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([e] * len(sums), batch.schema.field(0).type), pa.array(np.arange(len(sums), dtype=np.int32)), pa.array(sums)], ["_e", "_k", "_s"])

    return run


def _new_centre(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        means, covs = [], []
        for m, sums, r in zip(pdf["_m"], pdf["_sums"], pdf["_r"]):
            d = len(m)
            n, total, products = sums[0], np.array(sums[1 : d + 1]), np.array(sums[d + 1 :]).reshape(d, d)
            means.append((np.array(m) + total / n).tolist())
            covs.append(((products - np.outer(total, total) / n) / max(1, n - 1) + r * np.eye(d)).ravel().tolist())
        yield pd.DataFrame({"_e": pdf["_e"], "_m": means, "_c": covs, "_r": pdf["_r"]})


def robust_centres(dealt: DataFrame, kind: str, size: int, block: int = BLOCK) -> DataFrame:
    """_e, mean _m and covariance _c of the half of each entity's windows with the least spread, and the ridge _r."""
    e = dealt.schema["_e"].dataType.simpleString()
    centre = f"_e {e}, _m array<double>, _c array<double>"
    drawn = staged(dealt.select("_e", "_b", "_n", "_v").mapInArrow(_drawn(kind, size, block), f"_e {e}, _k int, _w array<double>"))
    few = drawn.groupBy("_e", "_k").applyInPandas(_few_centres, centre)
    now = staged(drawn.groupBy("_e").cogroup(few.groupBy("_e")).applyInArrow(_pooled, f"{centre}, _r double"))
    for _ in range(STEPS):
        given = dealt.join(small(now), "_e")
        measured = given.select("_e", "_b", "_v", "_m", "_c").mapInArrow(_measured(kind, size, block), f"_e {e}, _i long, _d double")
        bound = measured.groupBy("_e").agg(F.percentile_approx("_d", 0.5, 10_000).alias("_bound"))
        sums = given.join(small(staged(bound)), "_e").select("_e", "_b", "_v", "_m", "_c", "_bound").mapInArrow(_outer_sums(kind, size, block), f"_e {e}, _k int, _s double")
        listed = sums.groupBy("_e", "_k").agg(F.sum("_s").alias("_s")).groupBy("_e").agg(F.array_sort(F.collect_list(F.struct("_k", "_s"))).alias("_l"))
        now = staged(now.join(listed.select("_e", F.col("_l._s").alias("_sums")), "_e").mapInPandas(_new_centre, f"{centre}, _r double"))
    return now


# from windows to rows


def laid_over(series: DataFrame, scores: DataFrame, windows, names: list[str]) -> DataFrame:
    """_e, _t and scores of each row from those of ``windows`` windows (_e, _i): a line between them, 0 at least."""
    place = F.col("_i") * (windows - 1) / F.greatest(F.col("_n") - 1, F.lit(1))
    at = series.select("_e", "_t", "_i", place.alias("_p")).withColumn("_j", F.floor("_p")).groupBy("_e", "_t").agg(F.min_by(F.struct("_p", "_j"), "_i").alias("_r")).select("_e", "_t", "_r._p", "_r._j")
    left, right = (scores.select("_e", (F.col("_i") - k).alias("_j"), *(F.col(n).alias(f"{n}_{k}") for n in names)) for k in (0, 1))
    met = at.join(left, ["_e", "_j"], "left").join(right, ["_e", "_j"], "left")
    part = F.col("_p") - F.col("_j")
    line = lambda n: F.greatest(F.lit(0.0), F.coalesce(F.col(f"{n}_0") + part * (F.coalesce(f"{n}_1", f"{n}_0") - F.col(f"{n}_0")), F.lit(0.0)))
    return met.select("_e", "_t", *(line(n).alias(n) for n in names))


def _centred(series: DataFrame, value: str = "_x") -> DataFrame:
    return series.withColumn(value, F.col(value) - F.avg(value).over(Window.partitionBy("_e")))


def robust_scores(rows: DataFrame, size: int, scale: bool, kind: str = "plain", centred: bool = True, of_gaps: bool = False, divide: float = 1.0, block: int = BLOCK) -> DataFrame:
    """_e, _t and the robust distance ``score``, divided by ``divide``, of values or of the gaps between times."""
    series = filled(rows, scale)
    if of_gaps:
        order = Window.partitionBy("_e").orderBy("_i")
        ahead, behind = F.lead("_s").over(order), F.lag("_s").over(order)
        series = series.withColumn("_x", F.coalesce((ahead - behind) / 2, ahead - F.col("_s"), F.col("_s") - behind, F.lit(0.0)))
    series = staged(_centred(series) if centred else series)
    dealt = staged(blocks(series, size, block=block))
    e = dealt.schema["_e"].dataType.simpleString()
    given = dealt.join(small(robust_centres(dealt, kind, size, block)), "_e").select("_e", "_b", "_v", "_m", "_c")
    found = given.mapInArrow(_measured(kind, size, block), f"_e {e}, _i long, _d double").select("_e", "_i", (F.col("_d") / divide).alias("score"))
    return laid_over(series, staged(found), F.col("_n") - size + 1, ["score"])


# energies


def _energies(size: int, step: int, block: int):
    from tidewell.operators.anomaly import window_energy

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                e, b, v = (batch.column(k)[i].as_py() for k in range(3))
                w = _windows(v, size)[:block]
                places = np.arange(len(w)) + b * block
                mine = places % step == 0
                energy = window_energy(w[mine])
                yield pa.RecordBatch.from_arrays([pa.array([e] * len(energy), batch.schema.field(0).type), pa.array(places[mine] // step), pa.array(energy)], ["_e", "_i", "energy"])

    return run


def spectral_scores(rows: DataFrame, size: int, scale: bool, names: dict[str, str], block: int = BLOCK) -> DataFrame:
    """_e, _t and, under the names given for them, score, inverse and energy."""
    size, overlap = window_and_overlap(size)
    step = max(1, size - overlap)
    series = staged(filled(rows, scale))
    e = series.schema["_e"].dataType.simpleString()
    dealt = blocks(series, size, block=block).select("_e", "_b", "_v")
    energy = staged(dealt.mapInArrow(_energies(size, step, block), f"_e {e}, _i long, energy double"))
    whole = Window.partitionBy("_e")

    def score(c):
        spread = F.stddev_pop(c).over(whole)
        return F.abs(c - F.avg(c).over(whole)) / F.when(spread > 0, spread).otherwise(1.0) * 100 / 2.8

    scored = staged(energy.withColumns({"score": score(F.col("energy")), "inverse": score(1 / F.greatest("energy", F.lit(1e-9)))}).select("_e", "_i", *(F.col(k).alias(n) for k, n in names.items())))
    return laid_over(series, scored, F.expr(f"(_n - {size}) div {step} + 1"), list(names.values()))


# clusters


def _first_centres(pdf: pd.DataFrame) -> pd.DataFrame:
    from tidewell.operators.anomaly import k_means

    centres, _ = k_means(np.array(pdf["_w"].tolist()))
    return pd.DataFrame({"_e": [pdf["_e"].iloc[0]], "_m": [centres.ravel().tolist()]})


def _cluster_sums(size: int, block: int):
    """Blocks with their centres to each centre's number of windows and sum of values."""
    from tidewell.operators.anomaly import _nearest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                e, v, m = (batch.column(k)[i].as_py() for k in range(3))
                w, centres = _windows(v, size)[:block], np.array(m).reshape(-1, size)
                of = _nearest(w, centres).argmin(axis=1)
                sums = np.zeros((len(centres), size + 1))
                np.add.at(sums, of, np.column_stack((np.ones(len(w)), w)))
                yield pa.RecordBatch.from_arrays([pa.array([e] * sums.size, batch.schema.field(0).type), pa.array(np.arange(sums.size, dtype=np.int32)), pa.array(sums.ravel())], ["_e", "_k", "_s"])

    return run


def _moved_centres(size: int, last: bool):
    """Centres and their sums to the next centres; the last time to the large ones alone."""
    from tidewell.operators.anomaly import large_clusters

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for m, sums in zip(pdf["_m"], pdf["_sums"]):
                centres, sums = np.array(m).reshape(-1, size), np.array(sums).reshape(-1, size + 1)
                if last:
                    centres = centres[large_clusters(sums[:, 0])]
                else:
                    centres = np.where(sums[:, :1] > 0, sums[:, 1:] / np.maximum(1, sums[:, :1]), centres)
                out.append(centres.ravel().tolist())
            yield pd.DataFrame({"_e": pdf["_e"], "_m": out})

    return run


def _cluster_distances(size: int, block: int):
    from tidewell.operators.anomaly import _nearest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                e, b, v, m = (batch.column(k)[i].as_py() for k in range(4))
                found = np.sqrt(_nearest(_windows(v, size)[:block], np.array(m).reshape(-1, size)).min(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array([e] * len(found), batch.schema.field(0).type), pa.array(np.arange(len(found)) + b * block), pa.array(found)], ["_e", "_i", "score"])

    return run


def cluster_scores(rows: DataFrame, size: int, scale: bool, block: int = BLOCK) -> DataFrame:
    """_e, _t and the distance ``score`` to the centre of the nearest large cluster."""
    series = staged(filled(rows, scale))
    dealt = staged(blocks(series, size, block=block))
    e = dealt.schema["_e"].dataType.simpleString()
    drawn = dealt.select("_e", "_b", "_n", "_v").mapInArrow(_drawn("plain", size, block), f"_e {e}, _k int, _w array<double>")
    now = staged(drawn.groupBy("_e").applyInPandas(_first_centres, f"_e {e}, _m array<double>"))
    for step in range(STEPS + 1):
        sums = dealt.join(small(now), "_e").select("_e", "_v", "_m").mapInArrow(_cluster_sums(size, block), f"_e {e}, _k int, _s double")
        listed = sums.groupBy("_e", "_k").agg(F.sum("_s").alias("_s")).groupBy("_e").agg(F.array_sort(F.collect_list(F.struct("_k", "_s"))).alias("_l"))
        now = staged(now.join(listed.select("_e", F.col("_l._s").alias("_sums")), "_e").select("_e", "_m", "_sums").mapInPandas(_moved_centres(size, step == STEPS), f"_e {e}, _m array<double>"))
    found = dealt.join(small(now), "_e").select("_e", "_b", "_v", "_m").mapInArrow(_cluster_distances(size, block), f"_e {e}, _i long, score double")
    return laid_over(series, staged(found), F.col("_n") - size + 1, ["score"])


# change points


def _segments(block: int):
    """A block's rows to SEGMENTS segments: where each ends, and its sums of values and squares."""
    from tidewell.operators.anomaly import change_points

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array(pdf["_v"].iloc[0], float)
        ends = np.array([*change_points(x, SEGMENTS), len(x)])
        sums = np.cumsum((x, x * x), axis=1)[:, ends - 1]
        return pd.DataFrame({"_e": pdf["_e"].iloc[0], "_to": ends + pdf["_b"].iloc[0] * block, "_s1": np.diff(sums[0], prepend=0.0), "_s2": np.diff(sums[1], prepend=0.0)})

    return run


def _change_points(pdf: pd.DataFrame) -> pd.DataFrame:
    from tidewell.operators.anomaly import merged_segments

    pdf = pdf.sort_values("_to")
    sums = np.concatenate(([[0.0], [0.0]], np.cumsum((pdf["_s1"], pdf["_s2"]), axis=1)), axis=1)
    return pd.DataFrame({"_e": [pdf["_e"].iloc[0]], "_points": [merged_segments([0, *pdf["_to"].tolist()], sums, 15)]})


def change_scores(rows: DataFrame, size: int, scale: bool, block: int = BLOCK) -> DataFrame:
    """_e, _t and a bump ``score`` around each change point, as wide as half a window."""
    series = staged(filled(rows, scale))
    e = series.schema["_e"].dataType.simpleString()
    dealt = blocks(series, 1, block=block)
    segments = dealt.groupBy("_e", "_b").applyInPandas(_segments(block), f"_e {e}, _to long, _s1 double, _s2 double")
    points = segments.groupBy("_e").applyInPandas(_change_points, f"_e {e}, _points array<long>")
    firsts = series.groupBy("_e", "_t").agg(F.min("_i").alias("_i")).join(small(staged(points)), "_e")
    wide = max(1.0, size / 2)
    bump = F.transform("_points", lambda p: F.exp(-0.5 * ((F.col("_i") - p) / wide) * ((F.col("_i") - p) / wide)))
    return firsts.select("_e", "_t", F.coalesce(F.array_max(bump), F.lit(0.0)).alias("score"))


# matrix profile


def _pair_minima(size: int, block: int):
    """Pairs of blocks to the least squared distance of each window of either to one of the other that is far enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apart = max(1, size // 2)
        for batch in batches:
            for i in range(batch.num_rows):
                e, a, va, b, vb = (batch.column(k)[i].as_py() for k in range(5))
                one, other = (_windows(v, size)[:block] for v in (va, vb))
                squares = [(w * w).sum(axis=1) for w in (one, other)]
                rows, columns = np.full(len(one), np.inf), np.full(len(other), np.inf)
                for s in range(0, len(one), 512):
                    d = np.maximum(0, squares[0][s : s + 512, None] - 2 * one[s : s + 512] @ other.T + squares[1])
                    gap = np.abs((np.arange(s, s + len(d)) + a * block)[:, None] - (np.arange(len(other)) + b * block))
                    d[gap < apart] = np.inf
                    rows[s : s + 512] = d.min(axis=1)
                    columns = np.minimum(columns, d.min(axis=0))
                yield pa.RecordBatch.from_arrays([pa.array([e, e], batch.schema.field(0).type), pa.array([a, b], pa.int64()), pa.array([rows, columns], pa.list_(pa.float64()))], ["_e", "_b", "_d"])

    return run


def _merged(block: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        least = np.sqrt(np.minimum.reduce([np.asarray(d) for d in pdf["_d"]]))
        least[~np.isfinite(least)] = 0.0
        return pd.DataFrame({"_e": pdf["_e"].iloc[0], "_i": np.arange(len(least)) + pdf["_b"].iloc[0] * block, "score": least})

    return run


def profile_scores(rows: DataFrame, size: int, scale: bool, block: int = BLOCK) -> DataFrame:
    """_e, _t and the distance ``score`` of each row's window to its nearest one that does not overlap by over half; 1e-15 where none starts."""
    series = staged(filled(rows, scale))
    e = series.schema["_e"].dataType.simpleString()
    dealt = staged(blocks(series, size, block=block))
    other = dealt.select("_e", F.col("_b").alias("_o"), F.col("_v").alias("_u"))
    pairs = dealt.select("_e", "_b", "_v").join(other, "_e").where("_b <= _o").select("_e", "_b", "_v", "_o", "_u")
    minima = pairs.mapInArrow(_pair_minima(size, block), f"_e {e}, _b long, _d array<double>")
    found = minima.groupBy("_e", "_b").applyInPandas(_merged(block), f"_e {e}, _i long, score double")
    firsts = series.groupBy("_e", "_t").agg(F.min("_i").alias("_i"))
    return firsts.join(found, ["_e", "_i"], "left").select("_e", "_t", F.coalesce("score", F.lit(1e-15)).alias("score"))
