"""Feature assembly and scalar features, as column expressions.

Nulls in an input array propagate to the features made of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def array_mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def array_std(a: Column) -> Column:
    """Population deviation."""
    m = array_mean(a)
    return F.sqrt(F.aggregate(F.transform(a, lambda x: (x - m) * (x - m)), F.lit(0.0), lambda s, x: s + x) / F.size(a))


def array_quantile(a: Column, q: float) -> Column:
    """Quantile with linear interpolation."""
    s = F.array_sort(a)
    h = (F.size(a) - 1) * F.lit(q)
    lo = F.floor(h).cast("int")
    x, y = F.get(s, lo), F.get(s, F.least(lo + 1, F.size(a) - 1))
    return x + (h - lo) * (y - x)


def feature_matrix(df: DataFrame, k: int, blocks: dict[str, int] | None = None, distances: str = "distances") -> tuple[DataFrame, list[str]]:
    """``df`` with ``features`` and the names of its places: distances, their row statistics, then the other blocks.

    A missing distances column, or an array of another width than said, is an error when the row is computed.
    """
    blocks = blocks or {}
    if distances not in df.columns:
        raise ValueError(f"no column {distances}")
    d = F.col(distances).cast("array<double>")
    wide = lambda c, n: F.when(F.size(c) == n, c).otherwise(F.raise_error(F.concat(F.lit(f"wrong width of a block, not {n}: "), F.size(c).cast("string"))))
    d = wide(d, k)
    stats = F.array(array_mean(d), F.array_min(d), F.array_max(d), array_std(d), *[array_quantile(d, q) for q in (0.25, 0.5, 0.75)])
    names = [f"d_{i + 1}" for i in range(k)] + ["d_mean", "d_min", "d_max", "d_std", "d_q25", "d_q50", "d_q75"]
    parts = [d, stats]
    for b, n in blocks.items():
        c = wide(F.col(b).cast("array<double>"), n)
        parts.append(c)
        names += [f"{b}_{i + 1}" for i in range(n)]
        if b == "anchor_type_freqs":
            parts.append(F.array(F.size(F.filter(c, lambda x: x > 0)).cast("double")))
            names.append("anchor_source_diversity")
    return df.withColumn("features", F.concat(*parts)), names


def haar_step(a: Column) -> tuple[Column, Column]:
    """Pairwise halves of sums and of differences; an odd last value is dropped."""
    n = F.floor(F.size(a) / 2).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: (F.get(a, 2 * i) + F.get(a, 2 * i + 1)) / 2), F.transform(at, lambda i: (F.get(a, 2 * i) - F.get(a, 2 * i + 1)) / 2)


def haar_level2(a: Column) -> Column:
    """[low2, high2, high1] padded with zeros to the length of the input; [low1, high1] for two or three values."""
    low1, high1 = haar_step(a)
    low2, high2 = haar_step(low1)
    x = F.when(F.size(a) < 4, F.concat(low1, high1)).otherwise(F.concat(low2, high2, high1))
    return F.concat(x, F.array_repeat(F.lit(0.0), F.greatest(F.size(a) - F.size(x), F.lit(0))))


def wavelet_features(a: Column) -> Column:
    return F.concat(a, haar_level2(a))


def sensitivity(r: Column) -> tuple[Column, Column]:
    """(E, gamma): linear heuristics of |r|."""
    rr = 1 + 4 * F.abs(r)
    return rr + F.sqrt(rr * (rr - 1)), 1 + 2 * F.abs(r)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct values; 1 if both are empty."""
    u = F.size(F.array_union(a, b))
    return F.when(u == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / u)


def pull_margin(m0: float, j: Column) -> Column:
    return F.lit(m0) * (1 - j)


def pq_footprint(n: Column, d: Column, m: Column) -> tuple[Column, Column, Column]:
    """Raw bytes, quantised bytes, their ratio."""
    return n * d * 4, n * m, 4 * d / m


#: Largest loss of average precision and least recall at which quantised vectors do.
MAX_DROP, MIN_RECALL = 0.01, 0.93


def use_pq(ap_full: Column, ap_pq: Column, recall: Column, max_drop: float = MAX_DROP, min_recall: float = MIN_RECALL) -> Column:
    """Whether quantised vectors may stand for the exact ones."""
    return (ap_full - ap_pq <= max_drop) & (recall >= min_recall)


def sample_size(p: Column, e: float, z: float = 1.96) -> Column:
    return F.ceil(z * z * p * (1 - p) / (e * e))


#: Least and largest share of a pool that is drawn for a random audit.
AUDIT_SHARES = {"clear": (0.001, 0.01), "block": (0.01, 0.05)}


def audit_range(pool: Column, kind: str) -> tuple[Column, Column]:
    """Least and largest number of audited rows of a pool of cleared or blocked ones."""
    low, high = AUDIT_SHARES[kind]
    return F.ceil(pool * F.lit(low)).cast("long"), F.ceil(pool * F.lit(high)).cast("long")


#: A prime below 2^20: squares of what is below it, and sums with them, are whole numbers of 64 bits on any engine.
PRIME = 1_000_003


def hashed_unit(key: Column, place: Column, seed: int) -> Column:
    """A number in [0, 1) for a key and a place, by quadratic mixing in whole numbers: the same on every engine."""
    x = F.pmod(F.pmod(key, F.lit(PRIME)) * 7919 + place * 104_729 + seed * 31, F.lit(PRIME))
    for add in (12_345, 54_321, 777):
        x = F.pmod(x * x + x + add, F.lit(PRIME))
    return x / float(PRIME)


def masked(a: Column, key: Column, rate: float, seed: int) -> Column:
    """Each place set to zero with probability ``rate``, by a hash of the row's key and the place."""
    return F.transform(a, lambda x, i: F.when(hashed_unit(key, i, seed) < rate, F.lit(0.0)).otherwise(x))


def perturbed(a: Column, key: Column, sigma: float, seed: int) -> Column:
    """Gaussian noise from two hashes per place (Box-Muller)."""
    u = lambda i, s: hashed_unit(key, i, seed + s) + 0.5 / PRIME
    return F.transform(a, lambda x, i: x + sigma * F.sqrt(-2 * F.log(u(i, 0))) * F.cos(6.283185307179586 * u(i, 1)))
