"""Linking of sites: aligned correlations, best lags, greedy groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .series import row_shifts


def aligned_pairs(series: DataFrame) -> DataFrame:
    """p1 < p2 and their values at common times: an equi-join on time, as wide as there are sites."""
    a = series.select(F.col("project").alias("p1"), "hour", F.col("y").alias("y1"))
    b = series.select(F.col("project").alias("p2"), "hour", F.col("y").alias("y2"))
    return a.join(b, (F.col("p1") < F.col("p2")) & (a["hour"] == b["hour"])).select(a["hour"], "p1", "y1", "p2", "y2")


def best_lags(series: DataFrame, reach: int = 4) -> DataFrame:
    """For each pair of sites, the row shift of the second from -reach to reach of highest correlation; zero first, then by size, wins ties."""
    shifts = list(range(-reach, reach + 1))
    pairs = row_shifts(aligned_pairs(series), "hour", shifts, "y2", ("p1", "p2"), ("y1",))
    corr = pairs.groupBy("p1", "p2").agg(*[F.corr("y1", f"shift_{'m' if s < 0 else ''}{abs(s)}").alias(str(s)) for s in shifts])
    long = corr.unpivot(["p1", "p2"], [str(s) for s in range(-reach, reach + 1)], "shift", "corr").withColumn("shift", F.col("shift").cast("int"))
    long = long.filter("corr IS NOT NULL")
    order = F.struct(F.round("corr", 9), -F.abs("shift"), -F.col("shift"))
    return long.groupBy("p1", "p2").agg(F.max_by("shift", order).alias("lag"), F.max("corr").alias("corr"))


def transfer_groups(links: DataFrame, threshold: float) -> list[set[str]]:
    """Groups of sites over pairs whose correlation is above the threshold, strongest first; one row for each pair of sites reaches the driver."""
    groups: list[set[str]] = []
    for r in links.filter(F.col("corr") > threshold).orderBy(F.desc("corr"), "p1", "p2").collect():
        home = [g for g in groups if r.p1 in g or r.p2 in g]
        if not home:
            groups.append({r.p1, r.p2})
        elif len(home) == 1:
            home[0].update((r.p1, r.p2))
    return groups


def grouped(corr: dict[tuple[str, str], float], threshold: float) -> list[set[str]]:
    """Groups of sites by correlations of pairs (few, on the driver): pairs above the threshold, the strongest first, start a group or join one of theirs; then `settled`."""
    groups: list[set[str]] = []
    for (a, b), c in sorted(corr.items(), key=lambda x: (-x[1], x[0])):
        if c <= threshold:
            break
        home = [g for g in groups if a in g or b in g]
        if home:
            for g in home:
                g.update((a, b))
        else:
            groups.append({a, b})
    return settled(groups, corr)


def settled(groups: list[set[str]], corr: dict[tuple[str, str], float]) -> list[set[str]]:
    """Groups without subsets of others, each site in one only: the one to whose members its correlations sum highest (ties: the first); groups that are left with one site go."""
    kept = [g for n, g in enumerate(groups) if not any(g < h or (g == h and m < n) for m, h in enumerate(groups))]
    of = lambda a, b: corr.get((a, b), corr.get((b, a), 0.0))
    out = [set() for _ in kept]
    for site in sorted(set().union(*kept)):
        home = [n for n, g in enumerate(kept) if site in g]
        best = max(home, key=lambda n: (sum(of(site, other) for other in kept[n] if other != site), -n))
        out[best].add(site)
    return [g for g in out if len(g) > 1]
