"""Gaussian mechanism on teacher votes."""

from __future__ import annotations

import math
import secrets

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrortab.functions import gaussian01


def gaussian_sigma(epsilon: float, delta: float) -> float:
    """Noise scale of the Gaussian mechanism for one query of sensitivity 1."""
    return math.sqrt(2.0 * math.log(1.25 / delta)) / epsilon


def composed_epsilon(epsilon: float, queries: int) -> float:
    """Privacy spent over several queries by basic composition."""
    return epsilon * queries


def renyi_epsilon(rho: float, delta: float) -> float:
    """Epsilon at ``delta`` of Gaussian releases whose Renyi divergence of order ``a`` is ``a * rho``.

    The smallest ``a * rho + ln(1 / delta) / (a - 1)`` over all orders, at ``1 + sqrt(ln(1 / delta) / rho)``.
    """
    return rho + 2.0 * math.sqrt(rho * math.log(1.0 / delta))


def affordable_releases(epsilon: float, delta: float, sigma: float) -> int:
    """How many releases with noise ``sigma`` cost ``epsilon`` at most."""
    log = math.log(1.0 / delta)
    return math.floor((math.sqrt(log + epsilon) - math.sqrt(log)) ** 2 * 2.0 * sigma * sigma * (1.0 + 1e-12))


def sigma_for(epsilon: float, delta: float, releases: int) -> float:
    """Noise scale with which that many releases cost ``epsilon``."""
    log = math.log(1.0 / delta)
    return math.sqrt(releases / 2.0) / (math.sqrt(log + epsilon) - math.sqrt(log))


def privacy_spent(
    releases: DataFrame, group: Sequence[str] = (), sigma: str = "sigma", delta: float = 1e-5
) -> DataFrame:
    """``(group..., n_released, rho, best_order, epsilon)`` of all released records, by Renyi composition.

    A row of ``releases`` is one record that was answered with Gaussian noise ``sigma`` at sensitivity 1;
    noise may differ from row to row.  A record that was answered twice is two rows.  A row without
    positive finite noise has no privacy: its group's ``rho`` and ``epsilon`` are infinite.
    """
    s = F.col(f"`{sigma}`").cast("double")
    noisy = s.isNotNull() & ~F.isnan(s) & (s > 0) & (s < float("inf"))
    cost = F.when(noisy, F.lit(1.0) / (F.lit(2.0) * s * s)).otherwise(F.lit(float("inf")))
    log = F.lit(math.log(1.0 / delta))
    rho = F.col("rho")
    return (
        releases.groupBy(*group).agg(F.count(F.lit(1)).alias("n_released"), F.coalesce(F.sum(cost), F.lit(0.0)).alias("rho"))
        .withColumn("best_order", F.when(rho > 0, F.lit(1.0) + F.sqrt(log / rho)))
        .withColumn("epsilon", rho + F.lit(2.0) * F.sqrt(rho * log))
    )


def noisy_vote_aggregate(
    votes: DataFrame, teachers: int, epsilon: float = 1.0, delta: float = 1e-5,
    record: str = "record", vote: str = "vote", seed: int | str | None = None,
) -> DataFrame:
    """``(record, votes, noisy_votes, label)``: summed 0/1 votes plus noise, majority at half.

    Without a seed the noise is keyed by a fresh secret, so it cannot be recomputed by a
    reader yet a retried task gets the same value.  A fixed seed is for tests only and gives
    no privacy.
    """
    seed = secrets.token_hex(16) if seed is None else seed
    sigma = gaussian_sigma(epsilon, delta)
    summed = votes.groupBy(F.col(record).alias("record")).agg(F.sum(F.col(vote).cast("bigint")).alias("votes"))
    noisy = F.col("votes") + F.lit(sigma) * gaussian01(seed, "record", "votes")
    return summed.withColumn("noisy_votes", noisy).withColumn(
        "label", (F.col("noisy_votes") / F.lit(float(teachers)) > 0.5).cast("int")
    )
