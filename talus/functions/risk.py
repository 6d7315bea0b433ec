"""Risk rules as column expressions and small policy tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The order of the canonical features.
CANONICAL = (
    "kyc_level", "min_retention_minutes", "retention_event_count", "high_speed_risk", "unique_ip_count", "ip_anomaly",
    "total_twd_volume", "volume_zscore", "asymmetry_flag", "min_hops_to_blacklist", "is_direct_neighbor",
    "blacklist_neighbor_count", "in_blacklist_network", "mule_risk_score", "twd_deposit_count", "twd_withdraw_count",
    "crypto_deposit_count", "crypto_withdraw_count", "night_tx_ratio",
)
# What a user without any record gets.
COLD_START = {
    "kyc_level": 0, "min_retention_minutes": 9999.0, "high_speed_risk": 0, "unique_ip_count": 1, "ip_anomaly": 0,
    "total_twd_volume": 0.0, "volume_zscore": 0.0, "asymmetry_flag": 0, "min_hops_to_blacklist": 4, "is_direct_neighbor": 0,
    "blacklist_neighbor_count": 0, "in_blacklist_network": 0, "mule_risk_score": 0, "crypto_withdraw_count": 0,
    "twd_deposit_count": 0, "twd_withdraw_count": 0,
}
# The bounds that perturbed features are held in.
BOUNDS = {
    "kyc_level": (0.0, 2.0), "min_retention_minutes": (0.0, 14400.0), "retention_event_count": (0.0, 10000.0), "high_speed_risk": (0.0, 1.0),
    "unique_ip_count": (1.0, 100.0), "ip_anomaly": (0.0, 1.0), "total_twd_volume": (0.0, 1e9), "volume_zscore": (-5.0, 20.0),
    "asymmetry_flag": (0.0, 1.0), "min_hops_to_blacklist": (0.0, 4.0), "is_direct_neighbor": (0.0, 1.0), "blacklist_neighbor_count": (0.0, 500.0),
    "in_blacklist_network": (0.0, 1.0), "mule_risk_score": (0.0, 4.0), "twd_deposit_count": (0.0, 50000.0), "twd_withdraw_count": (0.0, 50000.0),
    "crypto_deposit_count": (0.0, 50000.0), "crypto_withdraw_count": (0.0, 50000.0), "night_tx_ratio": (0.0, 1.0),
}
# The two action policies: tier, action, automatic, priority, report hours, freeze days, daily limit, new KYC, watch days.
POLICIES = {
    "batch": (
        ("EXTREME", "FREEZE_ACCOUNT", True, 1, 24, 30, None, False, None, ("freeze trading", "file a report", "preserve evidence", "open an investigation")),
        ("HIGH", "CALL_VERIFY", False, 2, None, None, 50000, False, 30, ("limit withdrawals", "call the customer", "ask for proof of funds", "score again")),
        ("BOUNDARY", "CALL_VERIFY", False, 2, None, None, 50000, False, 30, ("limit withdrawals", "call the customer", "ask for proof of funds", "score again")),
        ("MEDIUM", "MONITOR", True, 4, None, None, None, False, 60, ("watch closely", "set alerts", "score again")),
        ("LOW", "MONITOR", True, 4, None, None, None, False, 60, ("watch closely", "set alerts", "score again")),
    ),
    "event": (
        ("EXTREME", "FREEZE_ACCOUNT", True, 1, 24, 30, None, False, None, ("freeze trading", "file a report", "preserve evidence", "open an investigation")),
        ("HIGH", "LOCK_ACCOUNT", True, 2, None, 7, None, True, None, ("lock withdrawals", "call the customer", "ask for proof of funds", "repeat KYC")),
        ("BOUNDARY", "ENHANCED_KYC", False, 3, None, None, 30000, True, 60, ("limit withdrawals", "ask for documents", "review KYC", "watch closely")),
        ("MEDIUM", "WATCH_ONLY", True, 4, None, None, None, False, 60, ("watch closely", "set alerts")),
        ("LOW", "WATCH_ONLY", True, 4, None, None, None, False, 60, ("watch closely", "set alerts")),
    ),
}
POLICY_SCHEMA = "tier string, primary_action string, auto_executable boolean, execution_priority int, str_deadline_hours int, freeze_duration_days int, daily_withdrawal_limit_twd int, require_kyc_upgrade boolean, watchlist_days int, steps array<string>"


def hop_risk_level(hops: Column) -> Column:
    return F.when(hops == 0, "blacklist").when(hops == 1, "direct").when(hops == 2, "indirect_2").when(hops == 3, "indirect_3").otherwise("isolated")


def weighted_label(hops: Column, ip_shared: Column, high_speed: Column) -> Column:
    """The first rule that holds: three signals together, then the distance alone."""
    return (
        F.when((hops <= 2) & (ip_shared > 3) & high_speed, "HIGH_WEIGHTED").when(hops == 0, "BLACKLIST").when(hops == 1, "HIGH").when(hops.isin(2, 3), "MEDIUM").otherwise("LOW")
    )


def mule_score(high_speed: Column, ip_anomaly: Column, asymmetry: Column, hops: Column) -> Column:
    flags = (high_speed, ip_anomaly, asymmetry, hops.isin(1, 2))
    return sum((F.coalesce(f.cast("boolean"), F.lit(False)).cast("int") for f in flags), F.lit(0))


def asymmetry_flag(level: Column, volume: Column, zscore: Column, l0: float = 1e5, l1: float = 1e6) -> Column:
    """Volume above what the level allows, or three deviations off its level's mean."""
    return F.coalesce(((level == 0) & (volume > l0)) | ((level == 1) & (volume > l1)), F.lit(False)) | F.coalesce(F.abs(zscore) > 3, F.lit(False))


def asymmetry_reason(level: Column, volume: Column, zscore: Column, l0: float = 1e5, l1: float = 1e6) -> Column:
    return (
        F.when((level == 0) & (volume > l0), F.format_string("L0 volume %.2f", volume))
        .when((level == 1) & (volume > l1), F.format_string("L1 volume %.2f", volume))
        .when(F.abs(zscore) > 3, F.format_string("zscore %.2f", zscore))
    )


def tier(p: Column) -> Column:
    return F.when(p > 0.90, "EXTREME").when((p >= 0.65) & (p <= 0.75), "BOUNDARY").when(p > 0.75, "HIGH").when(p >= 0.50, "MEDIUM").otherwise("LOW")


def coarse_level(p: Column) -> Column:
    return F.when(p >= 0.75, "HIGH").when(p >= 0.50, "MEDIUM").otherwise("LOW")


def display_level(p: Column, threshold: float) -> Column:
    return F.when(p >= 0.5, "very high").when(p >= threshold, "high").when(p >= threshold / 2, "medium").otherwise("low")


def probability_bin(p: Column) -> Column:
    """Right-closed bins over (0, 1]; 0 itself is in none."""
    edges = (0.0, 0.3, 0.5, 0.65, 0.75, 0.9, 1.0)
    out = F.lit(None).cast("string")
    for low, high in reversed(list(zip(edges, edges[1:]))):
        out = F.when((p > low) & (p <= high), f"({low:g}, {high:g}]").otherwise(out)
    return out


def policy(spark: SparkSession, name: str = "batch") -> DataFrame:
    return spark.createDataFrame([(*row[:-1], list(row[-1])) for row in POLICIES[name]], POLICY_SCHEMA)


def with_actions(scored: DataFrame, name: str = "batch") -> DataFrame:
    """Each row's action by its tier; the policy has five rows."""
    return scored.join(F.broadcast(policy(scored.sparkSession, name)), "tier", "left")


def forced_freeze(df: DataFrame) -> DataFrame:
    """An EXTREME row's action is a freeze whatever was proposed."""
    forced = {"primary_action": F.lit("FREEZE_ACCOUNT"), "auto_executable": F.lit(True), "execution_priority": F.lit(1), "str_deadline_hours": F.lit(24), "freeze_duration_days": F.lit(30)}
    extreme = F.col("tier") == "EXTREME"
    return df.withColumns({c: F.when(extreme, v).otherwise(F.col(c)) for c, v in forced.items()})


def cold_start(behaviour: DataFrame, hops: DataFrame) -> DataFrame:
    """One full vector per user of either side; hops win, what is missing gets its default."""
    b, h = behaviour.alias("b"), hops.alias("h")
    joined = b.join(h, F.col("b.user_id") == F.col("h.user_id"), "full")
    out = []
    for name, default in COLD_START.items():
        sides = [F.col(f"{side}.{name}").try_cast("double") for side, df in (("h", hops), ("b", behaviour)) if name in df.columns]
        out.append(F.coalesce(*sides, F.lit(float(default))).alias(name))
    missing = F.col("b.user_id").isNull() & F.col("h.user_id").isNull()
    return joined.select(F.coalesce("b.user_id", "h.user_id").alias("user_id"), *out, missing.alias("is_cold_start"))


def ip_verdicts(unique_ips: Column, shared: Column, retention: Column) -> dict[str, Column]:
    return {
        "ip_spread": F.when(unique_ips.isNull(), None).when(unique_ips > 5, "many places").otherwise("normal"),
        "ip_sharing": F.when(shared.isNull(), None).when(shared > 10, "cluster").when(shared > 3, "group").when(shared > 1, "pair").otherwise("alone"),
        "retention": F.when(retention.isNull(), None).when(retention < 10, "pass-through").when(retention < 30, "short").otherwise("normal"),
    }


def cold_wallet_alert(crypto_out: Column, twd_out: Column) -> Column:
    return F.coalesce((F.try_divide(crypto_out, crypto_out + twd_out) >= 0.7) & (crypto_out >= 3), F.lit(False))


def clipped(df: DataFrame, bounds: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Known features held in their bounds."""
    known = {k: v for k, v in (bounds or BOUNDS).items() if k in df.columns}
    return df.withColumns({c: F.greatest(F.lit(lo), F.least(F.lit(hi), F.col(c).cast("double"))) for c, (lo, hi) in known.items()})
