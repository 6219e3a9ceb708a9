"""Fleet questions: which devices exist, how fresh are they, which groups need care.

Facts are reduced to one row per device before they meet the device table, so the
joins are small and a device with a third of all readings costs no more than another.
No join is forced into a broadcast: Spark knows the size of the reduced sides at run
time and decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fleetlens.functions.expressions import (
    OFFLINE_SECONDS,
    ONLINE_SECONDS,
    device_status,
    seconds_between,
    status_of_rank,
    status_rank,
    timestamp_at,
)
from fleetlens.operators.series import latest_per_device

NO_LOCATION = "—"  # fixed value: label of devices without a location


def seen_only(rows: DataFrame, heartbeats: DataFrame) -> DataFrame:
    """Rows of devices that have reported at least once."""
    return rows.join(heartbeats.select("device"), "device", "left_semi")


def device_list(devices: DataFrame, readings: DataFrame, heartbeats: DataFrame) -> DataFrame:
    """Seen devices with the sorted list of their metrics, empty if there are none."""
    metrics = (
        readings.filter(F.col("metric").isNotNull())
        .select("device", "metric")
        .distinct()
        .groupBy("device")
        .agg(F.sort_array(F.collect_list("metric")).alias("metrics"))
    )
    empty = F.array().cast("array<string>")
    return (
        seen_only(devices, heartbeats)
        .join(metrics, "device", "left")
        .withColumn("metrics", F.coalesce("metrics", empty))
        .orderBy("device")
    )


def open_counts(anomalies: DataFrame) -> DataFrame:
    """Open anomalies per device; devices without any are absent."""
    still_open = anomalies.filter(F.col("resolved_at").isNull())
    return still_open.groupBy("device").agg(F.count(F.lit(1)).alias("open_anomalies"))


def fleet_overview(
    devices: DataFrame,
    readings: DataFrame,
    heartbeats: DataFrame,
    anomalies: DataFrame,
    only_seen: bool = False,
) -> DataFrame:
    """Latest reading, last contact and open anomalies per device, seen or not."""
    latest = latest_per_device(readings)
    unit = ["unit"] if "unit" in latest.columns else []
    return (
        devices.join(
            heartbeats.select("device", "last_seen_at"), "device", "inner" if only_seen else "left"
        )
        .join(latest, "device", "left")
        .join(open_counts(anomalies), "device", "left")
        .select(
            "device",
            "kind",
            "location",
            "metric",
            F.col("value").cast("double").alias("last_value"),
            *unit,
            F.col("sampled_at").alias("last_reading"),
            "last_seen_at",
            F.coalesce("open_anomalies", F.lit(0).cast("long")).alias("open_anomalies"),
        )
        .orderBy(F.col("open_anomalies").desc(), "device")
    )


def fleet(
    devices: DataFrame,
    readings: DataFrame,
    heartbeats: DataFrame,
    anomalies: DataFrame,
    as_of,
    online: float = ONLINE_SECONDS,
    stale: float = OFFLINE_SECONDS,
) -> DataFrame:
    """The overview of seen devices with staleness and status at `as_of`."""
    rows = fleet_overview(devices, readings, heartbeats, anomalies, only_seen=True)
    age = seconds_between(F.col("last_seen_at"), timestamp_at(as_of))
    return rows.withColumn("staleness_s", age).withColumn(
        "status", device_status(F.col("staleness_s"), online, stale)
    )


def filter_fleet(rows: DataFrame, location: str | None = None, kind: str | None = None) -> DataFrame:
    """Optional filters; an empty choice keeps everything."""
    if location:
        rows = rows.filter(_place() == location)
    if kind:
        rows = rows.filter(F.col("kind") == kind)
    return rows


def _place():
    return F.coalesce("location", F.lit(NO_LOCATION))


def fleet_groups(rows: DataFrame, by: str = "location") -> DataFrame:
    """Devices, open anomalies and worst status per location or kind."""
    group = _place() if by == "location" else F.col(by)
    return (
        rows.groupBy(group.alias("group"))
        .agg(
            F.count(F.lit(1)).alias("devices"),
            F.sum("open_anomalies").alias("open_anomalies"),
            F.max(status_rank(F.col("status"))).alias("_worst"),
        )
        .select("group", "devices", "open_anomalies", status_of_rank(F.col("_worst")).alias("worst"))
    )


def fleet_totals(rows: DataFrame, by: str = "location") -> DataFrame:
    """One row of totals over the (filtered) fleet, from per-group partial sums."""
    group = _place() if by == "location" else F.col(by)
    per_status = {
        name: F.count(F.when(F.col("status") == name, F.lit(1)))
        for name in ("online", "stale", "offline")
    }
    grouped = rows.groupBy(group.alias("_group")).agg(
        F.count(F.lit(1)).alias("devices"),
        F.sum("open_anomalies").alias("open_anomalies"),
        *[count.alias(name) for name, count in per_status.items()],
    )
    sums = [
        F.coalesce(F.sum(name), F.lit(0).cast("long")).alias(name)
        for name in ("devices", *per_status, "open_anomalies")
    ]
    return grouped.agg(F.count(F.lit(1)).alias("groups"), *sums)


def default_metric(readings: DataFrame, device=None) -> DataFrame:
    """The metric each device reported last; optionally for one device."""
    rows = readings if device is None else readings.filter(F.col("device") == F.lit(device))
    return latest_per_device(rows, carry=()).select("device", "metric")


def staleness(
    devices: DataFrame, heartbeats: DataFrame, as_of, include_unseen: bool = False
) -> DataFrame:
    """Seconds since the last contact, never-seen devices first when included."""
    how = "left" if include_unseen else "inner"
    age = seconds_between(F.col("last_seen_at"), timestamp_at(as_of)).alias("staleness_s")
    return (
        devices.select("device")
        .join(heartbeats.select("device", "last_seen_at"), "device", how)
        .select("device", "last_seen_at", age)
        .orderBy(F.col("staleness_s").desc_nulls_first(), "device")
    )


def consumers(offsets: DataFrame) -> DataFrame:
    return offsets.select("consumer", "topic", "partition", "last_offset", "updated_at").orderBy(
        "topic", "partition", "consumer"
    )

