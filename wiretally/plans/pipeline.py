"""Packets to alerts, offline and live."""

from __future__ import annotations

from pyspark.sql import DataFrame

from wiretally.operators.alerts import COOLDOWN_S, passed
from wiretally.operators.correlate import SLAB_S as THREAT_SLAB_S
from wiretally.operators.correlate import THREAT_WINDOW_S, correlate
from wiretally.operators.detect import SLAB_S as WINDOW_SLAB_S
from wiretally.operators.detect import detect
from wiretally.operators.enrich import drop_allowlisted, drop_local, with_category
from wiretally.session import shared_dir


def cut(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write a table to the shared folder and read it back, so that what follows does not
    recompute it, and survives the loss of executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def offline(packets: DataFrame, rules=None, threat_window_s: int | None = THREAT_WINDOW_S,
            window_slab_s: int = WINDOW_SLAB_S, threat_slab_s: int = THREAT_SLAB_S) -> DataFrame:
    """Every firing packet of a capture is an alert.

    The slab lengths bound a task's share of one source; shorter ones spread a busier
    source further and copy more rows. They change no result.
    """
    raw = detect(packets, rules, window_slab_s)
    return with_category(correlate(raw, threat_window_s, rules, threat_slab_s), rules)


def live_alerts(packets: DataFrame, allow: DataFrame | None = None, local_ips=(), rules=None, **slabs) -> DataFrame:
    """Live alerts before the cooldown: own and allowlisted traffic is dropped first."""
    kept = drop_local(packets, local_ips)
    if allow is not None:
        kept = drop_allowlisted(kept, allow)
    return offline(kept, rules, **slabs)


def live(packets: DataFrame, allow: DataFrame | None = None, local_ips=(), rules=None,
         cooldown_s: int = COOLDOWN_S, **slabs) -> DataFrame:
    """Live alerts, repeated ones held back by the cooldown."""
    return passed(cut(live_alerts(packets, allow, local_ips, rules, **slabs), "alerts"), span_s=cooldown_s)
