"""The allowlist of source networks."""

from __future__ import annotations

import ipaddress
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wiretally.functions.net import networks, num_ip

# Executors need not have this package installed: ship its functions by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def parse_entries(entries: DataFrame) -> DataFrame:
    """(entry, lo, hi, len) of the valid IPv4 entries in `entries(entry)`; bad ones are dropped.

    An address without a suffix is a /32 and host bits are ignored. IPv6 networks
    cannot contain an IPv4 source, so they have no range here.
    """
    return networks(entries.select("entry")).filter("len IS NOT NULL")


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """The `entries` of a JSON document `{"entries": [...]}`, as written."""
    return (spark.read.schema("entries array<string>").json(path, multiLine=True)
            .select(F.explode("entries").alias("entry")))


def read_allowlist(spark: SparkSession, path: str) -> DataFrame:
    return parse_entries(read_entries(spark, path))


def _ipv6_networks(batches):
    for pdf in batches:
        canon = []
        for e in pdf["entry"]:
            try:
                canon.append(str(ipaddress.ip_network(e, strict=False)))
            except ValueError:
                canon.append(None)
        yield pd.DataFrame({"entry": pdf["entry"], "canonical": canon})


def canonical(entries: DataFrame) -> DataFrame:
    """(entry, canonical): the network text of each entry, null when invalid."""
    v6 = F.contains(F.col("entry"), F.lit(":"))
    v4 = networks(entries.filter(~v6).select("entry")).selectExpr(
        "entry", f"CASE WHEN len IS NOT NULL THEN concat({num_ip('lo')}, '/', CAST(len AS STRING)) END AS canonical")
    return v4.unionByName(entries.filter(v6).select("entry")
                          .mapInPandas(_ipv6_networks, "entry string, canonical string"))


def allowlist_add(current: DataFrame, new: DataFrame) -> DataFrame:
    """`current(entry)` plus the canonical form of each valid new entry not yet present."""
    added = canonical(new.select("entry")).filter(F.col("canonical").isNotNull()).select(F.col("canonical").alias("entry"))
    return current.select("entry").unionByName(added).distinct()


def allowlist_remove(current: DataFrame, gone: DataFrame) -> DataFrame:
    """`current(entry)` without the given entries, in canonical form or, if invalid, as written."""
    names = canonical(gone.select("entry")).select(F.coalesce("canonical", "entry").alias("entry"))
    return current.select("entry").join(names, "entry", "left_anti")


def versions(spark: SparkSession, path: str) -> int:
    """The newest version of the allowlist kept below `path`, 0 if there is none."""
    try:
        return spark.read.schema("entry string, version int").json(path).agg(F.max("version")).first()[0] or 0
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0


def save_allowlist(entries: DataFrame, path: str) -> DataFrame:
    """Write `entries(entry)` as the next version below `path`, in canonical form; gives back those that are no network.

    A version is a folder that is written once, so a reader that has begun with one goes on with it.
    """
    spark, names = entries.sparkSession, canonical(entries)
    version = versions(spark, path) + 1
    good = names.filter(F.col("canonical").isNotNull()).select(F.col("canonical").alias("entry")).distinct()
    # a version exists even if it has no entry
    good.unionByName(spark.range(1).selectExpr("'' AS entry")).write.json(f"{path}/version={version}")
    return names.filter(F.col("canonical").isNull()).select("entry")


def latest(spark: SparkSession, path: str, version: int | None = None) -> tuple[DataFrame, int]:
    """The networks of the newest version below `path`, or of the given one, and its number."""
    version = versions(spark, path) if version is None else version
    return parse_entries(spark.read.schema("entry string").json(f"{path}/version={version}")), version
