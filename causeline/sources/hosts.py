"""Host aliases: known hosts, canonical names and groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ipv4(name: Column) -> Column:
    """A dotted IPv4 address as a number, else null."""
    part = lambda k: F.element_at(F.split(name, r"\."), k).try_cast("long")
    ok = name.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    return F.when(ok, part(1) * 16777216 + part(2) * 65536 + part(3) * 256 + part(4))


def resolve(log: DataFrame, aliases: DataFrame, host: str = "host") -> DataFrame:
    """Adds ``known_host`` and ``host_group``: by lower-case name, else by the narrowest network that holds the address.

    The alias table is a definition file's size. Distinct hosts are resolved, and the log joins them by its own host.
    """
    hosts = log.select(host).filter(F.col(host).isNotNull()).distinct()
    key = F.lower(F.col(host))
    names = aliases.filter("lo is null").select("name", F.col("host").alias("by_name"), F.col("grp").alias("name_grp")).dropDuplicates(["name"])
    nets = aliases.filter("lo is not null").select("lo", "hi", F.col("host").alias("net"), F.col("grp").alias("net_grp"))
    named = hosts.withColumn("__key", key).join(names, F.col("__key") == F.col("name"), "left")
    addresses = named.withColumn("__ip", ipv4(F.col("__key")))
    inside = addresses.filter("by_name is null and __ip is not null").join(nets, F.col("__ip").between(F.col("lo"), F.col("hi")))
    best = inside.groupBy(host).agg(F.min_by("net_grp", F.struct(F.col("hi") - F.col("lo"), "net")).alias("net_grp"))
    found = named.join(best, host, "left").select(
        host, F.when(F.col("by_name").isNotNull(), F.col("by_name")).when(F.col("net_grp").isNotNull(), F.col("__key")).alias("known_host"), F.coalesce("name_grp", "net_grp").alias("host_group")
    )
    return log.join(found, host, "left")


def accept(log: DataFrame, aliases: DataFrame, drop_unknown: bool, host: str = "host") -> DataFrame:
    """Hosts by their canonical names; unknown ones are dropped or kept as they are."""
    out = resolve(log, aliases, host)
    if drop_unknown:
        out = out.filter("known_host is not null")
    return out.withColumn(host, F.coalesce("known_host", host)).drop("known_host", "host_group")
