"""Country and network of addresses, from tables of address ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.validation import IPV4

#: Ranges that name no public place (first address, prefix length).
NOT_PUBLIC = (("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.168.0.0", 16), ("224.0.0.0", 4), ("240.0.0.0", 4))


def address_number(ip: Column) -> Column:
    """An IPv4 address as a number; null for anything else."""
    part = lambda k: F.split_part(ip, F.lit("."), F.lit(k)).try_cast("bigint")
    number = part(1) * 16777216 + part(2) * 65536 + part(3) * 256 + part(4)
    return F.when(F.trim(ip).rlike(IPV4), number)


def is_public(number: Column) -> Column:
    out = F.lit(True)
    for first, bits in NOT_PUBLIC:
        low = sum(int(x) << s for x, s in zip(first.split("."), (24, 16, 8, 0)))
        out = out & ~number.between(low, low + (1 << (32 - bits)) - 1)
    return out


def ranges(cidrs: DataFrame) -> DataFrame:
    """cidrs(cidr, country, asn) with low, high and a row for each /16 block that a range touches."""
    bits = F.split_part("cidr", F.lit("/"), F.lit(2)).cast("int")
    low = address_number(F.split_part("cidr", F.lit("/"), F.lit(1)))
    sized = cidrs.withColumn("low", low).withColumn("bits", bits).withColumn("high", F.expr("low + bigint(pow(2, 32 - bits)) - 1"))
    return sized.withColumn("block", F.explode(F.sequence(F.expr("low div 65536"), F.expr("high div 65536"))))


def enrich(transactions: DataFrame, cidrs: DataFrame, ip_col: str = "src_ip") -> DataFrame:
    """transactions with src_ip_country and src_ip_asn of the narrowest range around each public address.

    Each distinct address is looked up once; the /16 block makes the range join an equality join.
    KeyError where the address column is missing.
    """
    if ip_col not in transactions.columns:
        raise KeyError(ip_col)
    ips = transactions.select(F.col(ip_col).alias("_ip")).distinct().withColumn("n", address_number(F.col("_ip"))).where(F.col("n").isNotNull() & is_public(F.col("n"))).withColumn("block", F.expr("n div 65536"))
    hit = ips.join(ranges(cidrs), "block").where("n BETWEEN low AND high")
    best = hit.groupBy("_ip").agg(F.max_by(F.struct("country", "asn"), F.struct("bits", "country", "asn")).alias("g"))
    out = transactions.drop("src_ip_country", "src_ip_asn").join(best, F.col(ip_col) == F.col("_ip"), "left")
    return out.withColumn("src_ip_country", F.col("g.country")).withColumn("src_ip_asn", F.col("g.asn").cast("bigint")).drop("_ip", "g")
