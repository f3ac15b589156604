"""Checks of the transaction table, their summary, and the rows that pass them all."""

from __future__ import annotations

from collections.abc import Iterator

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TXID = r"^[0-9a-fA-F]{64}$"
_BYTE = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4 = rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"
FLAGS = ("invalid_txid", "negative_amount", "length_mismatch", "invalid_ip", "duplicate_txid", "null_field")


def _ipv6(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def valid(value: str | None) -> bool:
        try:
            return ipaddress.ip_address(value or "").version == 6
        except ValueError:
            return False

    for series in values:
        yield series.map(valid)


def valid_ip(ip: Column, ipv6: bool = True) -> Column:
    """Whether ip is an address; only what holds a colon goes to Python."""
    text = F.trim(F.coalesce(ip, F.lit("")))
    v4 = text.rlike(IPV4)
    return v4 | F.pandas_udf(_ipv6, T.BooleanType())(F.when(text.contains(":"), text)) if ipv6 else v4


def _null(df: DataFrame, c: str) -> Column:
    kind = dict(df.dtypes)[c]
    return F.col(c).isNull() | F.isnan(c) if kind in ("double", "float") else F.col(c).isNull()


def flagged(transactions: DataFrame, columns: tuple[str, ...] | None = None, ipv6: bool = True) -> DataFrame:
    """transactions with a boolean column per kind of fault. columns: those in which nulls count (default: all)."""
    names = [c for c in transactions.columns if c != "row_idx"] if columns is None else list(columns)
    below = lambda c: F.exists(c, lambda x: x < 0)
    differ = lambda s: F.size(f"{s}_addresses") != F.size(f"{s}_amounts")
    txid = F.trim(F.coalesce("txid", F.lit("")))
    any_null = F.lit(False)
    for c in names:
        any_null = any_null | _null(transactions, c)
    false = lambda c: F.coalesce(c, F.lit(False))
    return transactions.select(
        "*",
        (~txid.rlike(TXID)).alias("invalid_txid"),
        false(below("input_amounts") | below("output_amounts") | (F.coalesce("fee", F.lit(0.0)) < 0)).alias("negative_amount"),
        false(differ("input") | differ("output")).alias("length_mismatch"),
        (~(valid_ip(F.col("src_ip"), ipv6) & valid_ip(F.col("dst_ip"), ipv6))).alias("invalid_ip"),
        ((txid != "") & (F.expr("count(*) OVER (PARTITION BY txid)") > 1)).alias("duplicate_txid"),
        any_null.alias("null_field"),
    )


def issue_counts(flags: DataFrame) -> DataFrame:
    """One row: rows in all, and how many have each fault or none."""
    clean = ~(F.col(FLAGS[0]) | F.col(FLAGS[1]) | F.col(FLAGS[2]) | F.col(FLAGS[3]) | F.col(FLAGS[4]) | F.col(FLAGS[5]))
    return flags.agg(F.count("*").alias("total_rows"), *(F.count_if(F.col(f)).alias(f) for f in FLAGS), F.count_if(clean).alias("clean_rows"))


def null_counts(transactions: DataFrame) -> DataFrame:
    """(column_name, n_null) for columns with nulls; NaN counts as null."""
    names = [c for c in transactions.columns if c != "row_idx"]
    one = transactions.agg(*(F.count_if(_null(transactions, c)).alias(c) for c in names))
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_null")) for c in names)))
    return one.select(pairs.alias("x")).select("x.*").where("n_null > 0")


def duplicate_txids(transactions: DataFrame) -> DataFrame:
    """(txid, n) of txids that more than one row has, blank ones aside."""
    return transactions.where(F.trim("txid") != "").groupBy("txid").agg(F.count("*").alias("n")).where("n > 1")


def clean_subset(flags: DataFrame) -> DataFrame:
    """Rows without any fault: of duplicates, no copy stays."""
    keep = F.lit(True)
    for f in FLAGS:
        keep = keep & ~F.col(f)
    return flags.where(keep).drop(*FLAGS)
