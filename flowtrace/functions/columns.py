"""Column expressions that several operators use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K


def risk_level(score: Column) -> Column:
    return F.when(score >= 0.75, "CRITICAL").when(score >= 0.50, "HIGH").when(score >= 0.30, "MEDIUM").otherwise("LOW")


def high_risk_asn(asn: Column) -> Column:
    """Whether asn is on any threat list (null: no)."""
    return F.coalesce(asn.isin(*K.BULLETPROOF, *K.TOR, *K.VPN_PROXY, *K.PRIVACY), F.lit(False))


def network(asn: Column, country: Column) -> Column:
    """struct(category, weight, threat, label) of an address's network, by precedence."""
    tests = (asn.isin(*K.BULLETPROOF), asn.isin(*K.TOR), asn.isin(*K.VPN_PROXY), asn.isin(*K.PRIVACY), F.upper(country).isin(*K.HIGH_RISK_COUNTRIES), asn.isNotNull())
    value = lambda row: F.struct(F.lit(row[0]).alias("category"), F.lit(row[1]).alias("weight"), F.lit(row[2]).alias("threat"), F.lit(row[3]).alias("label"))
    out = F.when(tests[0], value(K.NETWORKS[0]))
    for test, row in zip(tests[1:], K.NETWORKS[1:]):
        out = out.when(test, value(row))
    return out.otherwise(value(K.NETWORKS[-1]))


def is_round(amount: Column) -> Column:
    """Whether an amount looks like an intended payment: a usual denomination, or no more than two decimals."""
    return amount.isin(*K.ROUND_DENOMINATIONS) | (F.bround(amount, 2) == amount)


def btc_sum(amount: Column) -> Column:
    """Sum of amounts in eight decimals, the same in whatever order they come."""
    return F.sum(amount.cast("decimal(20,8)")).cast("double")


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


#: Short forms in names of features.
_WORDS = {"btc": "BTC", "ip": "address", "ips": "addresses", "asn": "network", "tx": "transaction", "avg": "average", "std": "spread of", "min": "least", "max": "greatest", "net": "balance of"}


def label(name: str) -> str:
    """A feature's name in plain words."""
    return " ".join(_WORDS.get(w, w) for w in name.split("_"))


def labels(names: list[str], name: Column) -> Column:
    """label() of a column of names, known ones; others as they are."""
    if not names:
        return name
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for n in names for x in (n, label(n)))), name), name)


def entropy(shares: Column) -> Column:
    """Shannon entropy in bits from an aggregate over shares p."""
    return -F.sum(shares * F.log2(shares))
