"""License policy over a package table."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Policy:
    """Pattern lists, matched anywhere and without regard to case.  Defaults are fixed values."""

    ignore_packages: list[str] = field(default_factory=list)
    allow_packages: list[str] = field(default_factory=list)
    deny_packages: list[str] = field(default_factory=list)
    allow_licenses: list[str] = field(default_factory=lambda: ["LGPL"])
    deny_licenses: list[str] = field(default_factory=lambda: ["AGPL", "GNU Affero", "GPL"])
    block_unknown: bool = False


# Heuristic patterns, and the length from which a license field counts as full text.
COPYLEFT = r"(?i)\bAGPL\b|\bGNU\s+Affero\b|\bGPL\b|General Public License"
LESSER = r"(?i)Lesser General Public License"
SHORT = 64


def _any(value: Column, patterns: list[str]) -> Column:
    hits = [F.coalesce(value.rlike(f"(?i){p}"), F.lit(False)) for p in patterns]
    return reduce(lambda a, b: a | b, hits, F.lit(False))


def _copyleft(value: Column) -> Column:
    return F.coalesce(value.rlike(COPYLEFT) & ~value.rlike(LESSER), F.lit(False))


def policy_flag(df: DataFrame, policy: Policy, name="name", license="license", classifiers="classifiers") -> DataFrame:
    """Add ``blocked``.  The first verdict counts: package lists, each classifier in order (deny before allow),
    a short license text likewise, then the copyleft heuristic on classifiers or, without any, on the license."""
    lists = F.coalesce(F.col(classifiers), F.array().cast("array<string>"))
    verdict = lambda v: F.when(_any(v, policy.deny_licenses), True).when(_any(v, policy.allow_licenses), False)
    first_classifier = F.get(F.filter(F.transform(lists, verdict), lambda v: v.isNotNull()), F.lit(0))
    text = F.coalesce(F.col(license), F.lit(""))
    short = (F.length(text) > 0) & (F.length(text) < SHORT)
    first_license = F.when(short, verdict(text))
    unknown = (text == "") & (F.size(lists) == 0)
    blocked = (
        F.when(_any(F.col(name), policy.ignore_packages) | _any(F.col(name), policy.allow_packages), False)
        .when(_any(F.col(name), policy.deny_packages), True)
        .when(first_classifier.isNotNull(), first_classifier)
        .when(first_license.isNotNull(), first_license)
        .when(F.size(lists) > 0, F.exists(lists, _copyleft))
        .when(short & _copyleft(text), True)
        .otherwise(unknown & F.lit(policy.block_unknown))
    )
    return df.withColumn("blocked", blocked)
