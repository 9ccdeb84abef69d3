"""Mixing sources to target weights by hierarchical budgets, in DataFrame functions only.

Leaves are (domain, lang, source).  The token budget flows down a tree of weights: at every node it is divided among the
children in proportion to their weights, but never beyond what a child's subtree can supply (its tokens times
``epochs``).  What a child can't take goes to its siblings first; only what all siblings together can't take stays with
the ancestor, whose other children get it.  Each leaf then reads its documents in epochs: every epoch is a fixed order by
a digest of seed, epoch and document, and the leaf takes the longest prefix within its budget.

The prefix of a leaf needs a running sum over all its rows.  Rows are put into buckets by the first digits of their
digest, so bucket sums give each bucket's starting point and rows are ranked only inside a bucket; a leaf with a third of
all rows is spread over proportionally many buckets.

Edge rows: null or empty texts cost no tokens and are taken with whatever precedes them in their leaf, but a leaf without a
budget (weight zero, or no tokens at all) takes nothing; null levels are
the name ''; levels without a given weight weigh ``default``; a weight of zero takes nothing; rows with equal (doc_id,
text) are ordered as one and share their fate; an empty table gives an empty result; further columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from riskweave.session import cut

LEVELS = ["domain", "lang", "source"]
BUCKET_ROWS = 2000  # aimed at; the digits used follow from the number of rows


def n_words(text: str) -> Column:
    return F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "[ \\t-\\r]+"), lambda w: w != "")).cast("long")


def divide(nodes: DataFrame, parent: list[str], child: str) -> DataFrame:
    """``budget`` of each child from its parent's: water-filling of (parent, child, w, supply, total).

    Children are filled in the order of supply / weight; while one can't take its share of what is left among the
    remaining weights, it takes all it has.  The level of the rest is the first that holds, which is the highest.
    """
    order = W.partitionBy(*parent).orderBy(F.when(F.col("w") > 0, F.col("supply") / F.col("w")).otherwise(F.lit(float("inf"))), child)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(*parent)
    left = F.col("total") - F.coalesce(F.sum("supply").over(before), F.lit(0.0))
    weight = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    share = F.when((F.col("w") > 0) & (F.col("supply") * F.col("left_w") >= F.col("w") * F.col("left_b")), F.col("left_b") / F.col("left_w"))
    level = F.max(share).over(everything)  # null: the parent's budget exceeds all supply
    f = nodes.withColumns({"left_b": left, "left_w": weight}).withColumn("level", level)
    taken = F.when(F.col("w") <= 0, 0.0).when(F.col("level").isNull(), F.col("supply")).otherwise(F.least("supply", F.col("w") * F.col("level")))
    return f.withColumn("budget", taken).drop("left_b", "left_w", "level")


def budgets(leaves: DataFrame, weights: DataFrame, total: Column | float, epochs: int, default: float = 1.0) -> DataFrame:
    """(domain, lang, source, budget) from leaves (domain, lang, source, tokens).

    ``weights``: (level, name, w) with level one of ``LEVELS``.  A weight belongs to a name at its level.  Children of
    weight zero supply nothing.
    """
    tree = leaves.withColumn("supply", F.col("tokens").cast("double") * epochs)
    for level in LEVELS:
        named = weights.where(F.col("level") == level).select(F.col("name").alias(level), F.col("w").cast("double").alias(f"w_{level}"))
        tree = tree.join(named, level, "left").withColumn(f"w_{level}", F.coalesce(f"w_{level}", F.lit(default)))
    dead = " or ".join(f"w_{level} <= 0" for level in LEVELS)
    tree = cut(tree.withColumn("supply", F.when(F.expr(dead), 0.0).otherwise(F.col("supply"))))
    above = tree.agg((F.lit(total) if not isinstance(total, Column) else total).cast("double").alias("total"))
    for i, level in enumerate(LEVELS):
        key = LEVELS[: i + 1]
        nodes = tree.groupBy(*key).agg(F.sum("supply").alias("supply"), F.max(f"w_{level}").alias("w"))
        nodes = nodes.join(above, LEVELS[:i]) if i else nodes.crossJoin(F.broadcast(above))
        above = divide(nodes, LEVELS[:i] or [F.lit(0)], level).select(*key, F.col("budget").alias("total"))
    return above.withColumnRenamed("total", "budget")


def mix(docs: DataFrame, weights: DataFrame, fraction: float, domain: Column, seed: str = "mix", epochs: int = 1, default: float = 1.0) -> DataFrame:
    """Rows of ``docs`` taken for a budget of ``fraction`` of all tokens, with ``mix_epoch`` (from 0), ``mix_tokens`` and
    ``mix_domain``.  A document taken in two epochs comes twice.  Columns of these three names are replaced."""
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    kept = [c for c in docs.columns if c not in ("mix_epoch", "mix_tokens", "mix_domain")]
    # the row travels as one column, so that its columns may have any names
    docs = docs.select("doc_id", "text", "lang", "source", name(domain).alias("dom"), F.struct(*[F.col(c) for c in kept]).alias("row"))
    known = {"domain": F.col("dom"), "lang": name(F.col("lang")), "source": name(F.col("source"))}
    keyed = cut(docs.select("doc_id", *[c.alias(k) for k, c in known.items()], n_words("text").alias("tokens"), F.md5(F.coalesce("text", F.lit(""))).alias("body")))
    rows = keyed.count()
    digits = 0
    while rows > BUCKET_ROWS * 16**digits:
        digits += 1
    leaf = keyed.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    goal = budgets(leaf, weights, F.floor(F.sum("tokens") * F.lit(fraction)), epochs, default)
    spent = leaf.join(goal, LEVELS).select(*LEVELS, F.floor("budget").alias("budget"), F.col("tokens").alias("pass_tokens"))
    ranked_by = F.md5(F.concat_ws(":", F.lit(seed), F.col("mix_epoch").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("body")))
    each = keyed.withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).withColumn("digest", ranked_by)
    each = each.withColumn("bucket", F.substring("digest", 1, digits)).groupBy(*LEVELS, "mix_epoch", "bucket", "digest", "doc_id", "body").agg(F.sum("tokens").alias("tokens"))
    sums = each.groupBy(*LEVELS, "mix_epoch", "bucket").agg(F.sum("tokens").alias("s"))
    order = W.partitionBy(*LEVELS, "mix_epoch").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(*LEVELS, "mix_epoch", "bucket", F.coalesce(F.sum("s").over(order), F.lit(0)).alias("start"))
    inner = W.partitionBy(*LEVELS, "mix_epoch", "bucket").orderBy("digest").rowsBetween(W.unboundedPreceding, 0)
    upto = each.withColumn("upto", F.sum("tokens").over(inner)).join(starts, [*LEVELS, "mix_epoch", "bucket"]).join(spent, LEVELS)
    taken = upto.where("budget > 0").where(F.col("mix_epoch") * F.col("pass_tokens") + F.col("start") + F.col("upto") <= F.col("budget"))
    taken = taken.select(F.col("doc_id").alias("take_id"), F.col("body").alias("take_body"), "mix_epoch", F.col("domain").alias("mix_domain"), F.col("lang").alias("take_lang"), F.col("source").alias("take_source"))
    match = docs["doc_id"].eqNullSafe(taken["take_id"]) & (F.md5(F.coalesce(docs["text"], F.lit(""))) == taken["take_body"])
    match &= (name(docs["lang"]) == taken["take_lang"]) & (name(docs["source"]) == taken["take_source"]) & (docs["dom"] == taken["mix_domain"])
    return docs.join(taken, match).select("row.*", "mix_epoch", "mix_domain", n_words("text").alias("mix_tokens"))
