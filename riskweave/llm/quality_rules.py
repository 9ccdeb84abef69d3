"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Each rule rejects a document whose statistic (a share between 0 and 1, in steps of 1/``STEPS``) lies above a cutoff.  The
cutoffs come from labelled rows: per stratum and rule, cutoffs are tested from the most lenient down, each by the exact
binomial tail probability of its false rejections among the rows labelled good, ``P(Bin(n, alpha) <= k)``.  Testing
stops at the first cutoff that fails (a fixed sequence needs no correction within itself); the level is divided by the
number of strata times rules (Bonferroni), and the allowed rate by the number of rules, so that with probability
``1 - delta`` at most ``alpha`` of the good documents of any stratum are rejected by all rules together.  Among
certified cutoffs the one with the best balance (share of bad rejected minus share of good rejected) is taken, the more
lenient in a tie.  A rule without a certified cutoff, or whose best balance is below ``MIN_GAIN``, rejects nothing.

Statistics of a text are computed inside its row from arrays; three-word windows are compared by hashes with the word
position packed below, and a hash match is confirmed on the words.

Edge rows: null or empty texts have no words and fail the base rule; a null stratum is a stratum of its own; labels that
are null or for unknown ids are ignored, repeated labels of an id count once (the smallest); with no labels only the base
rule rejects; all columns of ``docs`` are kept by ``apply``, which judges rows without a doc_id or with a repeated one each by
itself; extra columns and equal rows don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from riskweave.session import cut

SPACE = "[ \\t-\\r]+"
SYMBOLS = "#*$%&|<>"
STEPS = 200
MIN_GAIN = 0.05  # a cutoff must reject this much more of the bad than of the good
RULES = ["symbol_share", "upper_share", "dup_line_share", "repeat_share"]


def with_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """``_t`` (text, empty for null) and ``_w`` (its words) added."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn("_t", t).withColumn("_w", F.filter(F.split("_t", SPACE), lambda w: w != ""))


def base_stats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", extra: list[Column] = ()) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, the rule shares and ``extra`` columns."""
    f = with_words(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *extra))
    names = [c for c in f.columns if c not in ("doc_id", "text", "_t", "_w")]
    n = F.size("_w")
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    chars = F.length(F.translate("_t", " \t\n\x0b\x0c\r", ""))
    length = F.length("_t")
    f = f.select(
        "doc_id", *names, "_w", n.cast("long").alias("n_words"), chars.cast("long").alias("word_chars"),
        (length - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (length - F.length(F.regexp_replace("_t", "\\p{Lu}+", ""))).alias("_upper"),
        lines.alias("_lines"),
        # key of a three-word window: hash in the upper bits, position in the lower ones
        F.ceil(F.log2(n + F.lit(2))).cast("int").alias("_bits"),
    )
    key = lambda i: F.call_function("shiftleft", F.xxhash64(F.col("_w")[i], F.col("_w")[i + 1], F.col("_w")[i + 2]), F.col("_bits")).bitwiseOR(i.cast("long"))
    last = F.col("n_words").cast("int") - 3
    f = f.withColumn("_k", F.when(last >= 1, F.sort_array(F.transform(F.sequence(F.lit(0), last), key))).otherwise(F.array().cast("array<bigint>")))
    # shiftright(key) is the hash; the words of two neighbours in sorted order are compared
    where = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bits")) - 1).cast("int")
    same = lambda x, y: (F.call_function("shiftrightunsigned", x, F.col("_bits")) == F.call_function("shiftrightunsigned", y, F.col("_bits"))) & equal(where(x), where(y))
    equal = lambda i, j: (F.col("_w")[i] == F.col("_w")[j]) & (F.col("_w")[i + 1] == F.col("_w")[j + 1]) & (F.col("_w")[i + 2] == F.col("_w")[j + 2])
    k = F.col("_k")
    later = F.filter(F.sequence(F.lit(1), F.size("_k") - 1), lambda i: same(k[i], k[i - 1]))
    f = f.withColumn("_later", F.when(F.size("_k") > 1, later).otherwise(F.array().cast("array<int>")))
    again = F.concat(F.transform("_later", lambda i: where(k[i])), F.transform("_later", lambda i: where(k[i - 1])))
    f = f.withColumn("_p", F.sort_array(F.array_distinct(again)))
    p = F.col("_p")
    covered = F.aggregate(
        F.col("_p"), F.struct(F.lit(0).alias("n"), F.lit(-3).alias("at")),
        lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["at"])).alias("n"), x.alias("at")), lambda a: a["n"],
    )
    f = f.select(
        "doc_id", *names, "n_words", "word_chars", "n_symbols", "_upper",
        F.size("_lines").alias("_n_lines"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(p) > 0, covered).otherwise(0).cast("long").alias("n_repeat_words"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return f.select(
        "doc_id", *names, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        share("n_symbols", "word_chars").alias("symbol_share"), share("_upper", "word_chars").alias("upper_share"),
        share("n_dup_lines", "_n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
    )


def log_factorial(x: Column) -> Column:
    """ln x! by Stirling's series at x + 8, exact to about 1e-13."""
    z = x + F.lit(8.0)
    series = (z + 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * F.pow(z, 3)) + 1 / (1260 * F.pow(z, 5)) - 1 / (1680 * F.pow(z, 7))
    ratio = F.lit(1.0)
    for j in range(1, 9):
        ratio = ratio * (x + float(j))
    return series - F.log(ratio)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k) for k below the mean, 1 otherwise: terms summed from k down until they vanish."""
    k, n = k.cast("double"), n.cast("double")
    peak = log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    steps = F.least(k, F.ceil(F.sqrt(n) * 10) + 50).cast("int")
    terms = F.aggregate(
        F.sequence(F.lit(0), steps), F.struct(F.lit(1.0).alias("t"), F.lit(0.0).alias("s")),
        lambda a, j: F.struct((a["t"] * (k - j) / (n - k + j + 1) * ((1 - p) / p)).alias("t"), (a["s"] + a["t"]).alias("s")),
        lambda a: a["s"],
    )
    return F.when(k >= n * p, 1.0).otherwise(F.least(F.exp(peak) * terms, F.lit(1.0)))


def calibrate(stats: DataFrame, labels: DataFrame, stratum: str, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """(stratum, rule, cutoff): at most one row per stratum and rule; a statistic of ``cutoff`` steps or more is rejected.

    ``labels``: (doc_id, quality).  Rows are reduced to counts per stratum, rule and step before anything is ranked.
    """
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("good"))
    known = stats.where(~F.col("base_failed")).join(marks, "doc_id").select(stratum, (F.col("good") > 0).cast("int").alias("good"), *RULES)
    one = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.ceil(F.col(r) * STEPS).cast("int").alias("step")) for r in RULES]))
    counts = known.select(stratum, "good", one.alias("x")).groupBy(stratum, "x.rule", "x.step").agg(
        F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad")
    )
    group = [stratum, "rule"]
    grid = (
        counts.groupBy(*group).agg(F.sum("good").alias("n"), F.sum("bad").alias("nb"), F.map_from_entries(F.collect_list(F.struct("step", "good"))).alias("g"), F.map_from_entries(F.collect_list(F.struct("step", "bad"))).alias("b"))
        .select(*group, "n", "nb", "g", "b", F.explode(F.sequence(F.lit(1), F.lit(STEPS))).alias("cutoff"))
        .select(*group, "n", "nb", "cutoff", F.coalesce(F.col("g")[F.col("cutoff")], F.lit(0)).alias("k"), F.coalesce(F.col("b")[F.col("cutoff")], F.lit(0)).alias("kb"))
    )
    down = W.partitionBy(*group).orderBy(F.desc("cutoff"))  # STEPS rows each
    tests = grid.agg(F.countDistinct(F.struct(*group)).alias("tests"))
    judged = grid.select(*group, "n", "nb", "cutoff", F.sum("k").over(down).alias("k"), F.sum("kb").over(down).alias("kb")).crossJoin(F.broadcast(tests))
    passed = judged.withColumn("ok", (binomial_tail(F.col("k"), F.col("n"), alpha / len(RULES)) <= F.lit(delta) / F.col("tests")).cast("int"))
    certified = passed.withColumn("ok", F.min("ok").over(down)).where("ok = 1")
    gain = F.col("kb") / F.greatest(F.col("nb"), F.lit(1)) - F.col("k") / F.col("n")
    best = certified.withColumn("gain", gain).groupBy(*group).agg(F.max_by("cutoff", F.struct("gain", "cutoff")).alias("cutoff"), F.max("gain").alias("gain"))
    return best.where(F.col("gain") >= MIN_GAIN).select(*group, "cutoff")


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.05, delta: float = 0.05, extra: tuple[Column, ...] = ()) -> DataFrame:
    """doc_id, the statistics, base_failed, reasons (rules that reject), kept and ``extra`` columns, per row of ``docs``."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    names = docs.select(*extra).columns
    stats = cut(base_stats(docs, extra=[F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), *extra]).withColumn("base_failed", failed))
    cutoffs = calibrate(stats, labels, "stratum", alpha, delta)
    rows = cutoffs.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))
    both = stats.join(rows, "stratum", "left")
    hit = lambda r: F.when(F.ceil(F.col(r) * STEPS) >= F.col("cutoffs")[r], F.lit(r))
    reasons = F.when(F.col("cutoffs").isNull(), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*[hit(r) for r in RULES])))
    return both.withColumn("reasons", reasons).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "reasons",
        (~F.col("base_failed") & (F.size("reasons") == 0)).alias("kept"), *names,
    )


def apply(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, each by its own text and stratum, whatever its doc_id (null, repeated)."""
    # The row travels as one column beside the text, so that its columns may have any names and no text is joined back.
    rows = docs.select("doc_id", "text", stratum, F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    return judge(rows, labels, stratum, alpha, delta, (F.col("row"),)).where("kept").select("row.*")
