"""Quality rules with risk-controlled cutoffs, in DataFrame operations only.

Base facts are counted on whole texts with array functions, row by row and
without a shuffle. Each rule rejects a text whose share of something lies
above a cutoff. Labelled texts choose the cutoffs: in every stratum the
cutoffs of a fixed grid are tested from the mildest to the strictest; a cutoff
passes if the exact binomial tail shows, at level ``delta`` divided by rules x
strata (Bonferroni), that it rejects less than ``alpha`` of the good texts,
and testing stops at the first failure (a fixed sequence needs no further
correction). So with probability 1 - delta no stratum's rule rejects more than
``alpha`` of its good texts. Of the cutoffs that pass, the one that gains most
(labelled bad texts rejected less ``COST`` times good texts rejected; the
mildest of equals) is used; a stratum with too few labels rejects nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordlens.session import materialize

WS = " \t\n\x0b\x0c\r"
WS_RUN = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Cutoffs are i / GRID for i = 1 .. GRID.
GRID = 50
ALPHA = 0.01
DELTA = 0.05
COST = 5
#: The rules: name -> share of the text (0 to 1).
RULES = ("symbols", "dup_lines", "repeats", "capitals")
#: A cutoff table of more strata than this is joined, not broadcast.
MAX_STRATA = 10_000


def base_facts(docs: DataFrame) -> DataFrame:
    """doc_id, lang and the counts of each text (see ``quality_rules``)."""
    t = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("stratum"), t.alias("text")).withColumn(
        "words", F.filter(F.split("text", WS_RUN), lambda w: w != "")).withColumn(
        "lines", F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, WS, "")) > 0)).withColumn(
        "n_words", F.size("words").cast("long"))
    d = d.select(
        "doc_id", "stratum", "n_words", "words",
        F.length(F.translate("text", WS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.length("text") - F.length(F.regexp_replace("text", r"\p{Lu}+", ""))).cast("long").alias("n_capitals"),
        F.when(F.col("n_words") >= 3, F.transform(
            F.sequence(F.lit(0), F.col("n_words").cast("int") - 3),
            lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))).alias("grams"))
    d = d.withColumn("some", F.size("grams") > F.size(F.array_distinct("grams"))).withColumn(
        "order", F.when(F.col("some"), F.sort_array(F.transform(
            "grams", lambda g, i: F.struct(g.alias("g"), i.alias("i")))))).drop("words", "grams")
    same = lambda k, g: F.coalesce(F.get("order", k)["g"] == g, F.lit(False))
    d = d.withColumn("at", F.sort_array(F.transform(F.filter(
        "order", lambda s, k: same(k - 1, s["g"]) | same(k + 1, s["g"])), lambda s: s["i"]))).drop("order", "some")
    covered = F.aggregate(
        F.transform("at", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("at", k + 1) - p, F.lit(3)))),
        F.lit(0).cast("long"), lambda acc, x: acc + x)
    return d.select("doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                    F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), "n_lines", "n_capitals")


def _shares() -> dict[str, Column]:
    part = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return dict(zip(RULES, (part("n_symbols", "word_chars"), part("n_dup_lines", "n_lines"),
                            part("n_repeat_words", "n_words"), part("n_capitals", "word_chars"))))


def _log_gamma(x: Column) -> Column:
    """ln Gamma for x >= 1: Stirling's series at x + 8, less the eight factors."""
    z = x + 8
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (
        1260 * z * z * z * z * z)
    for i in range(8):
        series = series - F.log(x + i)
    return series


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k): exact summation downwards from k, whose rest after 2,000 terms is bounded, not dropped.

    1 where k is not below the mean.
    """
    n, k = n.cast("double"), k.cast("double")
    top = F.exp(_log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    ratio = lambda i: (k - i) * (1 - p) / ((n - k + i + 1) * p)
    start = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum"))
    steps = F.sequence(F.lit(0), F.least(k, F.lit(2000.0)).cast("int"))
    run = F.aggregate(steps, start, lambda a, i: F.struct(
        (a["term"] * ratio(i)).alias("term"), (a["sum"] + a["term"]).alias("sum")))
    tail = run["sum"] + run["term"] / (1 - F.least(ratio(F.lit(0)), F.lit(1 - 1e-9)))
    return F.when(k >= n * p, 1.0).otherwise(F.least(top * tail, F.lit(1.0)))


def cutoffs(facts: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff) of every stratum and rule with a cutoff that passes.

    ``labels``: (doc_id, quality); null labels are left out, of several labels
    of one id the smallest counts.
    """
    lab = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(
        (F.min("quality") > 0).alias("good"))
    cell = [F.struct(F.lit(name).alias("rule"),
                     F.least(F.ceil(F.round(share * GRID, 9)).cast("int"), F.lit(GRID)).alias("cell"))
            for name, share in _shares().items()]
    seen = facts.join(lab, "doc_id").where(~base_failed()).select("stratum", "good", F.explode(F.array(*cell)).alias("c"))
    hist = seen.groupBy("stratum", "c.rule", "c.cell").agg(
        F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    groups = hist.select("stratum", "rule").distinct()
    grid = groups.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(GRID))))
    tests = groups.select(F.count("*").alias("tests"))
    # texts above cutoff i / GRID are those of the cells after i
    w = Window.partitionBy("stratum", "rule").orderBy(F.desc("cell"))
    all_ = Window.partitionBy("stratum", "rule")
    full = grid.join(hist, ["stratum", "rule", "cell"], "left").fillna(0, ["good", "bad"]).select(
        "stratum", "rule", "cell", F.sum("good").over(all_).alias("n"),
        (F.sum("good").over(w) - F.col("good")).alias("k"), (F.sum("bad").over(w) - F.col("bad")).alias("caught"))
    tested = full.where("cell > 0").join(F.broadcast(tests)).withColumn(  # one row
        "failed", binomial_tail(F.col("n"), F.col("k"), alpha) > F.lit(delta) / F.col("tests"))
    passed = tested.withColumn("stop", F.max(F.col("failed").cast("int")).over(w)).where("stop = 0")
    gain = F.struct((F.col("caught") - COST * F.col("k")).alias("gain"), "cell")
    return passed.groupBy("stratum", "rule").agg(F.max(gain).alias("g")).where("g.gain > 0").select(
        "stratum", "rule", (F.col("g.cell") / F.lit(float(GRID))).alias("cutoff"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def quality_rules(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang): counts, base_failed, kept, broken (the rules that reject).

    Words are runs of ``[^\\x20\\x09-\\x0D]``; a null or empty text has none, so
    its base check fails. ``n_repeat_words`` counts the words that lie in a
    three-word window found at least twice in the text; windows are compared by
    64-bit hash. The stratum is ``lang`` (null: ''). Rows may repeat, null ids
    are kept, other columns are ignored; without documents the result is
    empty, and without labels only the base check decides.
    """
    facts = materialize(base_facts(docs), "rule-facts")
    cut = cutoffs(facts, labels, alpha, delta)
    per = materialize(cut.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cut")),
                      "rule-cutoffs")
    if per.count() <= MAX_STRATA:
        per = F.broadcast(per)
    above = F.array_compact(F.array(*[
        F.when(F.round(share * GRID, 9) > F.col("cut")[name] * GRID, name) for name, share in _shares().items()]))
    return facts.join(per, "stratum", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), (~base_failed() & (F.size(above) == 0)).alias("kept"), above.alias("broken"))
