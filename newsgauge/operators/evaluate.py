"""Evaluation: confusion, class metrics, latency quantiles, stratified samples, audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsgauge.functions.repair import safe_div

from .linking import stored

#: Words that mark a loss (English), for strata of a gold set.
LOSS_WORDS = (
    "layoff|lay off|lawsuit|sued|sues|probe|investigation|breach|recall|shut|shuts|shutdown|down round|resign|steps down|"
    "cuts|cut|decline|falls|drops|loss|losses|delay|delays|misses|warning|fraud|bankrupt"
)


def confusion_matrix(pairs: DataFrame, labels: Sequence[str]) -> DataFrame:
    """actual, predicted, n for every pair of labels, zeros included; other labels are left out."""
    counted = pairs.groupBy("actual", "predicted").agg(F.count("*").alias("n"))
    spark, both = pairs.sparkSession, [(a, p) for a in labels for p in labels]
    every = spark.createDataFrame(both, "actual string, predicted string")
    return every.join(counted, ["actual", "predicted"], "left").fillna(0, ["n"])


def class_metrics(pairs: DataFrame, labels: Sequence[str]) -> DataFrame:
    """label, support, tp, predicted_as, precision, recall, f1; a zero denominator gives 0."""
    sides = F.explode(F.array(
        F.struct(F.col("actual").alias("label"), F.lit(1).alias("a"), F.lit(0).alias("p")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).alias("a"), F.lit(1).alias("p")),
    ))
    hit = F.col("s.a") * (F.col("actual") == F.col("predicted")).cast("int")
    counted = pairs.select("actual", "predicted", sides.alias("s")).groupBy("s.label").agg(
        F.sum("s.a").alias("support"), F.sum(F.coalesce(hit, F.lit(0))).alias("tp"), F.sum("s.p").alias("predicted_as")
    )
    every = pairs.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    m = every.join(counted, "label", "left").fillna(0, ["support", "tp", "predicted_as"])
    m = m.withColumn("precision", safe_div(F.col("tp"), F.col("predicted_as")))
    m = m.withColumn("recall", safe_div(F.col("tp"), F.col("support")))
    return m.withColumn("f1", safe_div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def scores(pairs: DataFrame, labels: Sequence[str]) -> DataFrame:
    """One row: n, accuracy over all pairs, macro F1 as the plain mean over the labels."""
    macro = class_metrics(pairs, labels).agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"))
    whole = pairs.agg(
        F.count("*").alias("n"), safe_div(F.count_if(F.col("actual") == F.col("predicted")), F.count("*")).alias("accuracy")
    )
    return whole.withColumn("macro_f1", macro.scalar())


SENTIMENT_LABELS = ("positive", "negative", "neutral", "not_applicable")
RELEVANCE_LABELS = ("relevant", "irrelevant")


def run_pairs(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(relevance pairs, sentiment pairs) of answered items; sentiment only where the gold label is relevant.

    answers: gold_relevant, gold_sentiment, relevant, sentiment; relevant null means no
    answer. The sentiment labels include not_applicable, which never has support, so
    macro F1 over them stays under 0.75; take the first three for the other reading.
    """
    given = answers.where("relevant IS NOT NULL")
    word = lambda c: F.when(F.col(c), "relevant").otherwise("irrelevant")
    relevance = given.select(word("gold_relevant").alias("actual"), word("relevant").alias("predicted"))
    mood = given.where("gold_relevant AND gold_sentiment IS NOT NULL")
    mood = mood.select(F.col("gold_sentiment").alias("actual"), F.coalesce("sentiment", F.lit("not_applicable")).alias("predicted"))
    return relevance, mood


def nearest_rank(values: str, by: list[str], rows: DataFrame, quantiles: dict[str, float], cells: int = 1024) -> DataFrame:
    """For each group the value at place floor(q * n), counted from 0 and at most n - 1, in ascending order.

    No group is sorted: values are counted in ``cells`` cells between the least and the greatest, and the cell that holds
    the place is cut again until one value is left in it. What a window orders is a row a cell.
    """
    v = F.col(values)
    given = rows.where(v.isNotNull()).select(*by, v.alias("_v"))
    ends = given.groupBy(*by).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count("*").alias("_all"))
    at = F.array(*[F.struct(F.lit(name).alias("q"), F.least(F.col("_all") - 1, F.floor(F.col("_all") * F.lit(q)).cast("bigint")).alias("at")) for name, q in quantiles.items()])
    found = stored(ends.select(*by, "_low", "_high", F.explode(at).alias("_q")).select(*by, "_low", "_high", "_q.q", F.col("_q.at").alias("_at")), "ranks")
    while not found.where("_low < _high").isEmpty():
        open_ = found.where("_low < _high")
        on = [given[c].eqNullSafe(open_[c]) for c in by]
        inside = given.join(open_, [*on, given["_v"].between(open_["_low"], open_["_high"])]).select(*[open_[c] for c in by], "q", "_at", "_low", "_high", "_v")
        share = (F.col("_v") - F.col("_low")).cast("double") / (F.col("_high") - F.col("_low")).cast("double")
        counted = inside.groupBy(*by, "q", "_at", F.least(F.floor(share * cells), F.lit(cells - 1)).alias("_cell")).agg(
            F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count("*").alias("_n")
        )
        upto = F.sum("_n").over(Window.partitionBy(*by, "q").orderBy("_cell"))
        placed = counted.withColumn("_upto", upto).where((F.col("_upto") > F.col("_at")) & (F.col("_upto") - F.col("_n") <= F.col("_at")))
        cut = placed.select(*by, "_low", "_high", "q", (F.col("_at") - F.col("_upto") + F.col("_n")).alias("_at"))
        found = stored(found.where("_low = _high").unionByName(cut), "ranks")
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("q") == name, F.col("_low"))).alias(name) for name in quantiles])


def to_fixed(x: Column, digits: int) -> Column:
    """Rounded to that many decimals, halves up."""
    scale = F.lit(float(10**digits))
    return F.floor(x * scale + 0.5) / scale


def bench_rows(samples: DataFrame, by: list[str], items: int = 2000) -> DataFrame:
    """Latency and throughput by group: samples have wall_ms, tokens_per_second, output_tokens, and a group's total_ms."""
    ranks = nearest_rank("wall_ms", by, samples, {"p50_wall_ms": 0.5, "p95_wall_ms": 0.95})
    rest = samples.groupBy(*by).agg(
        F.count("*").alias("samples"),
        to_fixed(F.coalesce(F.avg(F.when(F.col("tokens_per_second") > 0, F.col("tokens_per_second"))), F.lit(0.0)), 1).alias("mean_tokens_per_second"),
        F.floor(F.coalesce(F.avg("output_tokens"), F.lit(0.0)) + 0.5).cast("bigint").alias("mean_output_tokens"),
        safe_div(F.count("*") * 60000.0, F.max("total_ms")).alias("_per_minute"),
    )
    out = rest.join(ranks, by)
    out = out.withColumn("throughput_per_minute", to_fixed(F.col("_per_minute"), 1))
    return out.withColumn("projected_minutes", to_fixed(safe_div(F.lit(float(items)), F.col("_per_minute")), 1)).drop("_per_minute")


def run_score(answers: DataFrame, wall_ms: float, items: int = 2500) -> DataFrame:
    """One row for a run over a gold set, relevance and sentiment scored apart.

    answers: see run_pairs, and latency_ms. Items without an answer count as failures and are
    in neither score. Latencies are nearest ranks; rate and projection are over all items.
    """
    relevance, mood = run_pairs(answers)
    base = answers.agg(F.count("*").alias("items"), F.count_if(F.col("relevant").isNull()).alias("failures"))
    rate = F.col("items") * 60000.0 / F.lit(float(wall_ms)) if wall_ms > 0 else F.lit(0.0)
    out = base.withColumn("json_validity_rate", safe_div(F.col("items") - F.col("failures"), F.col("items")))
    out = out.withColumn("items_per_minute", to_fixed(rate, 1)).withColumn("projected_minutes", to_fixed(safe_div(F.lit(float(items)), rate), 1))
    ranks = nearest_rank("latency_ms", [], answers, {"p50": 0.5, "p95": 0.95})
    for name in ("p50", "p95"):
        whole = F.floor(F.coalesce(ranks.select(name).scalar(), F.lit(0)) + 0.5).cast("bigint")
        out = out.withColumn(f"{name}_latency_ms", whole)
    for name, pairs, labels in (("relevance", relevance, RELEVANCE_LABELS), ("sentiment", mood, SENTIMENT_LABELS)):
        scored = scores(pairs, labels)
        for c in ("n", "accuracy", "macro_f1"):
            out = out.withColumn(f"{name}_{c}", scored.select(c).scalar())
    return out


def with_context(gold: DataFrame, registry: DataFrame) -> DataFrame:
    """Gold items (company) with what the registry (name, ...) knows of their company; null where it has none."""
    return gold.join(registry.withColumnRenamed("name", "company"), "company", "left")


def with_tier(mentions: DataFrame, companies: DataFrame) -> DataFrame:
    """mentions with tier: the company's, low where the company or its tier is missing."""
    tiers = companies.select("company_id", F.col("ambiguity").alias("tier"))
    return mentions.join(tiers, "company_id", "left").withColumn("tier", F.coalesce("tier", F.lit("low")))


def ship_choice(results: DataFrame, within: float = 0.02) -> DataFrame:
    """best and ship among results (model, ladder, relevance_f1, sentiment_f1): the first in the ladder near the best."""
    combined = results.withColumn("combined", (F.col("relevance_f1") + F.col("sentiment_f1")) / 2)
    top = combined.agg(F.max("combined").alias("m")).scalar()
    close = combined.withColumn("_top", top)
    return close.agg(
        F.min_by("model", F.when(F.col("combined") == F.col("_top"), F.col("ladder"))).alias("best"),
        F.min_by("model", F.when(F.col("combined") >= F.col("_top") - within, F.col("ladder"))).alias("ship"),
        F.max("combined").alias("best_combined"),
    )


def stratum(text: Column, soft_pass: Column, tier: Column) -> Column:
    """The stratum of a candidate; words of loss end where no ASCII letter, digit or underscore follows."""
    return (
        F.when(text.rlike(rf"(?i)(?<![A-Za-z0-9_])(?:{LOSS_WORDS})(?![A-Za-z0-9_])"), "negative-signal")
        .when(soft_pass, "softpass")
        .when(tier.isin("critical", "high"), "kept-ambiguous")
        .otherwise("kept-distinctive")
    )


def first_of_each(rows: DataFrame, by: list[str], order: list[Column | str], most: int, name: str, salts: int = 64) -> DataFrame:
    """The first ``most`` rows of each group with their place in column name; ties in any order.

    Taken twice: of each group's parts by hash, then of what the parts gave, so a group is ``salts`` tasks and no
    task of the second window holds more than salts times most of its rows.
    """
    salt = F.pmod(F.xxhash64(*order), F.lit(salts))
    part = Window.partitionBy(*by, "_salt").orderBy(*order)
    near = rows.withColumn("_salt", salt).withColumn("_rn", F.row_number().over(part)).where(F.col("_rn") <= most)
    whole = Window.partitionBy(*by).orderBy(*order)
    return near.drop("_salt", "_rn").withColumn(name, F.row_number().over(whole)).where(F.col(name) <= most)


def round_robin(rows: DataFrame, strata: str, group: str, order: Column | str, targets: dict[str, int]) -> DataFrame:
    """Of each stratum as many rows as its target, one from each group a round, groups in order."""
    most, table = max(targets.values()), F.create_map(*[F.lit(x) for pair in targets.items() for x in pair])
    wanted = rows.where(F.col(strata).isin(*targets)).withColumn("_order", order if isinstance(order, Column) else F.col(order))
    taken = first_of_each(first_of_each(wanted, [strata, group], ["_order"], most, "_round"), [strata], ["_round", group], most, "place")
    return taken.where(F.col("place") <= F.try_element_at(table, F.col(strata))).drop("_round", "_order")


def hash_sample(rows: DataFrame, strata: str, group: str, key: Column, per_group: int, targets: dict[str, int]) -> DataFrame:
    """Of each stratum as many rows as its target in order of sha256 of key, at most per_group of a group."""
    most, table = max(targets.values()), F.create_map(*[F.lit(x) for pair in targets.items() for x in pair])
    keyed = rows.where(F.col(strata).isin(*targets)).withColumn("hash", F.sha2(key, 256))
    few = first_of_each(keyed, [strata, group], ["hash"], per_group, "_rn").drop("_rn")
    return first_of_each(few, [strata], ["hash"], most, "place").where(F.col("place") <= F.try_element_at(table, F.col(strata)))


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, or n/a of nothing."""
    return F.when(whole == 0, "n/a").otherwise(F.concat(F.floor(part * 100.0 / whole + 0.5).cast("bigint").cast("string"), F.lit("%")))


def spot_check(judged: DataFrame) -> DataFrame:
    """Precision overall and by tier pair, and sentiment accuracy over true positives that were judged.

    judged: tier, relevant_actually, sentiment, sentiment_actually; unjudged rows are null.
    """
    pair = F.when(F.col("tier").isin("critical", "high"), "critical+high").otherwise("medium+low")
    rows = judged.where("relevant_actually IS NOT NULL").withColumn("tiers", F.explode(F.array(F.lit("all"), pair)))
    hit = F.col("relevant_actually")
    moody = hit & F.col("sentiment_actually").isNotNull()
    out = rows.groupBy("tiers").agg(
        F.count("*").alias("reviewed"), F.count_if(hit).alias("correct"), F.count_if(moody).alias("sentiment_judged"),
        F.count_if(moody & (F.col("sentiment") == F.col("sentiment_actually"))).alias("sentiment_correct"),
    )
    return out.withColumn("precision", percent(F.col("correct"), F.col("reviewed"))).withColumn(
        "sentiment_accuracy", percent(F.col("sentiment_correct"), F.col("sentiment_judged"))
    )


def coverage_audit(rows: DataFrame) -> DataFrame:
    """One row of totals over companies (fetched, kept; -1 for a failed one, counted as 0); zero_kept includes zero_fetched."""
    clamp = lambda c: F.sum(F.greatest(F.lit(0), F.col(c)))
    return rows.agg(
        F.count("*").alias("companies"), clamp("fetched").alias("fetched"), clamp("kept").alias("kept"),
        F.count_if(F.col("fetched") == 0).alias("zero_fetched"),
        F.count_if(F.col("kept") == 0).alias("zero_kept"),
        F.count_if(F.col("fetched") < 0).alias("failed"),
    )


def zero_coverage(rows: DataFrame) -> DataFrame:
    """Companies of which nothing was kept, or nothing came: name, ambiguity, fetched, kept. Failed ones are neither."""
    return rows.where("kept = 0").select("company_id", "name", "ambiguity", "fetched", "kept")


def write_coverage(rows: DataFrame, folder: str, generated_for: str = "human-approved", window_days: int = 90) -> DataFrame:
    """Write an audit (collect.audit_rows) as JSON lines below folder: rows, zero and totals. Returns the totals."""
    rows.write.mode("overwrite").json(f"{folder}/rows")
    written = rows.sparkSession.read.schema(rows.schema).json(f"{folder}/rows")
    zero_coverage(written).write.mode("overwrite").json(f"{folder}/zero")
    marked = coverage_audit(written).select(F.lit(generated_for).alias("generated_for"), F.lit(window_days).alias("window_days"), "*")
    marked.write.mode("overwrite").json(f"{folder}/totals")
    return rows.sparkSession.read.schema(marked.schema).json(f"{folder}/totals")


def prefilter_measurement(judged: DataFrame, company: str) -> DataFrame:
    """fetched, kept, dropped and the dropped share by company, and over all where company is null."""
    keep = F.col("verdict.keep")
    out = judged.rollup(company).agg(F.count("*").alias("fetched"), F.count_if(keep).alias("kept"))
    return out.withColumn("dropped", F.col("fetched") - F.col("kept")).withColumn(
        "dropped_pct", percent(F.col("fetched") - F.col("kept"), F.col("fetched"))
    )


def render_confusion(matrix: list[tuple[str, str, int]], labels: Sequence[str]) -> str:
    """A collected confusion matrix (one row for each pair of labels) as fixed-width text."""
    cells, width = {(a, p): n for a, p, n in matrix}, max(12, *(len(x) + 2 for x in labels))
    lines = ["".join(["actual \\ pred".ljust(width), *(x.rjust(width) for x in labels)])]
    lines += ["".join([a.ljust(width), *(str(cells.get((a, p), 0)).rjust(width) for p in labels)]) for a in labels]
    return "\n".join(lines)
