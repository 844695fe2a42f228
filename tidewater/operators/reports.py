"""Reports over runs, imports, providers and rules: counts by group, rankings, lists of what to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater import values as V
from tidewater.functions.names import JOB_LEVELS, job_level
from tidewater.operators.quality import percent


def filled_counts(rows: DataFrame, of: Column, listed: tuple[str, ...], name: str) -> DataFrame:
    """Number of rows for each listed value, zero where there is none; one grouping, the list is as short as it is."""
    counts = rows.groupBy(of.alias(name)).agg(F.count("*").alias("n"))
    every = rows.sparkSession.createDataFrame([(x,) for x in listed], f"{name} string")
    return every.join(counts, name, "left").select(name, F.coalesce("n", F.lit(0)).alias("n"))


def level_histogram(rows: DataFrame, title: str) -> DataFrame:
    """Contacts by job level, zero-filled."""
    return filled_counts(rows, job_level(F.col(title)), JOB_LEVELS, "level")


def bucket_samples(rows: DataFrame, bucket: str, at: str, each: int = 3) -> DataFrame:
    """Per bucket the count and the first rows in input order, as an array: the feature is a sample of ``each``."""
    w = Window.partitionBy(bucket).orderBy(at)
    payload = F.struct(*[c for c in rows.columns if c != bucket])
    first = rows.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= each).groupBy(bucket).agg(F.array_sort(F.collect_list(F.struct("__n", payload.alias("row")))).alias("x"))
    counts = rows.groupBy(bucket).agg(F.count("*").alias("n"))
    return counts.join(first, bucket).select(bucket, "n", F.transform("x", lambda s: s["row"]).alias("samples"))


def map_totals(rows: DataFrame, counts: str, processed: str) -> DataFrame:
    """Over all runs: their number, records, the sum of the values of their maps of counts, and the mean of it a run."""
    own = F.aggregate(F.coalesce(F.map_values(counts), F.array().cast("array<bigint>")), F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0)))
    out = rows.select(F.coalesce(processed, F.lit(0)).alias("p"), F.coalesce(own, F.lit(0)).alias("f")).agg(F.count("*").alias("runs"), F.coalesce(F.sum("p"), F.lit(0)).alias("records"), F.coalesce(F.sum("f"), F.lit(0)).alias("filled"))
    return out.withColumn("per_run", F.when(F.col("runs") > 0, V.round_half_up(F.col("filled") / F.col("runs"))).otherwise(0.0))


def run_cost(steps: DataFrame, costs: DataFrame, records: int, base: float) -> DataFrame:
    """Credits of steps (position, provider, fields) for each record and in all.

    A field costs what the provider asks for it in costs (provider, field,
    credits), else for its domain field, else 1; an unknown provider has the prices
    of ``default``.  Each step adds a base cost.
    """
    prices = costs.groupBy("provider").agg(F.map_from_entries(F.collect_list(F.struct("field", "credits"))).alias("prices"))
    default = prices.filter("provider = 'default'").select(F.col("prices").alias("other"), F.lit(1).alias("one"))
    own = steps.join(prices, "provider", "left").withColumn("one", F.lit(1)).join(F.broadcast(default), "one", "left")  # one row of default prices
    of = F.coalesce("prices", "other")
    each = F.transform("fields", lambda f: F.coalesce(F.try_element_at(of, f), F.try_element_at(of, F.lit("domain")), F.lit(1.0)))
    credits = F.lit(float(base)) + F.aggregate(each, F.lit(0.0), lambda a, x: a + x)
    return own.select("position", "provider", credits.alias("credits_per_record"), (credits * records).alias("total_credits"))


def cascade_report(steps: DataFrame, length: int) -> DataFrame:
    """Of simulated cascades (case, position, triggered, error, duration_ms): tests, those that reached every step, early exits, errors, mean duration of a step."""
    by_case = steps.groupBy("case").agg(F.count_if("triggered").alias("reached"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.sum("duration_ms").alias("ms"), F.count("*").alias("steps"))
    return by_case.agg(
        F.count("*").alias("tests"), F.count_if(F.col("reached") == length).alias("all_reached"), F.count_if(F.col("reached") < length).alias("early_exits"),
        F.coalesce(F.sum("errors"), F.lit(0)).alias("errors"), F.coalesce(V.round_half_up(F.sum("ms") / F.sum("steps")), F.lit(0.0)).alias("avg_ms"),
    )


def question_counts(rows: DataFrame, pattern: str, question: str, at: str) -> DataFrame:
    """How often each pattern was asked, and its latest wording."""
    return rows.groupBy(pattern).agg(F.count("*").alias("n"), F.max_by(question, F.struct(at, question)).alias("latest"), F.max(at).alias("last_at"))


def recent_stats(rows: DataFrame, rule: str, now: Column, days: int = 30) -> DataFrame:
    """Per rule over the last days: processed, written, skipped, their rate, and the latest time."""
    own = rows.filter(F.col("written_at") >= now - F.expr(f"INTERVAL {int(days)} DAYS"))
    out = own.groupBy(rule).agg(F.count("*").alias("processed"), F.count_if(F.col("status") == "written").alias("written"), F.count_if(F.col("status") == "skipped").alias("skipped"), F.max("written_at").alias("last_at"))
    return out.withColumn("change_rate", F.col("written") / F.col("processed"))


def remediation(insights: DataFrame, rates: DataFrame, rule: str, now: Column, most: int = 3) -> DataFrame:
    """The ``most`` items of highest impact, ranked.

    Insights (rule, message, n, created_at) count n x 1.5 if the rule has rates x 1.2
    if not an hour old; rules with a rate below 80 and unprocessed rows count those.
    """
    known = rates.select(F.col(rule).alias("__rule"), F.lit(True).alias("known"))
    own = insights.join(known, F.col(rule) == F.col("__rule"), "left").select(
        rule, F.col("message").alias("issue"), F.col("n").alias("affected"),
        (F.col("n") * F.when(F.col("known"), 1.5).otherwise(1.0) * F.when(F.col("created_at") > now - F.expr("INTERVAL 1 HOUR"), 1.2).otherwise(1.0)).alias("impact"))
    low = rates.filter((F.col("rate") < 80) & (F.col("unprocessed") > 0)).select(rule, F.concat(F.col("unprocessed").cast("string"), F.lit(" unprocessed records")).alias("issue"), F.col("unprocessed").alias("affected"), F.col("unprocessed").cast("double").alias("impact"))
    order = [F.desc("impact"), F.col(rule).asc_nulls_first(), F.col("issue")]
    top = own.unionByName(low).orderBy(*order).limit(most)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # of ``most`` rows


def actions(rates: DataFrame, rule: str, pairs: DataFrame, quarantine: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """(type, priority, subject, count) of what to do, the most urgent first: rules below 60, pending pairs of grade A, pending quarantine, a run of the last day."""
    row = lambda kind, priority, subject, n: [F.lit(kind).alias("type"), F.lit(priority).alias("priority"), subject.cast("string").alias("subject"), n.cast("bigint").alias("count")]
    none = F.lit(None)
    low = rates.filter((F.col("rate") < 60) & (F.col("affected") > 0)).select(*row("rule_unmatched", 2, F.col(rule), F.col("affected")))
    sure = pairs.filter("status = 'pending' AND grade = 'A'").agg(F.count("*").alias("n")).filter("n > 0").select(*row("grade_a_duplicates", 1, none, F.col("n")))
    held = quarantine.filter("status = 'pending'").agg(F.count("*").alias("n")).filter("n > 0").select(*row("quarantine_pending", 1, none, F.col("n")))
    last = runs.filter("status = 'completed'").agg(F.max_by("processed", "completed_at").alias("n"), F.max("completed_at").alias("at"))
    fresh = last.filter((F.col("n") > 0) & (F.col("at") > now - F.expr("INTERVAL 24 HOURS"))).select(*row("enrichment_available", 3, none, F.col("n")))
    return low.unionByName(sure).unionByName(held).unionByName(fresh).orderBy("priority", F.desc("count"), "type", "subject")


def with_any_issue(issues: list[DataFrame], id: str = "id", most: int | None = 100) -> DataFrame:
    """Distinct ids that any of the tables of issues has, in order: a report of the first ``most``."""
    every = issues[0].select(id)
    for x in issues[1:]:
        every = every.unionByName(x.select(id))
    out = every.distinct().orderBy(id)
    return out.limit(most) if most else out


def provider_coverage(results: DataFrame, fields: list[str], by: str = "provider") -> DataFrame:
    """Per provider: records tested, matched (any field filled), the rate, and how many have each field."""
    has = {f: ~V.is_missing(F.col(f)) for f in fields}
    hit = F.lit(False)
    for c in has.values():
        hit = hit | c
    out = results.groupBy(by).agg(F.count("*").alias("tested"), F.count_if(hit).alias("matched"), *(F.count_if(c).alias(f"with_{f}") for f, c in has.items()))
    return out.withColumn("match_rate", percent(F.col("matched"), F.col("tested")) / 100)


def recent_keys(rows: DataFrame, key: str, at: str, most: int = 10) -> DataFrame:
    """The last distinct keys, newest first: a report of ``most``."""
    return rows.groupBy(key).agg(F.max(at).alias(at)).orderBy(F.desc(at), key).limit(most)


def by_length(rows: DataFrame, array: str, least: int | None = None, exactly: int | None = None) -> DataFrame:
    """Rows by the length of an array, the longest first; only those of a length, or from one on."""
    n = F.size(array)
    out = rows.withColumn("size", n)
    if exactly is not None:
        out = out.filter(F.col("size") == exactly)
    return (out.filter(F.col("size") >= least) if least is not None else out).orderBy(F.desc("size"))


def entitlements(orgs: DataFrame, usage: DataFrame, since: Column, kinds: tuple[str, ...], limits: dict[str, int]) -> DataFrame:
    """Organisations with their use of each kind from usage (org_id, kind, amount, at) since an instant, and what remains of the limits."""
    own = usage.groupBy("org_id").agg(*(F.sum(F.when((F.col("kind") == k) & (F.col("at") >= since), F.col("amount")).otherwise(0)).alias(f"{k}_used") for k in kinds))
    out = orgs.join(own, "org_id", "left")
    out = out.withColumns({f"{k}_used": F.coalesce(f"{k}_used", F.lit(0)) for k in kinds})
    return out.withColumns({f"{k}_remaining": F.greatest(F.lit(limits[k]) - F.col(f"{k}_used"), F.lit(0)) for k in kinds})


def library_counts(specs: DataFrame, *by: str) -> DataFrame:
    """Number of specifications by category, entity and the like."""
    return specs.groupBy(*by).agg(F.count("*").alias("n"))
