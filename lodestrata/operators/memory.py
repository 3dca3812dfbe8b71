"""The fact store: decay, boosting, updates, contradictions, merging, run comparison.

Every operator takes a frame of facts and gives the new frame; nothing is changed in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.nulls import at_most, number, truthy_or

TTL_BASE = 30.0


def default_ttl(importance: Column, base: float = TTL_BASE) -> Column:
    return base * (1 + number(importance))


def fact_id(content: Column) -> Column:
    return F.concat(F.lit("fact_"), F.substring(F.md5(content), 1, 10))


def glossary_terms(content: Column) -> Column:
    """Title-cased words of three letters or more, without punctuation, once each."""
    bare = F.transform(F.split(F.coalesce(content, F.lit("")), "[ \n\t]+"), lambda w: F.regexp_replace(w, "[^A-Za-z0-9]", ""))
    return F.array_distinct(F.filter(bare, lambda w: w.rlike("^[A-Z][a-z0-9]{2,}$")))


def protection(importance: Column, accesses: Column, factor: float = 0.5) -> Column:
    return number(importance) * factor + F.least(number(accesses) / 10, F.lit(1.0)) * 0.5


def decay_status(new: Column, old: Column) -> Column:
    return F.when(new <= 0, "expired").when(new < 0.5 * old, "critical").when(new < 0.8 * old, "decaying").otherwise("stable")


def decay(facts: DataFrame, days: Column) -> DataFrame:
    """Plain decay: ttl falls by the days not protected; not capped, so that a protection above one
    raises it."""
    new = F.greatest(F.lit(0.0), number(F.col("ttl_days")) - days * (1 - protection(F.col("importance"), F.col("access_count"))))
    out = facts.withColumn("new_ttl", new)
    return out.withColumn("status", decay_status(F.col("new_ttl"), number(F.col("ttl_days"))))


def decay_by_domain(facts: DataFrame, days: Column, domains: Column, protected: list[str], factor: float = 0.5) -> DataFrame:
    """Decay with domain protection: temporary facts age three times as fast; the protection that
    is stored has no cap, the one that reduces has."""
    kept = F.arrays_overlap(domains, F.array(*[F.lit(p) for p in protected])) if protected else F.lit(False)
    temporary = F.array_contains(domains, "temporary")
    total = protection(F.col("importance"), F.col("access_count"), factor) + F.when(kept, 0.8).when(temporary, -0.5).otherwise(0.0)
    reduction = days * F.when(temporary, 3.0).otherwise(1.0) * (1 - F.least(total, F.lit(0.95)))
    out = facts.withColumns({"protection": total, "reduction": reduction})
    out = out.withColumn("new_ttl", F.greatest(F.lit(0.0), number(F.col("ttl_days")) - F.col("reduction")))
    return out.withColumn("status", decay_status(F.col("new_ttl"), number(F.col("ttl_days"))))


def decay_domain_only(facts: DataFrame, domain: str, domains: Column, factor: float) -> DataFrame:
    lower = F.greatest(F.lit(0.0), number(F.col("ttl_days")) - factor * (1 - 0.5 * number(F.col("importance"))))
    return facts.withColumn("new_ttl", F.when(F.array_contains(domains, domain), lower).otherwise(F.col("ttl_days")))


def without_expired(facts: DataFrame) -> DataFrame:
    """Facts with time left; a missing ttl counts as expired."""
    return facts.filter(~at_most(F.col("ttl_days"), 0))


def boost(facts: DataFrame, match: Column, days: float = 30.0, more: float = 0.1) -> DataFrame:
    return facts.withColumns(
        {
            "boosted": F.coalesce(match, F.lit(False)),
            "new_ttl": F.when(match, number(F.col("ttl_days")) + days).otherwise(F.col("ttl_days")),
            "new_importance": F.when(match, F.least(F.lit(1.0), number(F.col("importance")) + more)).otherwise(F.col("importance")),
        }
    )


def upsert(old: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Old rows with new ones put in or laid over: a new value wins where it is not null; operation
    says what happened. Of several new rows with a key the last by `order` counts."""
    if order:
        new = new.groupBy(key).agg(F.max_by(F.struct(*[c for c in new.columns if c != key]), order).alias("_r")).select(key, "_r.*")
    columns = [c for c in old.columns if c != key]
    a = old.withColumn("_old", F.lit(True)).alias("a")
    b = new.withColumn("_new", F.lit(True)).alias("b")
    joined = a.join(b, key, "full_outer")
    pick = lambda c: F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c) if c in new.columns else F.col(f"a.{c}").alias(c)
    operation = F.when(F.col("_new").isNull(), "keep").when(F.col("_old").isNull(), "insert").otherwise("update")
    return joined.select(key, *[pick(c) for c in columns], operation.alias("operation"))


def remember(facts: DataFrame, new: DataFrame) -> DataFrame:
    """Facts keyed by their content's hash. An insert starts at one access; an update counts one
    more, keeps the previous content and takes the new importance."""
    n = new.select(fact_id(F.col("content")).alias("key"), F.col("content").alias("n_content"), F.col("importance").alias("n_importance"))
    both = facts.join(n.dropDuplicates(["key"]), "key", "full_outer")
    fresh = F.col("content").isNull()
    seen = F.col("n_content").isNotNull()
    return both.select(
        "key",
        F.coalesce("n_content", "content").alias("content"),
        F.when(~fresh & seen, F.col("content")).alias("previous_content"),
        F.coalesce("n_importance", "importance").alias("importance"),
        F.when(fresh, 1).otherwise(F.col("access_count") + seen.cast("int")).cast("long").alias("access_count"),
        F.when(fresh, "insert").when(seen, "update").otherwise("keep").alias("operation"),
    )


def learn(facts: DataFrame, news: DataFrame) -> DataFrame:
    """Updates by confidence. news: fact_id, content, confidence. One at least as sure replaces the
    content and adds five hundredths of importance; a less sure one is only an alternative."""
    j = facts.join(news.select("fact_id", F.col("content").alias("n_content"), F.col("confidence").alias("n_confidence")), "fact_id", "left")
    wins = F.col("n_confidence") >= F.col("confidence")
    loses = F.col("n_confidence") < F.col("confidence")
    return j.withColumns(
        {
            "action": F.when(wins, "replaced").when(loses, "alternative").otherwise("kept"),
            "previous_content": F.when(wins, F.col("content")),
            "content": F.when(wins, F.col("n_content")).otherwise(F.col("content")),
            "importance": F.when(wins, F.least(F.lit(1.0), F.col("importance") + 0.05)).otherwise(F.col("importance")),
            "n_alternatives": F.col("n_alternatives") + F.coalesce(loses.cast("long"), F.lit(0)),
            "confidence": F.greatest("confidence", "n_confidence"),
        }
    ).drop("n_content", "n_confidence")


def contradictions(facts: DataFrame) -> DataFrame:
    score = F.col("n_alternatives") * (1 - truthy_or(F.col("confidence"), 0.5))
    return facts.filter("n_alternatives > 0").withColumn("contradiction", score)


def resolve(facts: DataFrame, least: float) -> DataFrame:
    """Contradicted facts get a successor of a tenth more importance and are marked by it."""
    hot = contradictions(facts).filter(F.col("contradiction") >= least)
    made = hot.select((F.col("fact_id") + 1_000_000).alias("fact_id"), F.least(F.lit(1.0), F.col("importance") + 0.1).alias("importance"), F.col("fact_id").alias("resolves"), F.lit(None).cast("long").alias("resolved_by"))
    marked = facts.join(hot.select("fact_id", F.lit(True).alias("hot")), "fact_id", "left")
    old = marked.select("fact_id", "importance", F.lit(None).cast("long").alias("resolves"), F.when(F.col("hot"), F.col("fact_id") + 1_000_000).alias("resolved_by"))
    return old.unionByName(made)


def merge(facts: DataFrame, group: str) -> DataFrame:
    """One fact for each group of two or more: united domains, the largest importance and a
    little more; the members are listed."""
    many = facts.groupBy(group).agg(
        F.count(F.lit(1)).alias("members"), F.sort_array(F.array_distinct(F.flatten(F.collect_set(F.array("lang", "tenure"))))).alias("domains"), F.max("importance").alias("top"), F.min("fact_id").alias("merged_into")
    )
    return many.filter("members >= 2").withColumn("importance", F.least(F.lit(1.0), F.col("top") + 0.05))


def history_with_latest(history: Column, latest: Column) -> Column:
    """A history array with the latest entry at its end, if its time differs from the last one's."""
    last = F.try_element_at(history, F.lit(-1))
    return F.when(last["at"].eqNullSafe(latest["at"]), history).otherwise(F.concat(F.coalesce(history, F.array().cast(f"array<{'struct<at:date,confidence:double>'}>")), F.array(latest)))


def compare_runs(runs: DataFrame) -> DataFrame:
    """Each run against the one before: numbers of tests and failures, total time, and their changes."""
    per = runs.groupBy("run_id").agg(F.count(F.lit(1)).alias("tests"), F.count_if(F.col("passed") == 0).alias("failed"), F.round(F.sum("execution_time"), 2).alias("seconds"))
    w = Window.orderBy("run_id")  # one row for each run
    change = lambda c: F.round(F.col(c) - F.lag(c).over(w), 2).alias(f"d_{c}")
    return per.select("run_id", "tests", "failed", "seconds", change("tests"), change("failed"), change("seconds"))
