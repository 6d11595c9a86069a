"""Fields of nested records as rows: keys that may or must be there, values that are set, templates that refer to facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import values as X


def key_rules(df: DataFrame, keys: Column, allowed: list[str], required: list[str], *names: Column) -> DataFrame:
    """Breaches of a record's shape: the names, key and problem (unknown, missing or repeated)."""
    given = F.coalesce(keys, F.array().cast("array<string>"))
    lists = {"unknown": F.array_except(given, F.array(*map(F.lit, allowed))), "missing": F.array_except(F.array(*map(F.lit, required)), given), "repeated": F.array_distinct(F.filter(given, lambda k: F.size(F.filter(given, lambda x: x == k)) > 1))}

    def told(problem: str, found: Column) -> Column:
        return F.transform(found, lambda k: F.struct(k.alias("key"), F.lit(problem).alias("problem")))

    found = F.flatten(F.array(*[told(problem, keys) for problem, keys in lists.items()]))
    return df.select(*names, F.explode(found).alias("f")).select("*", "f.*").drop("f")


def set_fields(fields: DataFrame, updates: DataFrame, scope: list[str], path: str, value: str) -> DataFrame:
    """Fields with new values at the paths of ``updates`` (one a path): adds state: kept, set, or unknown for a path that isn't there, whose value isn't set."""
    new = updates.select(*scope, path, F.col(value).alias("_new"), F.lit(True).alias("_set"))
    both = fields.withColumn("_there", F.lit(True)).join(new, [*scope, path], "full")
    state = F.when(F.col("_there").isNull(), "unknown").when(F.col("_set"), "set").otherwise("kept")
    return both.select(*scope, path, F.when(F.col("_there") & F.col("_set"), F.col("_new")).otherwise(F.col(value)).alias(value), state.alias("state"))


def bound_templates(templates: DataFrame, facts: DataFrame, template: str, refs: str) -> DataFrame:
    """Templates with the facts that their references name: id, value, fact_ids (sorted) and error.

    ``templates`` has id, a template and ``refs``, a map from token to fact id; ``facts`` has fact_id and value. A reference to
    no fact is an error, as are unknown and unused tokens. References are joined by equality and put together again a template.
    """
    one = templates.select("id", F.explode_outer(refs).alias("token", "fact_id"))
    met = one.join(facts.select("fact_id", F.col("value").alias("_value"), F.lit(True).alias("_there")), "fact_id", "left")
    entry = F.when(F.col("token").isNotNull(), F.struct("token", F.coalesce("_value", F.lit(""))))
    whole = met.groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("values"), F.sort_array(F.collect_set("fact_id")).alias("fact_ids"), F.min(F.when(F.col("token").isNotNull() & F.col("_there").isNull(), F.col("fact_id"))).alias("lost"))
    rendered = templates.select("id", F.col(template).alias("_t")).join(whole, "id").withColumn("e", X.render_template("_t", "values"))
    lost = F.concat(F.lit("no fact "), "lost")
    return rendered.select("id", F.when(F.col("lost").isNull(), F.col("e.value")).alias("value"), "fact_ids", F.coalesce(lost, F.col("e.error")).alias("error"))


def claims_of(conflicts: DataFrame, claims: DataFrame, scope: str) -> DataFrame:
    """Conflicts (scope, kind, paths) with the claims at one of their paths or below: scope, kind and fact_ids, sorted."""
    at = conflicts.select(scope, "kind", F.explode("paths").alias("path")).distinct()
    parts = F.split("path", r"\.")
    above = claims.select(scope, "claim_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))).alias("path"))
    met = at.join(above, [scope, "path"]).groupBy(scope, "kind").agg(F.sort_array(F.collect_set("claim_id")).alias("fact_ids"))
    return conflicts.select(scope, "kind").join(met, [scope, "kind"], "left").withColumn("fact_ids", F.coalesce("fact_ids", F.array().cast("array<string>")))
