"""Weighted rubrics and coaching flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T, vocabulary as V


def weighted_score(df: DataFrame, scope: list[str], level: str, weight: str, top: int = 4) -> DataFrame:
    """Per scope: score, the sum of weight * level / top over scored dimensions, and assessed, the sum of their weights. Unscored ones count for nothing, not as zero."""
    scored = F.col(level).isNotNull()
    return df.groupBy(*scope).agg(F.sum(F.when(scored, F.col(weight) * F.col(level) / top)).alias("score"), F.coalesce(F.sum(F.when(scored, F.col(weight))), F.lit(0)).cast("long").alias("assessed"))


def coaching_flags(text: str) -> dict[str, Column]:
    return {"has_number": T.found(text, V.NUMBER), "has_ownership": T.found(text, V.OWNERSHIP), "is_vague": T.found(text, V.VAGUE), "is_negative": T.found(text, V.NEGATIVE)}


def clauses(text: Column) -> Column:
    """The clauses of a text without a negation."""
    return F.filter(F.split(text, V.CLAUSE), lambda c: ~T.found(c, V.NEGATIVE))


def roles_in(text: Column, parts: Column, clues: dict[str, str] | None = None) -> Column:
    """Roles that one of the clauses ``parts`` of a text has a clue for. A clause is looked at only if the text has the clue at all."""
    given = lambda pattern: T.found(text, pattern) & F.exists(parts, lambda c: T.found(c, pattern))
    return F.filter(F.array(*[F.when(given(p), F.lit(r)) for r, p in (clues or V.ROLE_CLUES).items()]), lambda r: r.isNotNull())


def roles_of(text: Column, clues: dict[str, str] | None = None) -> Column:
    """Roles that a clause of the text has a clue for, unless the clause has a negation."""
    return roles_in(text, clauses(text), clues)


def top_directions(df: DataFrame, scope: str, text: str, requested: Column | None = None, most: int = 3, clues: dict[str, str] | None = None) -> DataFrame:
    """Per scope the ``most`` roles with most evidence, the requested one first, ties in the clues' order: scope, rank, role, n."""
    clues = clues or V.ROLE_CLUES
    order = F.element_at(F.create_map(*[F.lit(x) for k, r in enumerate(clues) for x in (r, k)]), F.col("role"))
    some = "|".join(f"(?:{p})" for p in clues.values())
    rows = df.filter(T.found(text, some)).select(scope, F.col(text).alias("_text"), clauses(F.col(text)).alias("_clauses"))
    counts = rows.select(scope, F.explode_outer(roles_in(F.col("_text"), F.col("_clauses"), clues)).alias("role")).filter("role is not null").groupBy(scope, "role").agg(F.count("*").alias("n"))
    asked = F.lit(0) if requested is None else (~F.col("role").eqNullSafe(requested)).cast("int")
    rank = F.row_number().over(Window.partitionBy(scope).orderBy(asked, F.desc("n"), order))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= most).select(scope, "rank", "role", "n")


def first_match(df: DataFrame, scope: str, order: str, value: str, predicate: Column) -> DataFrame:
    """Per scope the first row that meets the predicate: scope, the order and the value."""
    return df.filter(predicate).groupBy(scope).agg(F.min(order).alias(order), F.min_by(value, order).alias(value))


def under_prefix(claims: DataFrame, path: str, prefixes: DataFrame, prefix: str) -> DataFrame:
    """Claims at a path or below it: the path's ancestors are listed and joined by equality."""
    parts = F.split(F.col(path), r"\.")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    return claims.withColumn("_at", F.explode(ancestors)).join(prefixes, F.col("_at") == F.col(prefix)).drop("_at")
