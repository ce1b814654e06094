"""Best representative of each duplicate group: truth discovery over the field values that sources claim."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clademill.session import cut, written


#: By this much the votes for a value of less than the best grade shrink with each round, in a field where the grade decides.
SHRINK = 0.25
#: Rounds after which the discovery gives up with an error; it takes about the logarithm of the largest group.
TOO_MANY = 60
PARTS = 1_000_000  # in which moves are measured


class Field:
    """A field to be fused: its value, how good a value is (higher is better), and whether the grade decides.

    With ``strict`` a value of less than the best grade of an entity loses weight from round to round, so that in the end a
    single claim of the best grade outvotes any number of others; otherwise votes decide, and the grade breaks ties.
    """

    def __init__(self, value: Column, grade: Column | None = None, strict: bool = False) -> None:
        self.value, self.grade, self.strict = value, grade, strict


def claims_of(df: DataFrame, entity: Column, source: Column, fields: Mapping[str, Field]) -> DataFrame:
    """``entity, field, value, source, grade, lesser, n``: how often a source claims a value; ``lesser`` values are those of a
    strict field that have not the best grade of their entity.

    Null values claim nothing, rows without entity are left out; a null source is a source of its own, a null grade the lowest.
    """
    said = [F.struct(F.lit(name).alias("field"), f.value.cast("string").alias("value"), (F.lit(0.0) if f.grade is None else f.grade.cast("double")).alias("grade"), F.lit(f.strict).alias("strict")) for name, f in fields.items()]
    rows = df.select(entity.alias("entity"), F.coalesce(source.cast("string"), F.lit("")).alias("source"), F.explode(F.array(*said)).alias("c"))
    rows = rows.select("entity", "source", "c.*").filter(F.col("entity").isNotNull() & F.col("value").isNotNull())
    claims = cut(rows.groupBy("entity", "field", "value", "source").agg(F.max("grade").alias("grade"), F.first("strict").alias("strict"), F.count(F.lit(1)).alias("n")))
    best = claims.groupBy("entity", "field").agg(F.max("grade").alias("best"))
    return claims.join(best, ["entity", "field"]).withColumn("lesser", F.col("strict") & ~F.col("grade").eqNullSafe(F.col("best"))).drop("strict", "best")


def votes(claims: DataFrame, reliability: DataFrame, rounds: int, keys: tuple[str, ...] = ("entity", "field", "value")) -> DataFrame:
    """``keys`` and ``support``, the reliability of those who claim a value, summed, after so many rounds; ``lesser`` and, if there is one, the best ``grade``."""
    weighed = claims.join(reliability, "source", "left")
    w = F.coalesce("w", F.lit(0.5)) * F.col("n") * F.when(F.col("lesser"), F.lit(SHRINK**rounds)).otherwise(1.0)
    grade = [F.max("grade").alias("grade")] if "grade" in claims.columns else []
    return weighed.groupBy(*keys).agg(F.sum(w).alias("support"), F.bool_or("lesser").alias("lesser"), *grade)


def discover(claims: DataFrame, tolerance: float = 0.01) -> tuple[DataFrame, DataFrame, int]:
    """Votes and source reliabilities after convergence, and the number of rounds.

    A value's share of the votes of its entity and field is the belief in it; a source's reliability is
    the mean belief in what it claims where claims differ, in any field, smoothed towards one half. Both are recomputed in
    turn, while lesser values of strict fields lose weight, until no reliability moves by ``tolerance`` and no lesser value
    has more than ``tolerance`` of the support of its field's first. Entities on which all agree tell nothing about
    sources and take no part in the rounds, which move numbers instead of texts; only two numbers a round come to the driver. A ``tolerance`` of infinity is a plain
    majority vote.
    """
    reliability = cut(claims.select("source").distinct().withColumn("w", F.lit(0.5)))
    if tolerance == float("inf"):
        return votes(claims, reliability, 0), reliability, 0
    spread = claims.groupBy("entity", "field").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).filter("lo <> hi").select("entity", "field")
    argued = claims.join(spread, ["entity", "field"], "left_semi")
    argued = cut(argued.select(F.xxhash64("entity", "field").alias("slot"), F.xxhash64("entity", "field", "value").alias("item"), "source", "lesser", "n"))
    for k in range(1, TOO_MANY + 1):
        support = votes(argued, reliability, k - 1, ("slot", "item"))
        most = lambda lesser: F.max(F.when(F.col("lesser") == lesser, F.col("support")))
        total = support.groupBy("slot").agg(F.sum("support").alias("total"), F.coalesce(most(True) / most(False), F.lit(0.0)).alias("rest"))
        belief = support.join(total, "slot").select("slot", "item", (F.col("support") / F.col("total")).alias("belief"), "rest")
        judged = argued.join(belief, ["slot", "item"]).groupBy("source").agg(((F.sum(F.col("belief") * F.col("n")) + 1) / (F.sum("n") + 2)).alias("new"), F.max("rest").alias("rest"))
        moved = reliability.join(judged, "source", "left").select("source", F.coalesce("new", "w").alias("w"), F.abs(F.coalesce("new", "w") - F.col("w")).alias("step"), "rest")
        parts = lambda x: F.max(F.ceil(F.col(x) * PARTS))
        moved, most_of = written(moved, step=parts("step"), rest=parts("rest"))
        reliability = moved.select("source", "w")
        if max(most_of["step"], most_of["rest"]) < tolerance * PARTS:
            return votes(claims, reliability, k - 1), reliability, k
    raise RuntimeError(f"no convergence after {TOO_MANY} rounds")


def fuse(df: DataFrame, entity: Column, source: Column, fields: Mapping[str, Field], tolerance: float = 0.01) -> DataFrame:
    """One row per entity: ``entity`` and, for each field, its surviving value as text (null if never claimed).

    Of equal support the better grade wins, then the smallest text. Extra columns are ignored.
    """
    claims = cut(claims_of(df, entity, source, fields))
    support, _, _ = discover(claims, tolerance)
    order = F.struct((-F.col("support")).alias("s"), F.coalesce(-F.col("grade"), F.lit(float("inf"))).alias("g"), F.col("value"))
    won = support.groupBy("entity", "field").agg(F.min(order)["value"].alias("value"))
    chosen = won.groupBy("entity").agg(*[F.max(F.when(F.col("field") == name, F.col("value"))).alias(name) for name in fields])
    everyone = df.select(entity.alias("entity")).filter("entity IS NOT NULL").distinct()
    return everyone.join(chosen, "entity", "left")
