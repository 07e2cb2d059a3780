"""Red flags, composite score, levels and explanations.

Every output is a signal that helps an analyst to prioritise; none is a
verdict on a company. Weights are equal; the cut points of the levels are this
library's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .indicators import buyer_concentration, recurrent_pairs

CONCENTRATED = 0.5
RECURRENT = 3
LEVELS = ((75.0, "Critique"), (50.0, "Élevé"), (25.0, "Modéré"))
FLAGS = {"single_bidder": "un seul concurrent", "closed_procedure": "procédure non ouverte", "excluded_bidders": "concurrents écartés", "concentration": "part élevée chez l'acheteur", "recurrent": "attributions répétées"}


def red_flags(won: DataFrame, excluded: DataFrame, open_procedures: list[str]) -> DataFrame:
    """One row for each award with its flags. excluded: (ref_id) of markets with rejected bidders. What is not known raises no flag."""
    known = lambda c: F.coalesce(c, F.lit(False))
    share = buyer_concentration(won).select("buyer", "annee", "winner", "concentration")
    repeat = recurrent_pairs(won).select("winner", "buyer", "annee", "cumulated")
    out = won.join(excluded.select("ref_id").distinct().withColumn("_ex", F.lit(True)), "ref_id", "left").join(share, ["buyer", "annee", "winner"], "left").join(repeat, ["winner", "buyer", "annee"], "left")
    return out.select(
        "ref_id",
        "winner",
        "annee",
        known(F.col("number_of_bidders") == 1).alias("single_bidder"),
        known(~F.col("procedure").isin(open_procedures)).alias("closed_procedure"),
        F.coalesce("_ex", F.lit(False)).alias("excluded_bidders"),
        (F.coalesce("concentration", F.lit(0.0)) >= CONCENTRATED).alias("concentration"),
        (F.coalesce("cumulated", F.lit(0)) >= RECURRENT).alias("recurrent"),
    )


def score(flags: dict[str, str] = FLAGS) -> Column:
    """0 to 100, equal weights."""
    return sum((F.col(f).cast("int") for f in flags), F.lit(0)) * (100.0 / len(flags))


def level(value: Column) -> Column:
    out = F
    for cut, name in LEVELS:
        out = out.when(value >= cut, name)
    return out.otherwise("Faible")


def explanation(flags: dict[str, str] = FLAGS) -> Column:
    """The names of the flags that contribute; a signal, never a verdict."""
    return F.array_join(F.array_compact(F.array(*(F.when(F.col(k), F.lit(v)) for k, v in flags.items()))), "; ")


def scored(flagged: DataFrame) -> DataFrame:
    with_score = flagged.withColumn("risk_score", score())
    return with_score.withColumn("risk_level", level(F.col("risk_score"))).withColumn("explanation", explanation())
