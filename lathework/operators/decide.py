"""From a detection to the label that is written, with honest fallback from species to genus to family."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import nonempty
from ..functions.values import finite, let

THRESHOLD = 0.6
RANK_SCORE = {"species": 3, "genus": 2, "family": 1}


def rank_score(rank: Column) -> Column:
    out = F.lit(0)
    for name, score in RANK_SCORE.items():
        out = F.when(rank == name, score).otherwise(out)
    return out


def confident(conf: Column, threshold: float = THRESHOLD) -> Column:
    return finite(conf) & (conf >= threshold)


def best_alternative(alternatives: Column, threshold: float = THRESHOLD) -> Column:
    """The alternative to fall back to: confident, of genus before family, likelier first, then first."""
    fit = F.filter(
        F.transform(alternatives, lambda a, i: F.struct(rank_score(a["identified_rank"]).alias("score"), a["confidence"].alias("conf"), (-i).alias("pos"), a.alias("a"))),
        lambda x: x["a"]["identified_rank"].isin("genus", "family") & confident(x["conf"], threshold) & nonempty(x["a"]["rank_name"]).isNotNull(),
    )
    keys = F.transform(fit, lambda x: F.struct(x["score"].alias("score"), x["conf"].alias("conf"), x["pos"].alias("pos")))
    best = F.array_max(keys)
    return F.get(F.filter(fit, lambda x: x["pos"] == best["pos"]), F.lit(0))["a"]


def decide(rank: Column, common: Column, scientific: Column, rank_name: Column, conf: Column, alternative: Column | None = None, threshold: float = THRESHOLD) -> Column:
    """action, rank, display, scientific, rank_name, uncertain and confidence of what is written.

    ``alternative`` is what a species that is not confident falls back to, null if nothing.
    """

    def made(action: str, r: Column, d: Column, s: Column, n: Column, u: bool, c: Column) -> Column:
        return F.struct(
            F.lit(action).alias("action"), r.alias("rank"), d.alias("display"), s.alias("scientific"), n.alias("rank_name"), F.lit(u).alias("uncertain"),
            c.alias("confidence"),
        )

    def chosen(own: Column) -> Column:
        names = own["display"], own["scientific"], own["rank_name"]
        out = F.when((rank == "species") & confident(conf, threshold), made("write", rank, *names, False, conf))
        if alternative is not None:
            a = alternative
            other = nonempty(a["common_name"]), nonempty(a["scientific_name"]), nonempty(a["rank_name"])
            out = out.when((rank == "species") & a.isNotNull(), made("write", a["identified_rank"], *other, True, a["confidence"]))
        out = out.when(rank.isin("species", "genus", "family"), made("write", rank, *names, True, conf))
        return out.otherwise(made("skip", rank, *names, False, conf))

    # The names are cleaned once, not in every branch.
    return let(F.struct(nonempty(common).alias("display"), nonempty(scientific).alias("scientific"), nonempty(rank_name).alias("rank_name")), chosen)


def render(decision: Column) -> Column:
    """The label of a decision; null where it has none."""
    return let(decision, _rendered)


def _rendered(d: Column) -> Column:
    both = F.concat(d["display"], F.lit(" ("), d["scientific"], F.lit(")"))
    species = F.coalesce(both, d["scientific"], d["display"])
    stem = F.coalesce(d["rank_name"], d["scientific"], d["display"])
    return F.when(
        d["action"] == "write",
        F.when((d["rank"] == "species") & ~d["uncertain"], species)
        .when(d["rank"] == "species", F.concat(F.regexp_replace(species, r"\?$", ""), F.lit("?")))
        .when(d["rank"] == "genus", F.concat(stem, F.lit(" sp.?")))
        .when(d["rank"] == "family", F.concat(stem, F.lit(" (family)?"))),
    )


def single_per_record(labels: DataFrame, record: list[str], rank: str = "rank", conf: str = "confidence", order: str = "det_idx") -> DataFrame:
    """The one label of each record that ranks highest, then is likeliest, then comes first."""
    by = Window.partitionBy(*record).orderBy(F.desc("_score"), F.desc("_conf"), order)
    scored = labels.withColumn("_score", rank_score(F.col(rank))).withColumn("_conf", F.coalesce(F.col(conf), F.lit(-1.0)))
    return scored.withColumn("_n", F.row_number().over(by)).filter("_n = 1").drop("_n", "_score", "_conf")
