"""Mixing sources to target weights with soft membership.

Staged texts (``nombre_raw``) belong to domains with a probability each. A naive
Bayes classifier over hashed words, learned from a labelled table (``row_id`` and a
domain such as the ``tipo`` of a programme), gives the posteriors. Then nonnegative
rates per record are fitted, so that the expected tokens per domain meet the
targets: least squares with a pull to rate 1, by projected gradient steps. Every
step is one aggregation to one number per domain. Only DataFrame functions are used.

A token is a word: a run of characters other than space and the controls 9 to 13.
Null and empty texts have no token, the domains' prior as posteriors, and rate 1.
Repeated rows are fitted each, null keys are carried along, a domain without a
target gets weight 0, and a target of an unseen domain is an error. Without any
labelled row there is no domain, and every rate is 1.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.llm.columns import drawn_texts
from starloom.session import materialize

logger = logging.getLogger(__name__)

RESULTS = ("tokens", "posterior", "rate", "domain", "copies")
BUCKETS = 2_048
ROWS_PER_DOMAIN = 2_000
MOST_DOMAINS = 32
SMOOTHING = 0.5
# The evidence of a text counts as that of so many words at most, which keeps memberships soft.
# A parameter of ``mix`` and ``posteriors``; None is plain naive Bayes.
EVIDENCE_WORDS: float | None = 64.0
# Pull of every rate to 1, against curvatures of about 1; most steps, and after how many the rates are
# written down; share of all tokens by which no domain moves any more at the end.
PULL, STEPS, STEPS_PER_WRITE, CLOSE = 0.001, 60, 6, 1e-5


@dataclass(frozen=True)
class DomainModel:
    """Log prior per domain, and log probability per domain and word bucket."""

    domains: list[str]
    prior: list[float]
    weights: list[list[float]]


def words(text: Column) -> Column:
    """The words of a text as an array."""
    plain = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.filter(F.split(plain, " "), lambda w: w != "")


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def fit(rows: DataFrame, labelled: DataFrame, text: str = "nombre_raw", domain: str = "tipo", key: str = "row_id", rows_per_domain: int = ROWS_PER_DOMAIN) -> DomainModel:
    """Learn from about ``rows_per_domain`` labelled rows of each domain, drawn by the hash of ``key``.

    Texts are scanned and not shuffled; of rows that repeat a key one text is learned from.
    """
    named = labelled.select(F.col(key).alias("key"), F.col(domain).cast("string").alias("domain"))
    every = rows.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    texts, counts = drawn_texts(every, named, "key", "domain", "text", rows_per_domain)
    if len(counts) > MOST_DOMAINS:
        raise ValueError(f"more than {MOST_DOMAINS} domains")
    found = texts.select("domain", F.explode(words(F.col("text"))).alias("word"))
    seen = found.groupBy("domain", _bucket(F.col("word")).alias("bucket")).agg(F.count("*").alias("n")).collect()
    domains, total = sorted(counts), sum(counts.values())
    table = {d: [SMOOTHING] * BUCKETS for d in domains}
    for row in seen:
        table[row["domain"]][row["bucket"]] += row["n"]
    weights = [[math.log(v / sum(table[d])) for v in table[d]] for d in domains]
    return DomainModel(domains, [math.log(counts[d] / total) for d in domains], weights)


def posteriors(
    df: DataFrame,
    model: DomainModel,
    key: str = "row_id",
    text: str = "nombre_raw",
    also: Sequence[str] = (),
    evidence_words: float | None = EVIDENCE_WORDS,
) -> DataFrame:
    """``key``, the columns ``also``, ``tokens`` and the array ``posterior`` of every whole text.

    The log evidence of a text of more than ``evidence_words`` words is scaled down to that of
    so many; with None the posteriors are those of plain naive Bayes. Of columns in ``also`` that
    have the name of a result, the result is kept.
    """
    also = [c for c in also if c.lower() not in (*RESULTS, key.lower())]
    split = df.select(F.col(key).alias(key), *also, F.transform(words(F.col(text)), _bucket).alias("_buckets"))
    count = F.size("_buckets").cast("double")
    scale = F.lit(1.0) if evidence_words is None else F.least(count, F.lit(float(evidence_words))) / F.greatest(count, F.lit(1.0))

    def evidence(k: int) -> Column:
        weights = F.array(*[F.lit(w) for w in model.weights[k]])
        summed = F.aggregate("_buckets", F.lit(0.0), lambda total, b: total + F.element_at(weights, b + 1))
        return (F.lit(model.prior[k]) + summed * scale).alias(f"_e{k}")

    logs = split.select(key, *also, count.alias("tokens"), *[evidence(k) for k in range(len(model.domains))])
    names = [f"_e{k}" for k in range(len(model.domains))]
    most = F.greatest(*names) if len(names) > 1 else F.col(names[0]) if names else F.lit(0.0)
    lifted = logs.select(key, *also, "tokens", *[F.exp(F.col(n) - most).alias(n) for n in names])
    whole = sum((F.col(n) for n in names), F.lit(0.0))
    return lifted.select(key, *also, "tokens", F.array(*[F.col(n) / whole for n in names]).cast("array<double>").alias("posterior"))


def fit_rates(members: DataFrame, targets: list[float], steps: int = STEPS) -> DataFrame:
    """Rows with ``tokens`` and ``posterior``, and the ``rate`` of each.

    The steps minimise ``sum_k weight_k (total_k - target_k)^2 + pull * sum tokens (rate - 1)^2``
    over rates of at least 0, from rate 1 on, in the metric of the tokens: texts
    with the same membership get the same rate however long they are. The weight of
    a domain is the inverse of its curvature, so small domains move as fast as large
    ones. Rates are written down every few steps, which keeps the plans short.
    """
    domains = range(len(targets))
    scale = max(sum(targets), 1.0)
    weigh = [F.col("tokens") * F.element_at("posterior", k + 1) / scale for k in domains]
    belongs = [F.element_at("posterior", k + 1) for k in domains]
    pairs = [(k, j) for k in domains for j in domains if j >= k]
    first = members.agg(*[F.sum(weigh[k] * belongs[j]).alias(f"c{k}_{j}") for k, j in pairs], *[F.sum(weigh[k]).alias(f"t{k}") for k in domains]).first()
    curve = [[first[f"c{min(k, j)}_{max(k, j)}"] or 0.0 for j in domains] for k in domains]
    totals = [first[f"t{k}"] or 0.0 for k in domains]
    goal = [t / scale for t in targets]
    members = members.withColumn("rate", F.lit(1.0))
    largest = max((sum(abs(v) for v in row) for row in curve), default=0.0)
    if largest == 0.0:
        return members
    weight = [1.0 / max(curve[k][k], 1e-9 * largest) for k in domains]
    steepest = max(sum(curve[k][j] * math.sqrt(weight[k] * weight[j]) for j in domains) for k in domains)
    step = 1.0 / (steepest + PULL)
    for number in range(1, steps + 1):
        missed = [t - g for t, g in zip(totals, goal, strict=True)]
        moved = sum((belongs[k] * F.lit(step * weight[k] * missed[k]) for k in domains), F.lit(-step * PULL))
        members = members.withColumn("rate", F.greatest(F.lit(0.0), F.col("rate") * F.lit(1.0 - step * PULL) - moved))
        if number % STEPS_PER_WRITE == 0:
            members = materialize(members)
        sums = members.agg(*[F.sum(weigh[k] * F.col("rate")).alias(f"t{k}") for k in domains]).first()
        before, totals = totals, [sums[f"t{k}"] for k in domains]
        moving = max(abs(t - b) for t, b in zip(totals, before, strict=True))
        if moving < CLOSE:
            return members
    missed = {k: round(t - g, 4) for k, (t, g) in enumerate(zip(totals, goal, strict=True))}
    logger.warning("rates still move after %d steps; totals beside their targets, as shares of all tokens: %s", steps, missed)
    return members


def whole_budget(members: DataFrame, model: DomainModel, weights: Mapping[str, float]) -> float:
    """The least total at which no domain has to shrink to meet its weight."""
    held = _totals(members, model)
    share = _shares(model, weights)
    return max((h / s for h, s in zip(held, share, strict=True) if s > 0), default=0.0)


def _totals(members: DataFrame, model: DomainModel) -> list[float]:
    domains = range(len(model.domains))
    if not model.domains:
        return []
    row = members.agg(*[F.sum(F.col("tokens") * F.element_at("posterior", k + 1)).alias(f"t{k}") for k in domains]).first()
    return [row[f"t{k}"] or 0.0 for k in domains]


def _shares(model: DomainModel, weights: Mapping[str, float]) -> list[float]:
    if unknown := set(weights) - set(model.domains):
        raise ValueError(f"targets for unseen domains: {sorted(unknown)}")
    total = sum(weights.values()) or 1.0
    return [weights.get(d, 0.0) / total for d in model.domains]


def mix(
    df: DataFrame,
    model: DomainModel,
    weights: Mapping[str, float],
    key: str = "row_id",
    text: str = "nombre_raw",
    budget: float | None = None,
    keep_all: bool = False,
    also: Sequence[str] = (),
    evidence_words: float | None = EVIDENCE_WORDS,
    steps: int = STEPS,
) -> DataFrame:
    """One row per input row: key, ``tokens``, ``posterior``, ``domain`` (the likeliest), ``rate`` and ``copies``.

    ``weights`` are the target shares of the domains in ``budget`` tokens (default:
    as many as there are; with ``keep_all`` as many as spare every domain). A row is
    in the mix ``copies`` times: its rate rounded up with the chance of the
    fraction, by the hash of its key. With ``keep_all`` that is at least once.
    Columns named in ``also`` are carried along. The fit ends after ``steps`` steps at the latest,
    with a warning if the totals were still moving then.
    """
    if key.lower() in RESULTS:
        raise ValueError(f"the key must not have the name of a result: {key!r}")
    members = materialize(posteriors(df, model, key, text, also, evidence_words))
    if not model.domains or not weights:
        members = members.withColumn("rate", F.lit(1.0))
    else:
        share = _shares(model, weights)
        tokens = budget or (whole_budget(members, model, weights) if keep_all else sum(_totals(members, model)))
        members = fit_rates(members, [tokens * s for s in share], steps)
    likeliest = F.array_position("posterior", F.array_max("posterior")).cast("int")
    names = F.array(*[F.lit(d) for d in model.domains]).cast("array<string>")
    draw = F.pmod(F.xxhash64(F.lit("mix"), F.col(key)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    copies = (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("int")).cast("int")
    return members.withColumn("domain", F.try_element_at(names, likeliest)).withColumn(
        "copies", F.greatest(copies, F.lit(1)) if keep_all else copies
    )
