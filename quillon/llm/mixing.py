"""Mixing to target weights with soft membership.

Native: DataFrame functions only.

* Domains are the classes of a labelled table: ``domain_of`` maps a labelled row to a domain.
* A naive Bayes classifier over hashed words is fitted to at most ``max_labelled`` labelled rows (those of least hash); its table has ``buckets`` rows
  of one weight a domain, a proven size, and is broadcast.  Bucket rates are smoothed towards the rates of all domains, so rare words say little.
* Every document gets domain posteriors from its whole text.
* Rates x minimise sum over domains d of w_d (sum_i t_i p_id x_i - target_d)^2 with x_i between ``least`` and ``most``, t tokens, p posteriors, by projected
  gradient steps with momentum.  With w_d = 1 / mass_d and steps scaled by 1 / t_i the problem is well conditioned. A step needs one number a domain
  from all documents (one aggregate, no shuffle of documents); a document's rate follows from the steps so far.

Expected token totals by domain are what the fit matches; a target beyond reach (``least`` or ``most`` bind, or no document of a domain) is met as far as it goes.

Nulls and ties: a null or empty text has no tokens, prior posteriors and the rate that its posteriors give; every row counts by itself, repeated
``doc_id`` or not; other columns pass through, whatever their names, but mix_tokens, mix_posteriors and mix_rate are replaced.  Without labelled rows all domains share equally.  An empty table gives no rows.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quillon.llm.shared import SMALL_GROUPS, small_batches, written

WORD = r"[\x20\x09-\x0D]+"

#: Bytes of text that a task of the last join sorts and hands on: whoever writes the result holds no more of it, whatever the row groups.
PIECE_BYTES = 16 << 20


def quality_domains() -> Column:
    """Domains of the labels table: toxic, else low, else clean."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").otherwise("clean")


def word_buckets(text: Column, buckets: int) -> Column:
    found = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD), lambda w: w != "")
    return F.transform(found, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))


def fit_classifier(docs: DataFrame, labelled: DataFrame, domains: list[str], buckets: int, max_labelled: int, strength: float) -> tuple[DataFrame, list[float]]:
    """(bucket, weights array<double>) and log priors. labelled: doc_id, domain."""
    classes = {r.domain: r["count"] for r in labelled.groupBy("domain").count().collect()}
    total = sum(classes.get(d, 0) for d in domains)
    priors = [math.log((classes.get(d, 0) + 1) / (total + len(domains))) for d in domains]
    picked = labelled.orderBy(F.xxhash64("doc_id", "domain"), "doc_id", "domain").limit(max_labelled)
    picked = picked.select(F.col("doc_id").alias("label_id"), "domain")
    words = docs.join(F.broadcast(picked), F.col("doc_id") == F.col("label_id")).select("domain", F.explode(word_buckets(F.col("text"), buckets)).alias("bucket"))
    counts = words.groupBy("bucket").agg(*[F.count_if(F.col("domain") == d).alias(f"n{i}") for i, d in enumerate(domains)])
    counts = written(counts, "mix-counts")
    sums = counts.agg(*[F.coalesce(F.sum(f"n{i}"), F.lit(0)) for i in range(len(domains))]).first()
    every = max(1, sum(sums))
    row = sum(F.col(f"n{i}") for i in range(len(domains)))
    weights = F.array(*[F.log((F.col(f"n{i}") + strength * row / every) / (sums[i] + strength) / (row / every)) for i in range(len(domains))])
    return counts.select("bucket", weights.alias("weights")), priors


def posteriors(rows: DataFrame, table: DataFrame, priors: list[float], buckets: int, temper: float, keep: list[str]) -> DataFrame:
    """``keep`` columns (one of them a row key), n_tokens and p0, p1, ... from (keep, text)."""
    n = len(priors)
    words = rows.select(*keep, F.explode_outer(word_buckets(F.col("text"), buckets)).alias("word_bucket"))
    #: One row a bucket: ``buckets`` rows at most.
    hit = words.join(F.broadcast(table), F.col("word_bucket") == F.col("bucket"), "left")
    sums = hit.groupBy(*keep).agg(F.count("word_bucket").alias("n_tokens"), *[F.coalesce(F.sum(F.col("weights")[i]), F.lit(0.0)).alias(f"s{i}") for i in range(n)])
    logs = [F.lit(priors[i]) + F.col(f"s{i}") / temper for i in range(n)]
    top = F.greatest(*logs) if n > 1 else logs[0]
    raised = [F.exp(x - top) for x in logs]
    return sums.select(*keep, "n_tokens", *[(r / sum(raised[1:], raised[0])).alias(f"p{i}") for i, r in enumerate(raised)])


def rate_of(steps: list[list[float]], n: int, least: float, most: float, ahead: bool = False) -> Column:
    """A document's rate after projected steps, from its posteriors; with ``ahead`` the point at which the next gradient is taken.

    A step holds its gradient by domain and the momentum: the next point lies that much further along the rate's last change.
    """
    start = F.lit(float(min(max(1.0, least), most)))
    if not steps:
        return start
    path = F.array(*[F.array(*[F.lit(float(v)) for v in s]) for s in steps])

    def after(state: Column, s: Column) -> Column:
        x = F.greatest(F.lit(float(least)), F.least(F.lit(float(most)), state["ahead"] - sum(s[i] * F.col(f"p{i}") for i in range(n))))
        return F.struct(x.alias("x"), (x + s[n] * (x - state["x"])).alias("ahead"))

    return F.aggregate(path, F.struct(start.alias("x"), start.alias("ahead")), after, lambda state: state["ahead" if ahead else "x"])


def fit_rates(table: DataFrame, n: int, targets: list[float], least: float = 0.0, most: float = 8.0, rounds: int = 60, close: float = 1e-4) -> list[list[float]]:
    """Gradient steps for ``rate_of``. table: n_tokens, p0.. ; targets: token totals.

    Steps gain momentum and lose it when the loss rises.  They end when a step changes no domain's total by more than ``close`` of its tokens; a fit that
    ``rounds`` steps do not settle is warned of.
    """
    mass = table.agg(*[F.coalesce(F.sum(F.col("n_tokens") * F.col(f"p{i}")), F.lit(0.0)) for i in range(n)]).first()
    w = [1 / m if m > 0 else 0.0 for m in mass]
    steps: list[list[float]] = []
    before, last, run = None, None, 0
    for _ in range(rounds):
        rated = table.withColumn("x", rate_of(steps, n, least, most, ahead=True))
        got = rated.agg(*[F.coalesce(F.sum(F.col("n_tokens") * F.col(f"p{i}") * F.col("x")), F.lit(0.0)) for i in range(n)]).first()
        loss = sum(w[i] * (got[i] - targets[i]) ** 2 for i in range(n))
        if last is not None and all(abs(a - b) <= close * m for a, b, m in zip(got, last, mass, strict=True)):
            break
        run = 0 if before is not None and loss > before else run + 1
        before, last = loss, got
        #: The largest eigenvalue of the scaled problem is 1 (rows of posteriors add up to 1), so the step is 1.
        steps.append([*(w[i] * (got[i] - targets[i]) for i in range(n)), run / (run + 3)])
    else:
        warnings.warn(f"rates did not settle in {rounds} steps", stacklevel=2)
    return steps


def mix(
    docs: DataFrame,
    labelled: DataFrame,
    targets: dict[str, float],
    budget: float = 1.0,
    least: float = 0.0,
    most: float = 8.0,
    buckets: int = 1 << 16,
    max_labelled: int = 20_000,
    strength: float = 20_000.0,
    temper: float = 2.0,
    keep: list[str] | None = None,
    learn: DataFrame | None = None,
) -> DataFrame:
    """``keep`` columns (all if None) with mix_tokens, mix_posteriors (by domain in the order of ``targets``) and mix_rate.

    ``targets`` are weights of the domains; they are met over ``budget`` times the documents' tokens.  The classifier learns from the labelled rows of
    ``learn`` (doc_id, text), ``docs`` if None: where labelled rows were dropped from ``docs``, ``learn`` is the table that still holds them.
    """
    with small_batches(docs.sparkSession):
        return _mixed(docs.drop("mix_tokens", "mix_posteriors", "mix_rate"), labelled, targets, budget, least, most, buckets, max_labelled, strength, temper, keep, learn)


def _mixed(docs, labelled, targets, budget, least, most, buckets, max_labelled, strength, temper, keep, learn) -> DataFrame:
    domains = list(targets)
    key = _unused("mix_row", docs.columns)
    kept = [c for c in docs.columns if keep is None or c in keep]
    table, priors = fit_classifier(docs if learn is None else learn, labelled, domains, buckets, max_labelled, strength)
    #: Row keys are written down with the rows: a task that runs again would number them anew otherwise.
    rows = docs.withColumn(key, F.monotonically_increasing_id())
    if keep is None:
        seen = Observation()
        rows = written(rows.observe(seen, F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")), "mix-rows", **SMALL_GROUPS)
        pieces = math.ceil(seen.get["bytes"] / PIECE_BYTES)
        features = written(posteriors(rows.select(key, "text"), table, priors, buckets, temper, [key]), "mix-features")
    else:
        features = written(posteriors(rows.select(key, *kept, "text"), table, priors, buckets, temper, [key, *kept]), "mix-features")
    n = len(domains)
    tokens = features.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    weight = sum(targets.values())
    steps = fit_rates(features, n, [budget * tokens * targets[d] / weight for d in domains], least, most)
    out = features.withColumn("mix_rate", rate_of(steps, n, least, most)).withColumn("mix_posteriors", F.array(*[f"p{i}" for i in range(n)]))
    out = out.withColumnRenamed("n_tokens", "mix_tokens")
    if keep is not None:
        return out.select(*kept, "mix_tokens", "mix_posteriors", "mix_rate")
    out = out.select(F.col(key).alias(f"{key}_of"), "mix_tokens", "mix_posteriors", "mix_rate")
    #: Fewer pieces than cores are left to adaptive execution, which fills the cores first and only then makes larger ones.
    if pieces > docs.sparkSession.sparkContext.defaultParallelism:
        rows, out = rows.repartition(pieces, key), out.repartition(pieces, f"{key}_of")
    return rows.join(out, F.col(key) == F.col(f"{key}_of")).drop(f"{key}_of", key)


def _unused(name: str, columns: list[str]) -> str:
    """``name``, longer where a column has it."""
    while any(c.lower().startswith(name) for c in columns):
        name += "_"
    return name


def repeated(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """Rows as often as their rate says: its whole part, and once more for the share of ids that its fraction is."""
    part = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    times = (F.floor("mix_rate") + (part < F.col("mix_rate") - F.floor("mix_rate")).cast("int")).cast("int")
    name = _unused("mix_times", mixed.columns)
    mixed = mixed.withColumn(name, times).where(F.col(name) > 0)
    return mixed.withColumn(f"{name}_one", F.explode(F.sequence(F.lit(1), F.col(name)))).select(*columns)
