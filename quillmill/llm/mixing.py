"""Mixing sources to target weights with soft memberships (operator 5). DataFrame functions only.

A naive Bayes classifier over hashed words learns domains from a labelled table and gives every document its posterior for
each. A document's expected tokens in a domain are its tokens times that posterior. Rates between 0 and ``most`` are then
fitted to all documents, so that the expected totals of the domains match ``tokens`` times the target weights in least
squares by projected gradient steps. Gradients are taken in the metric of the tokens, where a document's step depends on its
posteriors and the domains' residuals alone, scaled by the Gram matrix of the domains over the documents whose rates are not
held at a bound, so that few steps are needed. A document's
rate is therefore a function of its posteriors and of the steps so far, which are as many numbers as domains and steps: each
step is one aggregate over the documents, and no rates are stored in between.

The training sample is bounded: per domain the PER_DOMAIN labelled documents with the smallest hash of their key, which are
ranked among those below a bound on the hash that the domain's size gives. Counts by domain and bucket
(BUCKETS at most) are the only table that is broadcast. All documents, whole texts, are scored.
"""

from __future__ import annotations

import math
import operator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.runtime import materialize, release

PER_DOMAIN, BUCKETS, STEPS, TOLERANCE, SHARPNESS = 1000, 4096, 20, 1e-4, 24.0


def words(text: str) -> Column:
    """Words between white space in lower case; an empty array for null."""
    return F.filter(F.split(F.translate(F.lower(F.coalesce(F.col(text), F.lit(""))), "\n\t\r\x0b\x0c", "     "), " "), lambda w: w != "")


def n_words(text: str) -> Column:
    """Number of runs of characters other than ASCII white space."""
    flat = F.translate(F.concat(F.lit(" "), F.coalesce(F.col(text), F.lit(""))), "\n\t\r\x0b\x0c", "     ")
    return F.regexp_count(flat, F.lit(" [^ ]")).cast("long")


def bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def domain_of_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) from quality and toxic flags: toxic, high or low; null flags count as 0. One row a key."""
    flag = lambda c: F.coalesce(F.max(c), F.lit(0)) > 0
    return labels.where("doc_id is not null").groupBy("doc_id").agg(F.when(flag("toxic"), "toxic").when(flag("quality"), "high").otherwise("low").alias("domain"))


def sample(labelled: DataFrame, sizes: dict[str, int], domains: list[str]) -> DataFrame:
    """(_id, domain): of each domain the PER_DOMAIN keys with the smallest hash. sizes are the domains' rows; keys are distinct.

    Hashes are uniform, so about twice the rows wanted lie below a bound that the domain's size gives; only these meet in the
    window, however many rows a domain has.
    """
    share = {d: min(1.0, 2 * PER_DOMAIN / max(sizes.get(d, 0), 1)) for d in domains}
    below = [(F.col("domain") == d) & (F.xxhash64("doc_id") <= F.lit(min(2**63 - 1, int(x * 2**64) - 2**63))) for d, x in share.items()]
    order = Window.partitionBy("domain").orderBy(F.xxhash64("doc_id"), "doc_id")
    ranked = labelled.where(reduce(operator.or_, below, F.lit(False))).withColumn("_rn", F.row_number().over(order))
    return ranked.where(F.col("_rn") <= PER_DOMAIN).select(F.col("doc_id").alias("_id"), "domain")


def learn(df: DataFrame, labelled: DataFrame, domains: list[str], key: str = "doc_id", text: str = "text") -> tuple[DataFrame, list[float]]:
    """(bucket, w: log-likelihood of each domain) and the log priors; domains without examples get a small prior."""
    priors = {r["domain"]: r["n"] for r in labelled.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    chosen = sample(labelled, priors, domains)
    texts = df.select(F.col(key).alias("_key"), F.col(text).alias("text"))
    rows = materialize(texts.join(F.broadcast(chosen), F.col("_key") == F.col("_id")).select("domain", "text"))
    seen = [priors.get(d, 0) + 1 for d in domains]
    counts = materialize(rows.select("domain", F.explode(words("text")).alias("word")).groupBy(bucket(F.col("word")).alias("bucket")).agg(*[F.count_if(F.col("domain") == d).alias(f"n{i}") for i, d in enumerate(domains)]))
    totals = counts.agg(*[F.coalesce(F.sum(f"n{i}"), F.lit(0)) for i in range(len(domains))]).first()
    likelihood = [F.log((F.col(f"n{i}") + F.lit(1.0)) / F.lit(float(totals[i] + BUCKETS))) for i in range(len(domains))]
    mean = reduce(operator.add, likelihood) / len(domains)
    model = counts.select("bucket", *[(x - mean).alias(f"w{i}") for i, x in enumerate(likelihood)])
    release(rows)
    return model, [math.log(n / sum(seen)) for n in seen]


def posteriors(df: DataFrame, model: DataFrame, priors: list[float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, tokens, p: array<double>) for each key; rows that share a key are added up.

    The evidence is the mean over a document's words times SHARPNESS, or their sum if that is less, so that long texts aren't
    all certain. Words in buckets that no example has say nothing.
    """
    counted = df.select(F.col(key).alias("doc_id"), n_words(text).alias("tokens"), F.explode_outer(words(text)).alias("word")).withColumn("bucket", bucket(F.col("word")))
    sums = counted.join(F.broadcast(model), "bucket", "left").groupBy("doc_id").agg(F.count("word").alias("tokens"), *[F.coalesce(F.sum(f"w{i}"), F.lit(0.0)).alias(f"s{i}") for i in range(len(priors))])
    scale = F.lit(SHARPNESS) / F.greatest(F.col("tokens"), F.lit(SHARPNESS))
    logits = [F.lit(p) + scale * F.col(f"s{i}") for i, p in enumerate(priors)]
    top = F.greatest(*logits) if len(logits) > 1 else logits[0]
    weights = [F.exp(x - top) for x in logits]
    total = reduce(operator.add, weights)
    # Rounded, so that the order in which sums were taken doesn't show.
    return sums.select("doc_id", F.col("tokens").cast("long").alias("tokens"), F.array(*[F.round(w / total, 9) for w in weights]).alias("p"))


def _rate(steps: list[list[float]], n: int, most: float) -> Column:
    """The rate of a document after these steps (a number for each domain), beginning at half of ``most``."""
    start = F.lit(most / 2)
    if not steps:
        return start

    def step(rate: Column, move: Column) -> Column:
        along = reduce(operator.add, [F.col("p")[i] * move[i] for i in range(n)])
        return F.greatest(F.lit(0.0), F.least(F.lit(float(most)), rate - along))

    return F.aggregate(F.array(*[F.array(*[F.lit(float(g)) for g in move]) for move in steps]), start, step)


def fit(members: DataFrame, targets: list[float], tokens: float | None = None, most: float = 1.0) -> tuple[Column, list[float], list[float]]:
    """The rates as a Column over (tokens, p), the expected totals they lead to and the totals aimed at.

    tokens: all tokens to aim at; by default as many as the scarcest domain allows if every other is thinned to its weight.
    """
    n = len(targets)
    weight = [t / sum(targets) for t in targets]
    p = [F.col("p")[i] for i in range(n)]
    pairs = [(i, j) for i in range(n) for j in range(i, n)]

    def totals_at(rate: Column) -> tuple[list[float], np.ndarray]:
        """Expected totals, and the Gram matrix of the documents whose rate isn't held at a bound."""
        free = F.when((F.col("rate") > 0) & (F.col("rate") < most), F.col("tokens")).otherwise(0)
        sums = members.withColumn("rate", rate).agg(*[F.sum(F.col("tokens") * p[i] * F.col("rate")) for i in range(n)], *[F.sum(free * p[i] * p[j]) for i, j in pairs]).first()
        gram = np.zeros((n, n))
        for (i, j), x in zip(pairs, sums[n:], strict=True):
            gram[i, j] = gram[j, i] = x or 0.0
        return [x or 0.0 for x in sums[:n]], gram

    totals, gram = totals_at(F.lit(most / 2))
    have = [2 * x for x in totals]  # of rate most
    everything = sum(have)
    if everything == 0:
        return F.lit(float(most)), [0.0] * n, [0.0] * n
    if tokens is None:
        tokens = min([have[i] / weight[i] for i in range(n) if weight[i] > 0], default=0.0)
    aim = [w * tokens for w in weight]
    steps: list[list[float]] = []
    best, share = (math.inf, 0, totals), 1.0
    while True:
        error = max(abs(a - b) for a, b in zip(totals, aim, strict=True)) / max(tokens, 1.0)
        share = min(1.0, 2 * share) if error < best[0] else share / 2  # a longer step overshoots where rates are at a bound
        if error < best[0]:
            best = (error, len(steps), totals)
        if error < TOLERANCE or share < 1 / 64 or len(steps) == STEPS:
            return _rate(steps[: best[1]], n, most), best[2], aim
        steps.append((share * np.linalg.solve(gram + 1e-6 * everything * np.eye(n), np.subtract(totals, aim))).tolist())
        totals, gram = totals_at(_rate(steps, n, most))


def mix(df: DataFrame, labelled: DataFrame, targets: dict[str, float], tokens: float | None = None, most: float = 1.0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, tokens, domain_p: array in the order of the sorted domains, rate, copies) for each key of df.

    copies is the rate's whole part, and one more if a hash of the key is below what remains. Texts that are null or empty
    have no tokens, posteriors equal to the priors and the rate that these lead to. Null keys share one row. Labels of keys
    that df lacks still count for the priors. Without labels all domains are equally likely.
    """
    domains = sorted(targets)
    model, priors = learn(df, labelled, domains, key, text)
    members = materialize(posteriors(df, model, priors, key, text))
    rate, _, _ = fit(members, [targets[d] for d in domains], tokens, most)
    out = members.select("doc_id", "tokens", "p", F.round(rate, 6).alias("rate"))
    chance = F.pmod(F.xxhash64(F.lit("mix"), "doc_id"), F.lit(1_000_000)) / 1e6
    return out.select("doc_id", "tokens", F.col("p").alias("domain_p"), "rate", (F.floor("rate") + F.when(chance < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("long").alias("copies"))
