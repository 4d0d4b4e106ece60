"""Mixing to target weights by soft membership, in DataFrame expressions only.

A naive Bayes classifier over the presence of hashed words, learned from a labelled table, gives each
document a posterior over domains. Only words whose share of documents differs between a domain and
the first one by more than chance (``CHANCE`` standard errors, as a held-out part chooses) count, since in a long text the many
others add up to noise. Rates ``r >= 0`` for all documents are then fitted so that the expected
token totals of the domains, ``sum r * tokens * posterior``, match the targets, by projected
gradient descent on the weighted squared residuals from ``r = 1``. The residuals are weighted by the
inverse of the domains' second moments over the documents that are not at the bound, so that one
step would do if no further rate met it, and about ten do. The fit ends where a step moves no rate,
whether the targets are met there or out of reach. A step needs a few numbers a domain from the
corpus: each iteration is an aggregation over a compact table of posteriors, and a document's rate
follows from the few step vectors so far, within its row.
"""

from __future__ import annotations

import json
import math
import warnings

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .scratch import Scratch

#: Hashed word buckets of the classifier.
BUCKETS = 32768
#: Labelled rows that the classifier learns from, at most: those with the smallest hashes of doc_id.
TRAIN_ROWS = 20_000
#: Standard errors by which a word's shares must differ: values that are tried.
CHANCE = (3.0, 5.5, 8.0)
#: Rounds in which the priors are brought into line with the labels.
SHIFTS = 3
#: Factors of each domain's evidence that are tried, and powers by which it is weakened in a text longer than LENGTH tokens.
SHARP, DAMP, LENGTH = (0.1, 0.25, 0.5, 1.0, 2.0), (0.0, 0.25, 0.5, 0.75), 100.0
#: The fit has settled when a step moves the rates by less than CLOSE (root mean square over tokens); a fit that has not after STEPS says so.
STEPS, CLOSE = 60, 1e-5
#: Relative residual of a domain beyond which a target counts as missed.
MISSED = 0.05
#: Added to the second moments of the domains.
RIDGE = 2e-4
#: Domains of the labels table and the share of the corpus's tokens that each shall have.
TARGETS = {"clean": 0.92, "junk": 0.03, "toxic": 0.05}


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of a labels table: quality 0 is junk, else toxic 1 is toxic, else clean; rows with null labels are left out."""
    domain = F.when(F.col("quality") == 0, "junk").when(F.col("toxic") == 1, "toxic").otherwise("clean")
    return labels.filter("quality IS NOT NULL AND toxic IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), domain.alias("domain"))


def _buckets(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and ``b``, the hashed words of the whole text."""
    words = F.split(F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), r"[\x20\x09-\x0D.,;:!?\"()\[\]{}]+")
    words = docs.select(*keep, F.filter(words, lambda w: w != "").alias("words"))
    return words.select(*keep, F.transform("words", lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int")).alias("b"))


def _sample(docs: DataFrame, labelled: DataFrame, domains: list[str]) -> DataFrame:
    """(doc_id, domain, text) of the labelled rows to learn from: TRAIN_ROWS labels at most, of those that have a document."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    known = labelled.filter(F.col("domain").isin(domains)).join(ids, "doc_id", "left_semi")
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id", "domain").limit(TRAIN_ROWS)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")


def _counts(sample: DataFrame) -> tuple[dict[str, int], list]:
    """Rows of each domain, and rows (domain, b, n) of those with a word in the bucket: of a fixed size."""
    each = _buckets(sample, "domain").select("domain", F.explode(F.array_distinct("b")).alias("b"))
    counts = each.groupBy("domain", "b").agg(F.count("*").alias("n")).collect()
    return {r.domain: r.n for r in sample.groupBy("domain").agg(F.count("*").alias("n")).collect()}, counts


def _learn(counted: tuple[dict[str, int], list], domains: list[str], chance: float) -> tuple[list[float], list[list[float]]]:
    """Log priors, and for each domain the log likelihood ratios of the buckets to the first domain."""
    rows, counts = counted
    total = sum(rows.values())
    priors = [math.log((rows.get(d, 0) + 1) / (total + len(domains))) for d in domains]
    found = {d: [0] * BUCKETS for d in domains}
    for r in counts:
        found[r.domain][r.b] = r.n
    n0, logs = rows.get(domains[0], 0), [[0.0] * BUCKETS]
    for d in domains[1:]:
        n, own = rows.get(d, 0), [0.0] * BUCKETS
        for b, (x, y) in enumerate(zip(found[d], found[domains[0]])):
            if n and n0 and x + y:
                both = (x + y) / (n + n0)
                error = math.sqrt(both * (1 - both) * (1 / n + 1 / n0))
                if error and abs(x / n - y / n0) > chance * error:
                    own[b] = math.log((x + 0.5) / (n + 1)) - math.log((y + 0.5) / (n0 + 1))
        logs.append(own)
    return priors, logs


def _adds(table: Column):
    return lambda total, i: total + table.getItem(i)


def _evidence(docs: DataFrame, model: tuple[list[float], list[list[float]]], *keep: str) -> DataFrame:
    """``keep``, n_tokens and v1, v2, ...: the log likelihood ratios of the other domains to the first one."""
    hashed = _buckets(docs, *keep).withColumn("d", F.array_distinct("b"))
    ratios = []
    for k, log in enumerate(model[1][1:], 1):
        table = F.from_json(F.lit(json.dumps([round(x, 6) for x in log])), "array<double>")
        ratios.append(F.aggregate("d", F.lit(0.0), _adds(table)).alias(f"v{k}"))
    return hashed.select(*keep, F.size("b").cast("long").alias("n_tokens"), *ratios)


def _weighed(k: int, factors: list[float], damp: float) -> Column:
    """The evidence of domain ``k``: words of one text are not independent, the less the longer it is."""
    if not k:
        return F.lit(0.0)
    return F.col(f"v{k}") * factors[k - 1] * F.pow(F.lit(LENGTH) / F.greatest(F.col("n_tokens"), F.lit(1)), F.lit(damp))


def _soft(evidence: DataFrame, priors: list[float], domains: list[str], weights: tuple[list[float], float], *keep: str) -> DataFrame:
    """Posteriors p_<domain>: the weighed evidence and the priors."""
    scores = [_weighed(k, *weights) + F.lit(priors[k]) for k in range(len(domains))]
    scored = evidence.select(*keep, "n_tokens", *[s.alias(f"s{k}") for k, s in enumerate(scores)])
    top = F.greatest(*[F.col(f"s{k}") for k in range(len(domains))]) if len(domains) > 1 else F.col("s0")
    parts = scored.select(*keep, "n_tokens", *[F.exp(F.col(f"s{k}") - top).alias(f"e{k}") for k in range(len(domains))])
    whole = sum((F.col(f"e{k}") for k in range(1, len(domains))), F.col("e0"))
    return parts.select(*keep, "n_tokens", *[(F.col(f"e{k}") / whole).alias(f"p_{d}") for k, d in enumerate(domains)])


def _losses(evidence: DataFrame, priors: list[float], domains: list[str], tried: list[tuple[list[float], float]]) -> list[float]:
    """The log loss of the labels of ``evidence`` under each of the weights tried, in one aggregation."""
    losses = []
    for weights in tried:
        scores = [_weighed(k, *weights) + priors[k] for k in range(len(domains))]
        top = F.greatest(*scores)
        parts = [F.exp(x - top) for x in scores]
        right = F.coalesce(*[F.when(F.col("domain") == d, parts[k]) for k, d in enumerate(domains)]) / sum(parts[1:], parts[0])
        losses.append(F.avg(-F.log(F.greatest(right, F.lit(1e-12)))))
    return [math.inf if x is None else x for x in evidence.agg(*losses).first()]


def _best_weights(evidence: DataFrame, priors: list[float], domains: list[str]) -> tuple[float, list[float], float]:
    """(log loss, factors, damp): the best factor for all domains with each power, then domain after domain, twice."""
    least = lambda tried: min(zip(_losses(evidence, priors, domains, tried), tried))
    _, (factors, damp) = least([([x] * (len(domains) - 1), d) for d in DAMP for x in SHARP])
    for _ in range(2):
        for k in range(len(domains) - 1):
            _, (factors, damp) = least([(factors[:k] + [x] + factors[k + 1 :], damp) for x in SHARP])
        loss, (factors, damp) = least([(factors, d) for d in DAMP])
    return loss, factors, damp


def _chosen(sample: DataFrame, domains: list[str]) -> tuple[float, tuple[list[float], float], list[float]]:
    """(chance, (factors, damp), shift), by a third of the sample that the rest did not teach.

    Of the values CHANCE, SHARP and DAMP, those with the least log loss; ``shift`` is added to the log priors,
    so that the mean posteriors of that third agree with the shares of its labels.
    """
    apart = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(3)) == 0
    counted = _counts(sample.filter(~apart))
    scratch = Scratch(sample.sparkSession, "mixing")
    best = None
    for chance in CHANCE if len(domains) > 1 else CHANCE[:1]:
        model = _learn(counted, domains, chance)
        evidence = scratch.cut(_evidence(sample.filter(apart), model, "domain"), "evidence")  # of a part of the sample: bounded
        loss, factors, damp = _best_weights(evidence, model[0], domains) if len(domains) > 1 else (0.0, [], 0.0)
        if best is None or loss < best[0]:
            best = (loss, chance, (factors, damp), evidence, model[0])
    _, chance, weights, evidence, priors = best
    shift = [0.0] * len(domains)
    for _ in range(SHIFTS):
        soft = _soft(evidence, [p + x for p, x in zip(priors, shift)], domains, weights, "domain")
        found = soft.agg(F.count("*"), *[F.avg(f"p_{d}") for d in domains], *[F.avg((F.col("domain") == d).cast("double")) for d in domains]).first()
        if not found[0]:
            break
        means, shares = found[1 : 1 + len(domains)], found[1 + len(domains) :]
        shift = [x + math.log(max(b, 1e-3) / max(a, 1e-3)) for x, a, b in zip(shift, means, shares)]
    return chance, weights, shift


def posteriors(docs: DataFrame, labelled: DataFrame, domains: list[str], keep: list[str]) -> DataFrame:
    """``keep``, n_tokens and p_<domain> of each row of ``docs``.

    Words of one text are not independent, so their log likelihood ratios are multiplied by a factor for
    each domain, and weakened in long texts, as a held-out third of the sample chooses; and the priors are
    shifted until the mean posteriors of that third agree with its labels. An empty text has the shifted priors.
    """
    chosen = Scratch(docs.sparkSession, "mixing").cut(_sample(docs, labelled, domains), "sample")
    chance, weights, shift = _chosen(chosen, domains)
    model = _learn(_counts(chosen), domains, chance)
    return _soft(_evidence(docs, model, *keep), [p + x for p, x in zip(model[0], shift)], domains, weights, *keep)


def _rate(domains: list[str], steps: list[list[float]]) -> Column:
    """The rate after the given steps: each subtracts the expected gradient and projects on r >= 0."""
    if not steps:
        return F.lit(1.0)
    move = lambda s: sum((F.col(f"p_{d}") * s[k] for k, d in enumerate(domains[1:], 1)), F.col(f"p_{domains[0]}") * s[0])
    taken = F.from_json(F.lit(json.dumps(steps)), "array<array<double>>")
    return F.aggregate(taken, F.lit(1.0), lambda r, s: F.greatest(F.lit(0.0), r - move(s)))


def _inverse(m: list[list[float]]) -> list[list[float]]:
    """The inverse of a small positive matrix, by Gauss-Jordan elimination with pivots."""
    k = len(m)
    rows = [[*row, *(float(i == j) for j in range(k))] for i, row in enumerate(m)]
    for c in range(k):
        top = max(range(c, k), key=lambda i: abs(rows[i][c]))
        rows[c], rows[top] = rows[top], rows[c]
        rows[c] = [x / rows[c][c] for x in rows[c]]
        for i in range(k):
            if i != c:
                rows[i] = [x - rows[i][c] * y for x, y in zip(rows[i], rows[c])]
    return [row[k:] for row in rows]


def _fit(book: DataFrame, targets: dict[str, float]) -> tuple[Column, list[list[float]], dict[str, float], bool]:
    """The fitted rate as an expression over ``book`` (n_tokens, p_<domain>), its steps, the totals reached as shares of all tokens, and whether the fit has settled.

    The variables are scaled by the root of the tokens, so a step moves the rate of a document by
    its posterior times the weighted residuals, whatever its length.
    """
    domains = list(targets)
    total = float(book.agg(F.sum("n_tokens")).first()[0] or 0)
    if not total:
        return F.lit(1.0), [], {d: 0.0 for d in domains}, True
    k = len(domains)
    both = [(i, j) for i in range(k) for j in range(i, k)]
    steps: list[list[float]] = []
    nearest = (math.inf, 0, {})
    while True:
        now = book.withColumn("r", _rate(domains, steps))
        totals = [F.sum(F.col("r") * F.col("n_tokens") * F.col(f"p_{d}")) for d in domains]
        free = F.when(F.col("r") > 0, F.col("n_tokens")).otherwise(0)
        sums = [x / total for x in now.agg(*totals, *[F.sum(free * F.col(f"p_{domains[i]}") * F.col(f"p_{domains[j]}")) for i, j in both]).first()]
        reached = dict(zip(domains, sums))
        moments = [[sums[k + both.index((min(i, j), max(i, j)))] for j in range(k)] for i in range(k)]
        off = [reached[d] - targets[d] for d in domains]
        # A domain that hardly occurs can't be raised at will: the ridge bounds its weight.
        weight = _inverse([[x + (RIDGE if i == j else 0.0) for j, x in enumerate(row)] for i, row in enumerate(moments)])
        step = [sum(w * x for w, x in zip(row, off)) for row in weight]
        moved = math.sqrt(max(0.0, sum(step[i] * moments[i][j] * step[j] for i in range(k) for j in range(k))))
        if moved < CLOSE:
            return _rate(domains, steps), steps, reached, True
        nearest = min(nearest, (sum(x * x for x in off), len(steps), reached), key=lambda x: x[:2])
        if len(steps) == STEPS:  # where few documents would have to stand for all, the metric may swing: the nearest rates count
            _, n, reached = nearest
            return _rate(domains, steps[:n]), steps[:n], reached, False
        steps.append(step)


def fit_rates(book: DataFrame, targets: dict[str, float]) -> tuple[Column, list[list[float]], dict[str, float]]:
    """The fitted rate as an expression over ``book`` (n_tokens, p_<domain>), its steps, and the totals reached, as shares of all tokens.

    Posteriors of null count nothing; an empty book, or one without tokens, has rate 1.
    """
    return _fit(book, targets)[:3]


def mix(spark: SparkSession, docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """(doc_id, source, n_tokens, p_<domain>..., rate, copies, target_met) of every row of ``docs`` (doc_id, text, source).

    ``targets`` gives the share of the corpus's tokens for each domain of ``labelled`` (doc_id,
    domain); a domain without a labelled row is not aimed at, and the other shares are scaled to one. ``copies`` is the rate rounded up or down by a hash of the doc_id, so that it holds on
    average. Where the targets can't be met, ``target_met`` is false on all rows and a warning
    says what is reached, another one if the fit had not settled by then. Empty and null texts weigh nothing and keep their prior's rate; rows with a
    null doc_id and repeated rows are rated like any other, and a repeated label counts again;
    without labels all posteriors are equal; an empty table gives no rows; texts of any length are
    read whole; other columns are not read, and a missing ``source`` is null.
    """
    if "source" not in docs.columns:
        docs = docs.withColumn("source", F.lit(None).cast("string"))
    scratch = Scratch(spark, "mixing")
    book = scratch.cut(posteriors(docs, labelled, list(targets), ["doc_id", "source"]), "posteriors")
    taught = {r.domain for r in labelled.filter(F.col("domain").isin(list(targets))).select("domain").distinct().collect()} or set(targets)
    whole = sum(targets[d] for d in taught)
    aims = {d: x / whole for d, x in targets.items() if d in taught}
    rate, _, reached, settled = _fit(book, aims)
    if not settled:
        warnings.warn(f"the rates have not settled after {STEPS} steps", stacklevel=2)
    missed = {d: round(reached[d], 4) for d in aims if abs(reached[d] - aims[d]) > MISSED * max(aims[d], 1e-6)}
    if missed:
        warnings.warn(f"the rates reach {missed} in place of {({d: round(aims[d], 4) for d in missed})}", stacklevel=2)
    rated = book.withColumn("rate", rate)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    copies = (F.floor("rate") + F.when(part < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("long")
    return rated.withColumn("copies", copies).withColumn("target_met", F.lit(not missed))
