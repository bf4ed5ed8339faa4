"""Soft-membership mixing, in DataFrame operations only.

A naive Bayes classifier over words, learned by aggregation over labelled rows, gives each document a posterior over
domains: its words' evidence by word, so that a document of two domains belongs to both, whatever its length.
Projected-gradient least squares then finds a nonnegative rate for each document so that the expected tokens of each
domain, summed over documents, come to the target shares of the token budget. Where a fixed number of gradient rounds
does not get there (small domains beside a dominant one), Newton steps on the domains' multipliers finish the work.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SCALES = tuple(2.0 ** (k / 2) for k in range(-4, 13))  # of the evidence, tried on the labelled rows


@dataclass(frozen=True)
class Domains:
    """names and priors of the domains; words (word, l0, l1, ...): log-ratios of a word's rate in a domain and in all; scale of the evidence."""

    names: list[str]
    priors: list[float]
    words: DataFrame | None
    n_words: int
    scale: float


def tokens(docs: DataFrame, text_col: str) -> DataFrame:
    """docs without the text, a row for each word (A-Z lower-cased, closing punctuation off); a text without words has one empty word."""
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)
    rest = [c for c in docs.columns if c != text_col]
    split = docs.select(*rest, F.explode(F.split(text, r"[\x20\x09-\x0D]+")).alias("token"))
    return split.select(*rest, "token", F.rtrim("token", F.lit(".,;:!?")).alias("word"))


def evidence(docs: DataFrame, words: DataFrame | None, k: int, small: bool, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_tokens, n_known, e0, e1, ...): words of each row, and the sums of their log-ratios. The words are added up before any shuffle."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("_row"), F.col(text_col).alias("text"))
    each = tokens(rows, "text")
    if words is None:
        each = each.withColumn("l0", F.lit(None).cast("double"))
    else:
        each = each.join(F.broadcast(words) if small else words, "word", "left")
    sums = [F.coalesce(F.sum(f"l{d}"), F.lit(0.0)).alias(f"e{d}") for d in range(k)]
    return each.groupBy("_row", "doc_id").agg(F.count_if(F.col("token") != "").alias("n_tokens"), F.count("l0").alias("n_known"), *sums).drop("_row")


def learn_domains(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", most_rows: int = 20_000, most_domains: int = 256, least_ratio: float = 16.0, most_broadcast: int = 500_000) -> Domains:
    """A naive Bayes classifier over words, from at most most_rows labelled rows, by the hash of their id.

    labelled: (doc_id, domain); rows with a null id or domain are left out, of several domains of one id the least holds.
    Words are kept whose counts over the domains differ from chance (likelihood ratio least_ratio at least); the others
    say nothing. The scale of the evidence is that of the least log-loss on the labelled rows. Raises ValueError for more
    than most_domains domains.
    """
    own = labelled.select(F.col("doc_id").alias("_id"), F.col(domain_col).cast("string").alias("_domain")).where("_id is not null and _domain is not null").groupBy("_id").agg(F.min("_domain").alias("_domain"))
    own = own.orderBy(F.xxhash64("_id"), "_id").limit(most_rows)
    sample = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(own), F.col("doc_id") == F.col("_id")).select("doc_id", "text", F.col("_domain").alias("domain")))
    rows = sample.groupBy("domain").agg(F.count("*").alias("n")).orderBy("domain").limit(most_domains + 1).collect()
    if len(rows) > most_domains:
        raise ValueError(f"mixing: more than {most_domains} domains")
    names, total = [r.domain for r in rows], sum(r.n for r in rows)
    if not names:
        return Domains([], [], None, 0, 1.0)
    k = len(names)
    each = tokens(sample, "text").where("word != ''")
    counts = cut(each.groupBy("word").agg(F.count("*").alias("n"), *[F.count_if(F.col("domain") == d).alias(f"c{i}") for i, d in enumerate(names)]))
    sums = counts.agg(F.sum("n").alias("n"), *[F.sum(f"c{i}").alias(f"c{i}") for i in range(k)]).first()
    whole = sums.n or 1
    share = [(sums[f"c{i}"] or 0) / whole for i in range(k)]
    ratio = sum((F.when(F.col(f"c{i}") > 0, 2 * F.col(f"c{i}") * F.log(F.col(f"c{i}") / (F.col("n") * F.lit(max(share[i], 1e-300))))).otherwise(F.lit(0.0)) for i in range(k)), F.lit(0.0))
    # a domain's rate of the word, drawn toward the rate in all by half an occurrence
    logs = [F.log((F.col(f"c{i}") + 0.5 * F.lit(share[i])) / (F.col("n") * F.lit(share[i]) + 0.5 * F.lit(share[i]))).alias(f"l{i}") if share[i] else F.lit(0.0).alias(f"l{i}") for i in range(k)]
    words = cut(counts.where(ratio >= least_ratio).select("word", *logs))
    n_words = words.count()
    priors = [r.n / total for r in rows]
    seen = evidence(sample.select(F.concat_ws("\x1f", F.col("domain"), F.col("doc_id").cast("string")).alias("doc_id"), "text"), words, k, n_words <= most_broadcast, "doc_id", "text")
    seen = cut(seen.withColumn("domain", F.element_at(F.split("doc_id", "\x1f"), 1)))
    own_p = sum((F.when(F.col("domain") == d, p).otherwise(F.lit(0.0)) for d, p in zip(names, _softmax(priors, F.col("scale")), strict=True)), F.lit(0.0))
    tried = seen.withColumn("scale", F.explode(F.array(*[F.lit(x) for x in SCALES]))).select("scale", (-F.log(F.greatest(own_p, F.lit(1e-12)))).alias("loss"))
    losses = {r.scale: r.loss for r in tried.groupBy("scale").agg(F.sum("loss").alias("loss")).collect()}
    return Domains(names, priors, words, n_words, min(losses, key=lambda x: (losses[x], x), default=1.0))


def _softmax(priors: list[float], scale: Column) -> list[Column]:
    """Posteriors from e0, e1, ...: evidence by known word, scaled; a row without known words has the priors."""
    k = len(priors)
    mean = [F.when(F.col("n_known") > 0, F.col(f"e{d}") / F.col("n_known")).otherwise(F.lit(0.0)) for d in range(k)]
    logs = [F.lit(float(np.log(p))) + scale * m for p, m in zip(priors, mean, strict=True)]
    top = F.greatest(*logs) if k > 1 else logs[0]
    exps = [F.exp(x - top) for x in logs]
    whole = sum(exps[1:], exps[0])
    return [x / whole for x in exps]


def posteriors(docs: DataFrame, model: Domains, id_col: str = "doc_id", text_col: str = "text", most_broadcast: int = 500_000) -> DataFrame:
    """(doc_id, n_tokens, p0, p1, ...): the domains' posteriors in the model's order. A row without known words has the priors."""
    got = evidence(docs, model.words, len(model.names), model.n_words <= most_broadcast, id_col, text_col)
    return got.select("doc_id", "n_tokens", *[p.alias(f"p{d}") for d, p in enumerate(_softmax(model.priors, F.lit(model.scale)))])


def fit_rates(state: DataFrame, targets: list[float], budget: float | None = None, rounds: int = 60, tolerance: float = 1e-4, cut_every: int = 10) -> DataFrame:
    """state (doc_id, n_tokens, p0, ...) with rate: minimises the squared distance of domain totals to targets * budget.

    Distances are weighed by the inverse of the domains' moment matrix, so that a small domain counts as a large one and
    the gradient's Lipschitz constant is 1. Round by round rate = max(0, rate - p . weighted residual), the gradient in
    the metric that weighs a document by its tokens. Only the matrix (domains squared in size) and a residual for each
    domain reach the driver. The budget is all tokens unless given.
    """
    k = len(targets)
    p, n = [F.col(f"p{d}") for d in range(k)], F.col("n_tokens")
    first = state.agg(F.sum("n_tokens").alias("all"), *[F.sum(n * p[a] * p[b]).alias(f"h{a}_{b}") for a in range(k) for b in range(a, k)]).first()
    if not first["all"]:
        return state.withColumn("rate", F.lit(1.0))
    whole = float(first["all"])
    moment = np.array([[first[f"h{min(a, b)}_{max(a, b)}"] / whole for b in range(k)] for a in range(k)])
    weigh = np.linalg.pinv(moment, rcond=1e-9, hermitian=True)
    goal = np.array(targets) / sum(targets) * (budget or whole) / whole
    now = state.withColumn("rate", F.lit(1.0))
    for i in range(rounds):
        got = now.agg(*[F.sum(n * p[d] * F.col("rate")).alias(f"t{d}") for d in range(k)]).first()
        residual = np.array([got[f"t{d}"] for d in range(k)]) / whole - goal
        if np.abs(residual).max() <= tolerance:
            break
        by = weigh @ residual
        move = sum((p[d] * F.lit(float(by[d])) for d in range(1, k)), p[0] * F.lit(float(by[0])))
        now = now.withColumn("rate", F.greatest(F.lit(0.0), F.col("rate") - move))
        if (i + 1) % cut_every == 0:
            now = cut(now)
    return now


def meet_targets(state: DataFrame, targets: list[float], budget: float | None = None, rounds: int = 200, tolerance: float = 1e-4) -> DataFrame:
    """state (doc_id, n_tokens, p0, ..., rate) with rates that meet the targets: unchanged where those given do, within tolerance of the tokens.

    Otherwise the nearest such rates (documents weighed by tokens), max(0, rate - p . multipliers) with a multiplier for
    each domain. Newton's method finds them on the dual, whose curvature is the moment matrix of the documents of
    positive rate, so that a small domain takes no more rounds than a large one. A ridge on the multipliers, lowered in
    turn, leads to the least squares where no rates meet the targets: a warning then names the shares that are reached.
    Each round is one aggregation to one row. Raises RuntimeError if the rounds do not suffice.
    """
    k = len(targets)
    p, n = [F.col(f"p{d}") for d in range(k)], F.col("n_tokens")
    whole = float(state.agg(F.sum("n_tokens").alias("all")).first()["all"] or 0)
    if not whole:
        return state
    goal = np.array(targets) / sum(targets) * (budget or whole) / whole

    def rates(lam: np.ndarray) -> Column:
        return F.greatest(F.lit(0.0), sum((-p[d] * F.lit(float(lam[d])) for d in range(k)), F.col("rate")))

    def measure(lam: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Half the squared rates, the domains' tokens and the moments of documents of positive rate, all over all tokens."""
        on = F.when(F.col("new") > 0, n).otherwise(F.lit(0))
        aggs = [F.sum(n * F.col("new") * F.col("new")).alias("q"), *[F.sum(n * p[d] * F.col("new")).alias(f"t{d}") for d in range(k)]]
        aggs += [F.sum(on * p[a] * p[b]).alias(f"h{a}_{b}") for a in range(k) for b in range(a, k)]
        got = state.withColumn("new", rates(lam)).agg(*aggs).first()
        moment = np.array([[got[f"h{min(a, b)}_{max(a, b)}"] for b in range(k)] for a in range(k)])
        return 0.5 * got["q"] / whole, np.array([got[f"t{d}"] for d in range(k)]) / whole, moment / whole

    lam = np.zeros(k)
    half, total, moment = measure(lam)
    if np.abs(total - goal).max() <= tolerance:
        return state
    state = cut(state)
    left = rounds
    for ridge in (1e-4, 1e-6, 1e-8, 1e-10, 1e-12):
        while np.abs(total - goal).max() > tolerance and np.abs(total - goal - ridge * lam).max() > 0.1 * tolerance:
            slope = total - goal - ridge * lam
            move = np.linalg.solve(moment + ridge * np.eye(k), slope)
            now, size = half + goal @ lam + 0.5 * ridge * lam @ lam, 1.0
            while True:
                if not left:
                    raise RuntimeError(f"mixing: {rounds} rounds reach shares {total.round(5).tolist()} of targets {goal.round(5).tolist()}")
                left -= 1
                new = lam + size * move
                got = measure(new)
                if got[0] + goal @ new + 0.5 * ridge * new @ new <= now - 1e-4 * size * (slope @ move) + 1e-12 * abs(now):
                    break
                size /= 2
            lam, (half, total, moment) = new, got
    if np.abs(total - goal).max() > tolerance:
        warnings.warn(f"mixing: no rates meet the targets {goal.round(5).tolist()}; the nearest shares are {total.round(5).tolist()}", stacklevel=2)
    return state.withColumn("rate", rates(lam))


def mix_to_targets(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", budget: float | None = None) -> tuple[DataFrame, list[str]]:
    """(doc_id, n_tokens, p0, ..., rate) and the domains' names in the order of p0, p1, ...

    labelled: (doc_id, domain) for some documents. Domains without a target aim at 0 tokens; a warning names targets of
    domains that no labelled row has, which are left out. Without any labelled row every rate is 1 and there is no p
    column. Documents without words have no tokens, the priors as posterior and a rate as any other. Rows that repeat an
    id are rows of their own; null ids are kept. Other columns are ignored. An empty table gives an empty result. Targets
    are met to 1e-4 of all tokens, or a warning says that no rates meet them.
    """
    model = learn_domains(docs, labelled, id_col, text_col)
    if not model.names:
        return evidence(docs, None, 0, True, id_col, text_col).select("doc_id", "n_tokens").withColumn("rate", F.lit(1.0)), []
    missing = sorted(d for d, t in targets.items() if t and d not in model.names)
    if missing:
        warnings.warn(f"mixing: no labelled row has the domains {missing}; their targets are left out", stacklevel=2)
    aims = [float(targets.get(d, 0.0)) for d in model.names]
    if not any(aims):
        aims = model.priors
    return meet_targets(fit_rates(cut(posteriors(docs, model, id_col, text_col)), aims, budget), aims, budget), model.names
