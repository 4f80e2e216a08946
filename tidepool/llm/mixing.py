"""Mixing to target weights with soft domain membership; DataFrame and SQL functions only.

A classifier learned from a labelled table (words in hashed places; naive Bayes over the telling places that a text has, from the odds of
the labelled texts without any) gives every document its posterior over the domains. Non-negative rates are fitted so that the expected tokens of each domain,
``sum(rate * tokens * posterior)``, match the targets: projected gradient least squares from rate 1, with the residual measured in the
metric of the documents above zero. A document's rate depends on its posterior and on the residuals of the rounds alone, so a
round aggregates domains x domains numbers, the driver keeps only those, and no state is carried per document.

A document is emitted floor(rate + u) times, with u a uniform number from the hash of its text and id.

Cases: null and empty texts have no tokens, the prior as posterior, and a rate like any other; repeated rows share rate and copies; labels are
matched by doc_id, null labels and domains outside ``targets`` are not learned from; a domain without labelled rows
has posterior 0, and its target is missed by as much; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import WHITE_RUN, let, spare, whole_text
from tidepool.session import stage_table

#: Of 31 bits: with fewer, long texts would hit told places by the hashes of other words.
PLACES = (1 << 31) - 1
#: A place is told apart if the share of a domain's texts that have it differs from that of the rest by this many standard errors.
LEAST_Z = 6.0
#: ... if place and domain correlate by as much, whatever the number of texts, ...
LEAST_PHI = 0.1
#: ... and if the share is as many times as large.
LEAST_RATIO = 8.0
ROUNDS = 15
#: Share of the log-likelihood that a posterior takes: words of a text are not independent.
TEMPER = 0.5
#: Fixed value: the place of a word that the two words before it equal.
REPEATED = 0


@dataclass
class Classifier:
    """Domains, the score of a text without told places by domain, and what each told place adds, less that for the first domain."""

    domains: list[str]
    base: list[float]
    places: list[int]
    weights: list[list[float]]


@dataclass
class Rates:
    """Targets in tokens and, by round, the step that a unit of posterior adds to the rate before it is cut at zero."""

    targets: list[float]
    steps: list[list[float]] = field(default_factory=list)
    reached: list[float] = field(default_factory=list)


def words(text: Column) -> Column:
    return F.filter(F.split(text, WHITE_RUN), lambda w: w != "")


def word_places(text: Column) -> Column:
    """The hashed place of each word, or the place of repetitions."""
    place = lambda w: F.pmod(F.xxhash64(w), F.lit(PLACES - 1)).cast("int") + 1

    def places(ws: Column) -> Column:
        again = lambda w, i: (i >= 2) & (F.get(ws, i - 1) == w) & (F.get(ws, i - 2) == w)
        return F.transform(ws, lambda w, i: F.when(again(w, i), F.lit(REPEATED)).otherwise(place(w)))

    return let(words(text), places)


def constants(values: list, kind: str) -> Column:
    """An array that the optimiser folds to one literal, however many values it has."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def learn(docs: DataFrame, labelled: DataFrame, domains: list[str], doc: str = "doc_id", text: str = "text") -> Classifier:
    """Naive Bayes over the places that a text has; ``labelled`` has doc_id and domain.

    Only the told places reach the driver: a told one stands in about a hundredth of a domain's texts at least, so a hundred times the
    distinct words of an average text bound their number, whatever the number of texts.
    """
    name = spare(docs, "domain")
    asked = labelled.where(F.col("domain").isin(domains)).select(F.col("doc_id").alias(doc), F.col("domain").alias(name)).distinct()
    # labels grow with the documents: the same join at every size, and no broadcast that only small inputs can afford
    body = docs.select(F.col(doc), whole_text(text).alias("t")).join(asked.hint("merge"), doc)
    body = stage_table(body.select(F.col(name).alias("domain"), F.array_distinct(word_places(F.col("t"))).alias("places")), "labelled-places")
    sizes = {r.domain: r.n for r in body.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    n = [sizes.get(d, 0) for d in domains]
    total = sum(n)
    if not total:
        return Classifier(list(domains), [0.0] * len(domains), [], [[] for _ in domains])
    inside = [F.sum((F.col("domain") == d).cast("long")).alias(f"n{i}") for i, d in enumerate(domains)]
    found = body.select("domain", F.explode("places").alias("place")).where("place is not null").groupBy("place").agg(F.count("*").alias("n"), *inside)
    share = F.col("n") / total
    told = F.lit(False)
    for i in range(len(domains)):
        if 0 < n[i] < total:
            own, rest = F.col(f"n{i}") / n[i], (F.col("n") - F.col(f"n{i}")) / (total - n[i])
            error = share * (1 - share) * (1 / n[i] + 1 / (total - n[i]))
            told |= (own >= LEAST_RATIO * rest) & ((own - rest) * (own - rest) >= max(LEAST_Z**2, LEAST_PHI**2 * total) * error)
    rows = sorted(found.where(told).collect(), key=lambda r: r.place)
    chance = np.array([[(r[f"n{i}"] + 0.5) / (n[i] + 1) for r in rows] for i in range(len(domains))]).reshape(len(domains), len(rows))
    weight = np.log(chance) - np.log(chance[:1])
    is_told, _ = _lookup([r.place for r in rows])
    plain = body.where(F.size(F.filter("places", is_told)) == 0)
    left = {r.domain: r.n for r in plain.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    base = [math.log(left.get(d, 0) + 0.5) if c else -1e9 for d, c in zip(domains, n, strict=True)]
    return Classifier(list(domains), base, [r.place for r in rows], weight.tolist())


def two_slots(places: list[int]) -> list[list[int]]:
    """Two tables of equal length with each place in its slot of one of them (p % length, or p // length % length); -1 is free."""
    size = 16
    while size < 4 * len(places):
        size *= 2
    while True:
        tables = [[-1] * size, [-1] * size]
        for place in places:
            which = 0
            # a place that finds its slot taken moves the other one to its second slot, and so on
            for _ in range(64):
                slot = place % size if which == 0 else place // size % size
                place, tables[which][slot] = tables[which][slot], place
                if place < 0:
                    break
                which = 1 - which
            if place >= 0:
                break
        else:
            return tables
        size *= 2


def _lookup(places: list[int]):
    """Two functions of a place: whether it is told, and the number of a told one from 1; the tables grow with the told places alone."""
    tables = two_slots(places)
    number = {p: i for i, p in enumerate(places, 1)} | {-1: 0}
    size = len(tables[0])
    told = [constants(t, "int") for t in tables]
    numbers = [constants([number[p] for p in t], "int") for t in tables]
    slots = [lambda p: p.bitwiseAND(F.lit(size - 1)), lambda p: F.shiftright(p, size.bit_length() - 1).bitwiseAND(F.lit(size - 1))]
    hit = [lambda p, k=k: F.get(told[k], slots[k](p)) == p for k in (0, 1)]
    number_of = lambda p: F.when(hit[0](p), F.get(numbers[0], slots[0](p))).otherwise(F.get(numbers[1], slots[1](p)))
    return lambda p: hit[0](p) | hit[1](p), number_of


def posterior(text: Column, model: Classifier) -> Column:
    """The probabilities of the domains, in the classifier's order, as an array."""
    is_told, number_of = _lookup(model.places)
    rows = [constants([0.0, *weights], "double") for weights in model.weights[1:]]

    def scores(ids: Column) -> Column:
        def total(row: Column) -> Column:
            return F.aggregate(ids, F.lit(0.0), lambda acc, i: acc + F.get(row, i))

        sums = [F.lit(0.0), *[total(row) for row in rows]]
        return F.array(*[F.lit(b - model.base[0]) + F.lit(TEMPER) * s for b, s in zip(model.base, sums, strict=True)])

    ids = F.transform(F.array_distinct(F.filter(word_places(text), is_told)), number_of)
    raised = let(let(ids, scores), lambda ls: F.transform(ls, lambda x: F.exp(x - F.array_max(ls))))
    return let(raised, lambda es: F.transform(es, lambda e: e / F.aggregate(es, F.lit(0.0), lambda a, b: a + b)))


def rate(post: Column, fitted: Rates) -> Column:
    """The rate of a posterior: the steps of all rounds, cut at zero after each."""
    if not fitted.steps:
        return F.lit(1.0)
    steps = F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in fitted.steps])
    dot = lambda s: F.aggregate(F.zip_with(post, s, lambda p, x: p * x), F.lit(0.0), lambda a, b: a + b)
    return F.aggregate(steps, F.lit(1.0), lambda r, s: F.greatest(F.lit(0.0), r + dot(s)))


def fit(table: DataFrame, targets: list[float], rounds: int = ROUNDS) -> Rates:
    """Projected gradient over ``table`` (tokens, post); ``targets`` in tokens by domain.

    The residual is measured in the metric of the documents whose rate is above zero, so that without further
    cuts at zero one round would remove it. The best round counts.
    """
    n, fitted = len(targets), Rates([float(t) for t in targets])
    at = lambda i: F.get("post", F.lit(i))
    steps: list[list[float]] = []
    least = math.inf
    while True:
        now = table.withColumn("rate", rate(F.col("post"), Rates([], steps)))
        sums = [F.sum(F.col("tokens") * at(i) * F.col("rate")) for i in range(n)]
        gram = [F.sum(F.when(F.col("rate") > 0, F.col("tokens") * at(i) * at(j))) for i in range(n) for j in range(n)]
        got = [float(x or 0.0) for x in now.agg(*sums, *gram).first()]
        miss = np.array(targets, float) - np.array(got[:n])
        size = float(np.abs(miss).sum())
        if size < least:
            fitted.steps, fitted.reached = list(steps), got[:n]
        if len(steps) == rounds or size <= 1e-9 * max(1.0, float(np.abs(targets).sum())) or size >= least * (1 - 1e-4):
            return fitted
        least = size
        steps.append((np.linalg.pinv(np.array(got[n:]).reshape(n, n), rcond=1e-9, hermitian=True) @ miss).tolist())


def soft_rates(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], epochs: float = 1.0,
               doc: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> tuple[Classifier, Rates, DataFrame]:
    """Classifier, fitted rates, and the table (doc_id, tokens, post) they were fitted on.

    ``weights`` are the shares of the domains in the mixture. Its size follows from the first domain, whose expected tokens
    are wanted ``epochs`` times.
    """
    domains = list(weights)
    model = learn(docs, labelled, domains, doc, text)
    body = whole_text(text)
    table = docs.select(F.col(doc).alias("doc_id"), F.size(words(body)).cast("long").alias("tokens"), posterior(body, model).alias("post"))
    table = stage_table(table, "posteriors")
    lead = float(table.agg(F.sum(F.col("tokens") * F.get("post", F.lit(0)))).first()[0] or 0)
    return model, fit(table, [lead * epochs * weights[d] / weights[domains[0]] for d in domains], rounds), table


def copies(rate_column: Column, doc: str = "doc_id", text: str = "text") -> Column:
    """How often a row is emitted: the rate, rounded up with the probability of its fraction."""
    chance = F.pmod(F.xxhash64(F.col(doc), whole_text(text)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.floor(rate_column + chance).cast("int")


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], epochs: float = 1.0, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with each row repeated by its fitted rate."""
    model, fitted, _ = soft_rates(docs, labelled, weights, epochs, doc, text)
    often, number = spare(docs, "often"), spare(docs, "number")
    # bound before the rounds, which would each compute it anew; inline: so would each use of the number
    own_rate = let(posterior(whole_text(text), model), lambda post: rate(post, fitted))
    times = copies(own_rate, doc, text)
    counted = docs.select("*", F.inline(F.array(F.struct(times.alias(often)))))
    repeated = counted.withColumn(number, F.explode(F.array_repeat(F.lit(1), F.col(often))))
    return repeated.select(*[f"`{c}`" for c in docs.columns])


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the labels table: toxic, low or clean."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "clean")
    return labels.select("doc_id", domain.alias("domain")).where("doc_id is not null and domain is not null")
