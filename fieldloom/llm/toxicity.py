"""Toxicity by weak supervision: voters, a generative label model over them, a linear classifier.

1. Voters are lists of terms: one fixed list, and lists found in labelled rows. Terms are words
   and word beginnings; a term belongs to a list if far more toxic than other sample texts have it.
2. All documents are put through the voters; the counts of vote patterns are all the label model
   needs. It estimates by expectation maximisation how often each voter fires on either class,
   and from the co-occurrence that the classes leave unexplained, how correlated voters are;
   correlated votes are discounted.
3. The model's posterior is the label on which a logistic classifier over the terms is trained,
   on the bounded sample; labels only set its threshold. The classifier scores every whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from fieldloom.llm.batches import add_columns, column, forget_tables, steps, texts
from fieldloom.llm.stage import whole_text, written

# Common insults in several languages, one voter of its own.
INSULTS = (
    "idiot idiots moron morons stupid loser losers pathetic worthless disgusting scum trash clown "
    "imbecile dumb jerk bastard asshole bitch filth vermin retard freak "
    "imbécile connard salaud ordure abruti dégueulasse dummkopf trottel abschaum arschloch "
    "estúpido imbécil basura escoria asqueroso gilipollas"
).split()

# The classifier and the found lists come from at most this many labelled rows.
SAMPLE_ROWS = 20_000
# Terms kept, and how many times commoner a term must be in toxic texts.
MAX_TERMS = 2_000
LEAST_LIFT = 30.0
LISTS = 8
_letters = re.compile(r"[^\W\d_]+").findall
BEGINNINGS = (4, 5, 6)


def terms_of(word: str) -> list[str]:
    """Terms of a raw word: its letter runs in lower case, and their beginnings, marked ``~``."""
    out = []
    for run in _letters(word.lower()):
        out.append(run)
        out.extend("~" + run[:n] for n in BEGINNINGS if len(run) >= n)
    return out


def text_terms(text: str) -> set[str]:
    """All terms of a text."""
    return {term for word in set(text.split()) for term in terms_of(word)}


def is_held_out(key: Column) -> Column:
    """Rows whose labels are never looked at: crc32 of the key as text leaves 0 by 5."""
    return F.crc32(key.cast("string").cast("binary")) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Texts and labels of at most ``rows`` labelled rows that are not held out. Written."""
    some = (
        labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~is_held_out(F.col(key)))
        .select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label"))
        .orderBy(F.xxhash64("_key"), "_key")
        .limit(rows)
    )
    # At most ``rows`` keys of 16 bytes: small by its bound.
    some = F.broadcast(some.groupBy("_key").agg(F.max("_label").alias("_label")))
    rows_ = docs.select(F.col(key).alias("_key"), whole_text(text).alias("_text"))
    # Copies of one text are one piece of evidence.
    return written(rows_.join(some, "_key").groupBy(F.xxhash64("_text").alias("_h")).agg(F.first("_text").alias("_text"), F.max("_label").alias("_label")))


def found_terms(sample: DataFrame, limit: int = MAX_TERMS, lift: float = LEAST_LIFT) -> list[tuple[str, int, int]]:
    """Terms with the number of toxic and of other sample texts that have them, most telling first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_tables()
        totals: list[Counter] = [Counter(), Counter()]
        for part in steps(batches, "_text"):
            for text, label in zip(texts(part, "_text"), column(part, "_label").to_pylist(), strict=True):
                totals[1 if label else 0].update(text_terms(text))
        keys = list(totals[0].keys() | totals[1].keys())
        for at in range(0, len(keys), 50_000):
            own = keys[at : at + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(own, pa.string()), pa.array([totals[1][k] for k in own], pa.int64()), pa.array([totals[0][k] for k in own], pa.int64())],
                names=["term", "pos", "neg"],
            )

    sizes = {r["_label"] > 0: r["n"] for r in sample.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = sizes.get(True, 0), sizes.get(False, 0)
    if not pos:
        return []
    rate = (F.col("pos") + 0.5) / (pos + 1.0) / ((F.col("neg") + 0.5) / (neg + 1.0))
    kept = (
        sample.select("_text", "_label")
        .mapInArrow(count, "term string, pos long, neg long")
        .groupBy("term")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        .where((F.col("pos") >= max(3, round(0.01 * pos))) & (rate >= lift))
        .orderBy(F.col("pos").desc(), "neg", "term")
        .limit(limit)
    )
    return [(r["term"], r["pos"], r["neg"]) for r in kept.collect()]


@dataclass
class Voters:
    """Which term belongs to which lists, as bits."""

    names: list[str]
    bits: dict[str, int]


def make_voters(found: list[tuple[str, int, int]], lists: int = LISTS) -> Voters:
    """The fixed list, and the found terms dealt over lists: whole words and word beginnings apart.

    A beginning that only stands for one found word, or for a shorter beginning, is left out, so
    that lists do not repeat each other more than they must.
    """
    chosen = []
    count = {term: pos for term, pos, _ in found}
    for term, pos, _neg in found:
        stem = term.removeprefix("~")
        shorter = any(count.get("~" + stem[:n], 0) >= pos for n in BEGINNINGS if n < len(stem))
        if term.startswith("~") and (shorter or count.get(stem, 0) >= pos):
            continue
        if not term.startswith("~") and any(count.get("~" + stem[:n], 0) > 1.5 * pos for n in BEGINNINGS):
            continue
        chosen.append(term)
    half = max(1, lists // 2)
    bits = {word: 1 for word in INSULTS}
    for begins, base in ((False, 1), (True, 1 + half)):
        for at, term in enumerate(t for t in chosen if t.startswith("~") == begins):
            bits[term] = bits.get(term, 0) | 1 << (base + at % half)
    names = ["fixed"] + [f"words{i}" for i in range(half)] + [f"beginnings{i}" for i in range(half)]
    return Voters(names, bits)


def vote_patterns(docs: DataFrame, text: str, voters: Voters) -> dict[int, int]:
    """How many documents have each pattern of votes; at most 2**voters numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        vote = WordVotes(voters.bits)
        for part in steps(batches, text):
            total.update(vote.pattern(value) for value in texts(part, text))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["pattern", "n"])

    rows = docs.select(text).mapInArrow(count, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    return {r["pattern"]: r["n"] for r in rows}


class WordVotes(dict):
    """Raw word -> bits of its lists and its terms in use, remembered within a bound."""

    def __init__(self, bits: dict[str, int], limit: int = 200_000):
        super().__init__()
        forget_tables()
        self.bits, self.limit = bits, limit

    def __missing__(self, word: str):
        terms = [t for t in terms_of(word) if t in self.bits]
        value = (_union(self.bits[t] for t in terms), terms) if terms else None
        if len(self) >= self.limit:
            self.clear()
        self[word] = value
        return value

    def hits(self, text: str) -> Iterator[tuple[int, list[str]]]:
        """What the words of a text that have terms in use say."""
        return filter(None, map(self.__getitem__, set(text.split())))

    def pattern(self, text: str) -> int:
        """Votes of a text as bits."""
        return _union(bits for bits, _ in self.hits(text))


def _union(bits) -> int:
    out = 0
    for b in bits:
        out |= b
    return out


@dataclass
class LabelModel:
    """Rates at which voters fire on each class, class balance, and weights that discount correlation.

    A silent voter abstains; that none fires at all is a vote of its own, the last one.
    """

    prior: float
    fire: np.ndarray  # votes x 2: on class 0, on class 1
    weight: np.ndarray
    correlation: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of class 1 for rows of 0/1 votes."""
        ratio = np.log(self.fire[:, 1] / self.fire[:, 0]) * self.weight
        odds = np.log(self.prior / (1 - self.prior)) + votes @ ratio
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


def vote_matrix(patterns: list[int], voters: int) -> np.ndarray:
    """0/1 votes of bit patterns, and the vote that no voter fired."""
    votes = [[*(key >> v & 1 for v in range(voters)), int(key == 0)] for key in patterns]
    return np.array(votes, float).reshape(len(patterns), voters + 1)


def fit_label_model(patterns: dict[int, int], voters: int, prior: float, rounds: int = 60) -> LabelModel:
    """Expectation maximisation over pattern counts; no label is used but the share of class 1.

    Starts from voters that fire more often on class 1. After a first fit, the covariance
    of two voters inside the classes gives their correlation; a voter's weight is one over one
    plus its positive correlations, and the fit is repeated with these weights.
    """
    keys = list(patterns)
    votes = vote_matrix(keys, voters)
    n = np.array([patterns[key] for key in keys], float)
    share = (votes * n[:, None]).sum(axis=0) / max(1.0, n.sum())
    fire = np.clip(np.stack([share * 0.3, share * 3 + 0.05], axis=1), 1e-4, 0.9)
    fire[-1] = 0.99, 0.2
    size = voters + 1
    model = LabelModel(prior, fire, np.ones(size), np.zeros((size, size)))
    for again in range(2):
        for _ in range(rounds):
            p = model.posterior(votes)
            for c, q in enumerate((n * (1 - p), n * p)):
                model.fire[:, c] = np.clip(((votes * q[:, None]).sum(axis=0) + 0.1) / (q.sum() + 10), 1e-5, 0.95)
        if again:
            break
        p = model.posterior(votes)
        cov = np.zeros((size, size))
        var = np.full(size, 1e-9)
        for c, q in enumerate((n * (1 - p), n * p)):
            off = votes - model.fire[:, c]
            cov += (off * q[:, None]).T @ off
            var += (off**2 * q[:, None]).sum(axis=0)
        model.correlation = cov / np.sqrt(np.outer(var, var))
        np.fill_diagonal(model.correlation, 0)
        model.weight = 1 / (1 + np.clip(model.correlation, 0, 1).sum(axis=1))
    return model


@dataclass
class Classifier:
    """Weights of terms; a text's score is logistic in their sum."""

    weights: dict[str, float]
    bias: float


def fit_classifier(sample: list[tuple[set[str], float, int]], terms: list[str], rounds: int = 300) -> Classifier:
    """Logistic regression of posteriors on which terms a text has, then the bias set so that the
    threshold of one half makes fewest errors on the sample's labels.

    Full-batch gradient steps with momentum on a sparse matrix; ridge penalty on the weights.
    """
    place = {term: i for i, term in enumerate(terms)}
    rows = np.concatenate([np.full(len(t), i) for i, (t, _, _) in enumerate(sample)]) if sample else np.zeros(0, int)
    cols = np.array([place[x] for t, _, _ in sample for x in sorted(t)], int)
    rows = rows.astype(int)
    target = np.array([p for _, p, _ in sample])
    label = np.array([y for _, _, y in sample])
    w, b = np.zeros(len(terms)), 0.0
    vw, vb = np.zeros(len(terms)), 0.0
    share = max(1, len(sample))
    for _ in range(rounds):
        z = b + np.bincount(rows, weights=w[cols], minlength=len(sample))
        off = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        gw = np.bincount(cols, weights=off[rows], minlength=len(terms)) / share + 1e-5 * w
        vw, vb = 0.9 * vw - 8.0 * gw, 0.9 * vb - 1.0 * off.sum() / share
        w, b = w + vw, b + vb
    z = b + np.bincount(rows, weights=w[cols], minlength=len(sample))
    order = np.sort(np.unique(z))
    cuts = (order[1:] + order[:-1]) / 2 if len(order) > 1 else np.array([0.0])
    cuts = cuts[np.linspace(0, len(cuts) - 1, min(len(cuts), 400)).astype(int)]
    errors = np.array([((z >= c) != (label > 0)).sum() for c in cuts])
    best = cuts[errors == errors.min()] if len(cuts) else np.array([0.0])
    return Classifier(dict(zip(terms, w.tolist(), strict=True)), float(b - best[len(best) // 2]))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> tuple[Classifier, LabelModel]:
    """The classifier for ``docs``, and the label model behind it."""
    sample = labelled_sample(docs, labels, key, text, label, sample_rows)
    voters = make_voters(found_terms(sample))
    patterns = vote_patterns(docs, text, voters)
    terms = sorted(voters.bits)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes = WordVotes(voters.bits)
        for part in steps(batches, "_text"):
            own = [list(votes.hits(value)) for value in texts(part, "_text")]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([sorted({t for _, ts in row for t in ts}) for row in own], pa.list_(pa.string())),
                    pa.array([_union(b for b, _ in row) for row in own], pa.int64()),
                    column(part, "_label"),
                ],
                names=["terms", "pattern", "label"],
            )

    # At most ``sample_rows`` rows, with the few terms in use that each has.
    rows = sample.select("_text", "_label").mapInArrow(reduce, "terms array<string>, pattern long, label int").collect()
    balance = sum(r["label"] > 0 for r in rows) / len(rows) if rows else 0.05
    model = fit_label_model(patterns or {0: 1}, len(voters.names), min(0.5, max(0.005, balance)))
    posterior = model.posterior(vote_matrix([r["pattern"] for r in rows], len(voters.names)))
    return fit_classifier([(set(r["terms"]), float(p), r["label"]) for r, p in zip(rows, posterior, strict=True)], terms), model


def score(docs: DataFrame, classifier: Classifier, text: str = "text", name: str = "score") -> DataFrame:
    """Add the classifier's score of every whole text, 0 to 1; null counts as empty."""

    def work():
        votes = WordVotes(dict.fromkeys(classifier.weights, 0))
        weights = classifier.weights

        def act(part: pa.RecordBatch) -> list[pa.Array]:
            sums = [classifier.bias + sum(weights[t] for t in {t for _, ts in votes.hits(v) for t in ts}) for v in texts(part, text)]
            return [pa.array(1 / (1 + np.exp(-np.clip(np.array(sums, float), -40, 40))))]

        return act

    return add_columns(docs, text, [StructField(name, DoubleType(), False)], work)


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted`` (1 from a score of 0.5).

    Labels of held-out rows are never used, and nothing but the text enters a score. Repeated
    rows get equal scores; empty and null texts get the score of a text without any term; a null
    key is not held out. Without a single usable toxic label only the fixed list votes. The added
    columns replace columns of those names.
    """
    classifier, _ = train(docs, labels, key, text, label)
    scored = score(docs.drop("held_out", "predicted"), classifier, text)
    return scored.withColumns(
        {
            "held_out": F.coalesce(is_held_out(F.col(key)), F.lit(False)),
            "predicted": (F.col("score") >= 0.5).cast("int"),
        }
    )
