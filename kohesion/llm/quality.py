"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document.
Expectation-maximisation over the counts of all vote patterns estimates how
often each labeller votes each way on good and on bad documents, without any
given label, and so a posterior for each pattern.  Documents of a bounded
sample with these posteriors as labels train a logistic scorer over hashed
features of the whole text, which then scores every document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kohesion.llm import _text
from kohesion.llm._store import filter_batches, save

#: Documents that the scorer is fitted on, at most about this many.
SAMPLE = 4000
_GOOD, _BAD, _NONE = 1, 0, 2


def _classes() -> np.ndarray:
    kind = np.zeros(256, np.uint8)
    kind[[*range(0x30, 0x3A)]] = 1
    kind[[*range(0x41, 0x5B)]] = 2
    kind[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = 3
    # Marks that running text has: . , ; : ' " ( ) - ? /
    kind[list(b".,;:'\"()-?/")] = 4
    kind[list(b"!")] = 5
    kind[list(b"|")] = 6
    kind[[*range(0x09, 0x0E), 0x20]] = 7
    return kind


_KIND = _classes()
_N_KINDS = 8
#: Names of the measures, in order.
MEASURES = ("words", "symbols", "symbol_ends", "exclaims", "uppers", "digits", "bars", "lone_marks", "repeats", "returns", "length", "stops")


def measures(texts: list[str], found: _text.Words | None = None) -> np.ndarray:
    """One row per text; ratios are per word unless said otherwise."""
    found = found or _text.find_words(texts, lower=False)
    n = len(texts)
    counts = found.counts
    per_doc = np.repeat(np.arange(n), np.diff(found.bounds))
    kinds = np.bincount(per_doc * _N_KINDS + _KIND[found.array], minlength=n * _N_KINDS).reshape(n, _N_KINDS)
    w = np.maximum(counts, 1)
    letters = np.maximum(kinds[:, 2] + kinds[:, 3], 1)
    hashes = found.hashes()
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (found.doc[1:] == found.doc[:-1])
    again = np.zeros(len(hashes), bool)
    again[1:] = same[1:] & same[:-1]
    ends = found.array[found.ends - 1]
    stops = np.bincount(found.doc[(ends == ord(".")) | (ends == ord(",")) | (ends == ord("?"))], minlength=n)
    plain = np.concatenate([[0], np.cumsum((_KIND[found.array] >= 1) & (_KIND[found.array] <= 3))])
    lone = plain[found.ends] == plain[found.starts]
    return np.stack(
        [
            counts,
            kinds[:, 0] / w,
            np.bincount(found.doc[_KIND[ends] == 0], minlength=n) / w,
            kinds[:, 5] / w,
            kinds[:, 2] / letters,
            kinds[:, 1] / w,
            kinds[:, 6] / w,
            np.bincount(found.doc[lone], minlength=n) / w,
            np.bincount(found.doc[same], minlength=n) / w,
            np.bincount(found.doc[again], minlength=n) / w,
            (kinds[:, 2] + kinds[:, 3]) / w,
            stops / w,
        ],
        axis=1,
    ).astype(float)


#: Labeller: measure, and the values below and above which it votes (good, bad); the other way round where good is larger.
LABELLERS = {
    "symbols": ("symbols", 0.05, 0.2),
    "symbol_ends": ("symbol_ends", 0.02, 0.08),
    "exclaims": ("exclaims", 0.03, 0.1),
    "uppers": ("uppers", 0.15, 0.25),
    "bars": ("bars", 0.01, 0.05),
    "lone_marks": ("lone_marks", 0.02, 0.05),
    "repeats": ("repeats", 0.05, 0.12),
    "returns": ("returns", 0.03, 0.08),
    "digits": ("digits", 0.3, 1.5),
    "long_words": ("length", 13.0, 20.0),
    "short_words": ("length", 2.5, 1.8),
    "punctuation": ("stops", 0.03, 0.003),
}


def votes(measured: np.ndarray) -> np.ndarray:
    """One row per text, one column per labeller: 1 good, 0 bad, 2 no vote."""
    out = np.full((len(measured), len(LABELLERS)), _NONE, np.int64)
    few = measured[:, 0] < 12
    for j, (name, good, bad) in enumerate(LABELLERS.values()):
        x = measured[:, MEASURES.index(name)]
        out[(x <= good) if good < bad else (x >= good), j] = _GOOD
        # A few words can't show bad habits.
        out[((x >= bad) if good < bad else (x <= bad)) & ~few, j] = _BAD
    return out


def pattern_code(vote: np.ndarray) -> np.ndarray:
    return vote @ (3 ** np.arange(vote.shape[1]))


def decode(codes: np.ndarray) -> np.ndarray:
    return codes[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


@dataclass
class LabelModel:
    """P(good), and P(bad vote | voted, class) by class (bad, good) and labeller.  A missing vote says nothing."""

    prior: float
    bad_rate: np.ndarray

    def posterior(self, vote: np.ndarray) -> np.ndarray:
        logs = (vote == _BAD) @ np.log(self.bad_rate).T + (vote == _GOOD) @ np.log(1 - self.bad_rate).T
        odds = logs[:, 1] - logs[:, 0] + np.log(self.prior) - np.log(1 - self.prior)
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))

    def accuracy(self) -> np.ndarray:
        """Estimated share of right votes of each labeller."""
        return self.prior * (1 - self.bad_rate[1]) + (1 - self.prior) * self.bad_rate[0]


def fit_label_model(vote: np.ndarray, weight: np.ndarray, rounds: int = 500, smooth: float = 0.5) -> LabelModel:
    """Expectation-maximisation over vote patterns and their counts.

    It starts from the belief that a document with a bad vote is rather bad:
    kinds of junk exclude each other, so a majority vote would call all good.
    Labellers overlap, two at least for each kind, so that the classes hold together.
    """
    if not len(vote):
        return LabelModel(0.5, np.full((2, len(LABELLERS)), 0.5))
    good = np.where((vote == _BAD).any(1), 0.1, 0.95)
    model = None
    for _ in range(rounds):
        rates = np.empty((2, vote.shape[1]))
        for c, share in ((0, 1 - good), (1, good)):
            bad = ((vote == _BAD) * (weight * share)[:, None]).sum(0)
            cast = ((vote != _NONE) * (weight * share)[:, None]).sum(0)
            rates[c] = (bad + smooth) / (cast + 2 * smooth)
        prior = float(np.clip((weight * good).sum() / weight.sum(), 0.01, 0.99))
        model = LabelModel(prior, rates)
        new = model.posterior(vote)
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return model


# ---------------------------------------------------------------- scorer

HASHED = 4096
_STEPS = np.array([0, 0.01, 0.03, 0.1, 0.2, 0.4, 0.7, 1, 2, 4, 8, 16, 64, 256])


def features(texts: list[str]) -> np.ndarray:
    """Hashed features of whole texts: square roots of byte-trigram shares, and binned measures."""
    found = _text.find_words(texts, lower=False)
    n = len(texts)
    a = found.array.astype(np.uint32)
    doc = np.repeat(np.arange(n), np.diff(found.bounds))
    # Letters of one case are alike, as the scorer is to know form rather than words.
    a = np.where(_KIND[found.array] == 3, 0x61, np.where(_KIND[found.array] == 2, 0x41, np.where(_KIND[found.array] == 1, 0x30, a))).astype(np.uint32)
    triple = (a[:-2] * np.uint32(65_599) + a[1:-1]) * np.uint32(65_599) + a[2:]
    slot = ((triple * np.uint32(2_654_435_761)) >> np.uint32(21)).astype(np.int64)
    inside = doc[:-2] == doc[2:]
    half = HASHED // 2
    counts = np.bincount((doc[:-2] * half + slot)[inside], minlength=n * half).reshape(n, half)
    share = np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))
    binned = np.zeros((n, half), np.float64)
    rows = measures(texts, found)
    for j in range(rows.shape[1]):
        bins = np.searchsorted(_STEPS, rows[:, j], side="right")
        binned[np.arange(n), (j * 97 + bins * 31) % half] += 0.5
    return np.concatenate([share, binned], axis=1).astype(np.float32)


def fit_scorer(x: np.ndarray, target: np.ndarray, rounds: int = 300, decay: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft labels with classes of equal weight, by accelerated gradient descent; the last weight is the bias."""
    x = np.concatenate([x.astype(float), np.ones((len(x), 1))], axis=1)
    weight = target / max(target.sum(), 1e-9) + (1 - target) / max((1 - target).sum(), 1e-9)
    weight /= weight.sum()
    rate = 4.0 / max((weight[:, None] * x * x).sum(), 1e-9)
    w, v = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for i in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        new = v - rate * (x.T @ (weight * (p - target)) + decay * v)
        v, w = new + i / (i + 3) * (new - w), new
    return w


def score(texts: list[str | None], weights: np.ndarray) -> np.ndarray:
    """P(good) of each text."""
    out = np.zeros(len(texts))
    for first, part in _text.chunks(texts):
        z = features(part) @ weights[:-1] + weights[-1]
        out[first : first + len(part)] = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    return out


@dataclass
class QualityModel:
    labels: LabelModel
    weights: np.ndarray


def vote_codes(texts: list[str | None]) -> np.ndarray:
    out = [pattern_code(votes(measures(part))) for _, part in _text.chunks(texts)]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def fit_quality(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """Fits the label model on the vote patterns of all rows, and the scorer on about ``sample`` rows taken by a hash of id and text.

    What comes to the driver is one row per vote pattern and the features of the sample.
    """
    own = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def patterns(batches):
        for batch in _text.pieces(batches):
            codes = vote_codes(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64())], ["code"])

    counted = own.select("text").mapInArrow(patterns, "code long").groupBy("code").count().collect()
    codes = np.array([r["code"] for r in counted], np.int64)
    weight = np.array([r["count"] for r in counted], float)
    labels = fit_label_model(decode(codes), weight)
    share = min(1.0, sample / max(weight.sum(), 1))
    kept = own.filter(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)

    def sampled(batches):
        for batch in _text.pieces(batches):
            for _, part in _text.chunks(batch.column(0).to_pylist()):
                x = features(part).astype(np.float16)
                code = vote_codes(part)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), pa.array(code, pa.int64())], ["x", "code"])

    # Rows in a fixed order, so that the fit doesn't depend on partitions.
    rows = sorted((r["code"], bytes(r["x"])) for r in kept.select("text").mapInArrow(sampled, "x binary, code long").toLocalIterator())
    if not rows:
        return QualityModel(labels, np.zeros(HASHED + 1))
    x = np.frombuffer(b"".join(r[1] for r in rows), np.float16).reshape(len(rows), HASHED)
    target = labels.posterior(decode(np.array([r[0] for r in rows], np.int64)))
    return QualityModel(labels, fit_scorer(x, target))


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, weak_label, score, good) per row.

    ``weak_label`` is the label model's posterior, ``score`` the scorer's, both
    of being good; ``good`` says whether the score is at least ``threshold``.
    Null texts count as empty; a text without words is never good and scores 0.
    Null ids stay null, rows that repeat are scored each and alike, texts of any
    length are read whole, and an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches):
        model = sent.value
        for batch in _text.pieces(batches):
            weak, marks = _score_batch(batch.column(1).to_pylist(), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(weak), pa.array(marks), pa.array(marks >= threshold)], ["doc_id", "weak_label", "score", "good"])

    return own.mapInArrow(run, "doc_id long, weak_label double, score double, good boolean")


def _score_batch(texts: list[str | None], model: QualityModel) -> tuple[np.ndarray, np.ndarray]:
    weak = model.labels.posterior(decode(vote_codes(texts))) if texts else np.zeros(0)
    marks = score(texts, model.weights)
    empty = np.array([not (t or "").strip(" \t\n\r\x0b\x0c") for t in texts], bool)
    return np.where(empty, 0.0, weak), np.where(empty, 0.0, marks)


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is at least ``threshold``; columns are those of ``docs``.

    The decision is the text's alone: null is empty, ids don't matter, rows that
    repeat stay or go together, texts of any length are scored whole, and an empty
    table stays empty.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return filter_batches(docs, text_col, lambda: lambda texts: _score_batch(texts.cast(pa.string()).to_pylist(), sent.value)[1] >= threshold)


def weak_labels(docs: DataFrame, model: QualityModel, **columns) -> DataFrame:
    """The scored rows, written to the shared folder."""
    return save(score_quality(docs, model, **columns), "quality")
