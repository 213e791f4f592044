"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

Voters are lexicon words, word beginnings and patterns. Lexicons are induced from a bounded sample of
labelled training rows, beside a small fixed one. The label model is a latent-class model: each voter
fires at one rate on toxic and another on clean texts; both rates, the share of toxic texts and the
voters' correlations within a class are estimated anew in every round of classification EM, and correlated
voters (a word and its beginning) share their weight. A logistic model over hashed words and word beginnings is
fitted to the posterior labels and scores whole texts.

Defined results: a null text counts as empty; scores depend on the text only, so repeated rows get
equal scores; without labelled rows of both kinds every score is PRIOR; outputs are built from the
columns asked for, so extra columns may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from graphloom.llm.carry import map_texts, pieces
from graphloom.llm.sampling import fitted

#: Bounds of the labelled sample: rows of either label, characters of a row.
ROWS_PER_CLASS, MAX_CHARS = 3000, 20_000
#: Most induced voters, least toxic texts and least share of toxic texts among those that a voter hits.
VOTERS, LEAST_HITS, LEAST_PRECISION = 300, 6, 0.95
#: Share of the sample up to which a feature is rare, and may tell near copies.
RARE = 0.01
#: Correlation within a class from which voters share their weight.
CORRELATED = 0.5
#: Words whose features are kept per worker before they start anew (memory only).
MEMO = 100_000
BEGINNINGS = (4, 5, 6)
PRIOR = 0.1
STEPS, RATE, RIDGE = 1000, 0.1, 1e-6
#: Standard deviations by which a feature must be more frequent in toxic texts to get a weight.
SIGNIFICANT = 6.0

#: Insults that serve as voters wherever they occur in the sample.
INSULTS = "bastard clown crap creep disgusting dumb fool garbage hate idiot imbecile jerk kill loser moron pathetic pig retard scum shit shut slut stupid trash ugly useless vermin whore worthless".split()

#: Lower-cases A-Z and makes ASCII that is no letter or digit a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def distinct_words(text: str | None) -> set[bytes]:
    return set((text or "").encode().translate(_FOLD).split())


def _features(word: bytes) -> list[bytes]:
    """The word and its beginnings, marked apart."""
    return [word, *(b"^" + word[:k] for k in BEGINNINGS if len(word) > k)]


def slot(feature: bytes) -> int:
    """A feature's 64-bit hash."""
    return xxhash.xxh3_64_intdigest(feature)


class _Slots(dict):
    """Feature slots of a word."""

    def __missing__(self, word: bytes) -> list[int]:
        if len(self) > MEMO:
            self.clear()
        self[word] = found = [slot(f) for f in _features(word)]
        return found


_INSULT = "(?:" + "|".join(INSULTS) + ")"
#: Pattern voters: phrases on the folded text (words between single spaces), and forms of the raw one.
PHRASES = tuple(
    re.compile(p)
    for p in (
        rf"\b(?:you|u|youre|your)(?: are| re| r)?(?: all| such| just| really| so| a| an| the)* {_INSULT}\b",  # an insult to the reader
        rf"\b(?:he|she|they|these|those|that|what)(?: is| are| s| re)?(?: all| such| just| a| an)+ {_INSULT}\b",  # one to others
        rf"\b{_INSULT} (?:\w+ )?{_INSULT}\b",  # two together
        r"\b(?:shut up|get lost|go away|drop dead|go to hell|nobody (?:likes|wants|needs) you)\b",
        r"\b(?:hate|despise|loathe) (?:you|them|him|her|those|these|all)\b",
        r"\b(?:kill|hang|hurt|harm) (?:you|yourself|them|him|her)\b|\b(?:should|hope you|deserve to) die\b",
    )
)
FORMS = tuple(
    re.compile(p)
    for p in (
        r"[!?]{3,}",  # shouting by marks
        r"(?:\b[A-Z]{3,}\b[\s,!]*){3,}",  # three words in capitals
        r"\b[A-Za-z]+[*@#$]+[A-Za-z]+\b",  # letters hidden by signs
        r"([A-Za-z])\1{3,}",  # drawn-out letters
    )
)


def patterns(text: str, lexicon_hits: int) -> list[bool]:
    """Votes of the pattern voters: phrases, forms, capitals, and none or several words of the lexicon."""
    folded = " ".join((text or "").encode().translate(_FOLD).decode("utf-8", "replace").split())
    letters, upper = sum(c.isalpha() for c in text) or 1, sum(c.isupper() for c in text)
    return [*(p.search(folded) is not None for p in PHRASES), *(p.search(text) is not None for p in FORMS), upper > 0.5 * letters, lexicon_hits >= 2, lexicon_hits == 0]


N_PATTERNS = len(PHRASES) + len(FORMS) + 3


def independent(slots: list[np.ndarray], size: int) -> np.ndarray:
    """Weight of each text: near copies, which share their least rare feature, count as one text.

    slots are places in the sorted hashes of `size` features, so the least one is a random one.
    """
    df = np.zeros(size, np.int64)
    for found in slots:
        df[np.unique(found)] += 1
    rare = df <= max(2, RARE * len(slots))
    keys = []
    for k, found in enumerate(slots):
        few = found[rare[found]]
        keys.append(int(few.min()) if len(few) else -1 - k)
    _, group, size = np.unique(keys, return_inverse=True, return_counts=True)
    return 1 / size[group]


def induce(texts: list[str], slots: list[np.ndarray], known: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> list[bytes]:
    """Features that hit toxic texts mostly, by log-likelihood gain; counted by place in `known`, then named."""
    hits = [np.zeros(len(known)), np.zeros(len(known))]
    for found, y, w in zip(slots, labels, weight, strict=True):
        hits[y][np.unique(found)] += w
    n = np.bincount(labels, weight, minlength=2)
    p, q = hits[1] / n[1], hits[0] / n[0]  # classes are sampled at different rates
    share = p / np.maximum(p + q, 1e-12)
    good = np.flatnonzero((hits[1] >= LEAST_HITS) & (share >= LEAST_PRECISION))
    gain = hits[1][good] * (np.log(share[good]) + np.log(2))
    best = good[np.lexsort((good, -gain))[:VOTERS]]
    rank = {int(known[s]): k for k, s in enumerate(best)}
    toxic = np.zeros(len(known), bool)
    toxic[best] = True
    names: dict[int, bytes] = {}
    for text, found, y in zip(texts, slots, labels, strict=True):
        if y and len(names) < len(rank) and toxic[found].any():
            for f in (f for w in sorted(distinct_words(text)) for f in _features(w)):
                if slot(f) in rank:
                    names.setdefault(slot(f), f)
    return [names[s] for s in rank if s in names]


def votes(texts: list[str], lexicon: list[bytes], memo: _Slots) -> np.ndarray:
    """One row per text, one 0/1 column per voter."""
    place = {slot(f): i for i, f in enumerate(lexicon)}
    out = np.zeros((len(texts), len(lexicon) + N_PATTERNS), np.float32)
    for k, text in enumerate(texts):
        fired = [[place[s] for s in memo[w] if s in place] for w in distinct_words(text)]
        out[k, [i for some in fired for i in some]] = 1
        out[k, len(lexicon) :] = patterns(text, sum(map(bool, fired)))
    return out


class LabelModel:
    """Latent classes with firing rates per class and weights that discount correlated voters."""

    def fit(self, fired: np.ndarray, start: np.ndarray, rounds: int = 25) -> LabelModel:
        chosen = start > 0.5
        for _ in range(rounds):
            # rates come from the likelier class: with shared weights, soft ones would drift together
            self._rates(fired, chosen.astype(float))
            self._correlations(fired, chosen.astype(float))
            before, chosen = chosen, self.posterior(fired) > 0.5
            if (chosen == before).all() or not 0 < chosen.sum() < len(chosen):
                break
        return self

    def _correlations(self, fired: np.ndarray, posterior: np.ndarray) -> None:
        """Correlations within a class; voters that fire together count as one."""
        rest = fired - (posterior[:, None] * self.on + (1 - posterior)[:, None] * self.off)
        covariance = rest.T @ rest / len(fired)
        deviation = np.sqrt(np.maximum(np.diag(covariance), 1e-9))
        self.correlation = covariance / deviation[:, None] / deviation
        np.fill_diagonal(self.correlation, 1)
        self.weight = 1 / np.where(np.abs(self.correlation) > CORRELATED, np.abs(self.correlation), 0).sum(1)

    def _rates(self, fired: np.ndarray, posterior: np.ndarray) -> None:
        self.prior = float(np.clip(posterior.mean(), 1e-3, 1 - 1e-3))
        self.on = (posterior @ fired + 0.5) / (posterior.sum() + 1)
        self.off = ((1 - posterior) @ fired + 0.5) / ((1 - posterior).sum() + 1)

    def posterior(self, fired: np.ndarray) -> np.ndarray:
        yes, no = np.log(self.on / self.off), np.log((1 - self.on) / (1 - self.off))
        logit = np.log(self.prior / (1 - self.prior)) + fired @ (self.weight * (yes - no)) + (self.weight * no).sum()
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def fit_linear(parts: list[np.ndarray], known: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[dict[int, float], float]:
    """Non-negative logistic weights of hashed features and the intercept, by full-batch projected Adam.

    Only features that toxic texts have significantly more often get a weight, so that the many words of
    a long clean text add nothing and those of a long toxic text hide nothing.
    """
    slots = np.concatenate(parts).astype(np.int64)
    row = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
    one, two, rest = np.unique(row * len(known) + slots), float(target @ weight), float((1 - target) @ weight)
    yes = np.bincount(one % len(known), (target * weight)[one // len(known)], len(known))
    no = np.bincount(one % len(known), ((1 - target) * weight)[one // len(known)], len(known))
    p, q, both = yes / two, no / rest, (yes + no) / (two + rest)
    used = np.flatnonzero((p >= LEAST_PRECISION * (p + q)) & ((p - q) > SIGNIFICANT * np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / two + 1 / rest))))
    kept = np.isin(slots, used)
    row, slots = row[kept], np.searchsorted(used, slots[kept])
    w, bias = np.zeros(len(used)), 0.0
    m, v, mb, vb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for t in range(1, STEPS + 1):
        logit = np.bincount(row, w[slots], len(parts)) + bias
        gap = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - target) / len(target)
        grad, grad_b = np.bincount(slots, gap[row], len(used)) + RIDGE * w, gap.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        mb, vb = 0.9 * mb + 0.1 * grad_b, 0.999 * vb + 0.001 * grad_b * grad_b
        w = np.maximum(0, w - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-6))
        bias -= RATE * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-6)
    return {int(known[k]): float(x) for k, x in zip(used, w, strict=True) if x > 0}, float(bias)


def fit(sample: list[tuple[str, int]]) -> tuple[dict[int, float], float]:
    """Weights and intercept from a sample of (text, label)."""
    y = np.array([label for _, label in sample], np.int64)
    if len(set(y.tolist())) < 2:
        return {}, float(np.log(PRIOR / (1 - PRIOR)))
    texts, memo = [t for t, _ in sample], _Slots()
    parts = [np.array([s for w in sorted(distinct_words(t)) for s in memo[w]], np.uint64) for t in texts]
    known, place = np.unique(np.concatenate(parts), return_inverse=True)
    parts = np.split(place, np.cumsum([len(x) for x in parts])[:-1])
    weight = independent(parts, len(known))
    lexicon = list(dict.fromkeys([*induce(texts, parts, known, y, weight), *(w.encode() for w in INSULTS)]))
    fired = votes(texts, lexicon, memo)
    moving = (fired.sum(0) >= 3) & (fired.sum(0) <= len(fired) - 3)
    model = LabelModel().fit(fired[:, moving], start=(fired[:, :-1].sum(1) > 0) * 1.0)
    posterior = model.posterior(fired[:, moving])
    return fit_linear(parts, known, posterior, weight)


class Scorer:
    """Scores texts with given weights; a word's share of the logit is computed once per worker."""

    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias, self.memo = weights, bias, {}

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        memo, weights = self.memo, self.weights
        if len(memo) > MEMO:
            memo.clear()
        logits = []
        for text in texts:
            words = distinct_words(text)
            for w in words:
                if w not in memo:
                    memo[w] = sum(weights.get(slot(f), 0.0) for f in _features(w))
            logits.append(self.bias + sum(sorted(map(memo.__getitem__, words))))  # sorted: sets have no order
        return 1 / (1 + np.exp(-np.clip(logits, -30, 30)))


def score(docs: DataFrame, labels: DataFrame, train: Column, keep: list[Column | str], text: str = "text", label: str = "toxic", key: str = "doc_id", rows_per_class: int = ROWS_PER_CLASS, max_chars: int = MAX_CHARS) -> DataFrame:
    """Columns of `keep`, then `score`: a narrow transformation after the fit on the bounded sample."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(fitted(docs, labels, label, train, fit, rows_per_class, max_chars, key, text))

    def run(batches: Iterator[pa.RecordBatch], n: int, names: list[str]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for batch in (part for whole in batches for part in pieces(whole, n)):
            found = scorer(batch.column(n).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(np.asarray(found, np.float64))], names=names)

    return map_texts(docs, keep, text, [T.StructField("score", T.DoubleType())], run)
