"""Toxicity: a support vector machine on a gapped subsequence string kernel, with Nystrom landmarks.

The kernel compares words by their subsequences of three and four letters, each
weighed by ``DECAY`` per skipped letter, up to ``GAP`` skipped; so a word keeps
most of its likeness when letters are put in or left out.  It is divided by the
exact norms of both words, of whatever length.  Marks and digits between letters
don't count, and letters written as single words in a row ("i d i o t") are read
as one word.

Training is on sentences of labelled documents: an example is a sentence, as the
set of its words, and it is as toxic as its most toxic word.  A document's label
says only that some sentence of it is toxic, so witnesses are chosen in turns:
the words that score highest in each toxic document stand against words of clean
ones.  The landmarks are witnesses and clean words; the machine is a
squared-hinge support vector machine in the space that they span.  As the kernel
is a sum over subsequences, landmarks and weights fold into one weight per
subsequence, and a word's decision is the sum of the weights of its subsequences
by its norm.  A document scores by its two highest words, wherever they stand, and its number of
words, through a logistic curve.  An insult of several harmless words isn't seen.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kohesion.llm import _text
from kohesion.llm._store import save

DECAY = 0.9
GAP = 2
SLOT_BITS = 20
#: Labelled documents of each class that the machine is fitted on, at most about this many.
SAMPLE = {1: 2000, 0: 5000}
#: Characters of them, of each class, at most; so what a task fits on is bounded.
SAMPLE_CHARS = 32 << 20
LANDMARKS = 320
ROUNDS = 3
#: Words of clean documents that the machine is fitted against, and from how many the hardest are taken.
AGAINST = 6000
CLEAN_WORDS = 60_000
#: Witnesses stand in over this many times as large a share of toxic documents as of clean ones.
FAIR = 20.0
#: Log odds, and afterwards decision values, of words that are witnesses beside their document's highest.
SURE = (2.5, 0.5)
#: Letters whose subsequences are held at once.
PIECE = 1 << 16
#: Scores of word forms that a task remembers.
REMEMBERED = 1 << 20


def _letters() -> np.ndarray:
    """Letter classes by byte; 0 is no letter.  A continuation byte and its upper-case counterpart share a class."""
    kind = np.zeros(256, np.uint8)
    kind[0x61:0x7B] = kind[0x41:0x5B] = np.arange(1, 27)
    kind[0x80:0xC0] = 27 + np.arange(0x80, 0xC0) % 32
    return kind


_LETTER = _letters()
_SENTENCE_END = np.zeros(256, bool)
_SENTENCE_END[list(b".!?\n")] = True
#: Offsets of a subsequence's letters after its first.
PATTERNS = [c for p in (3, 4) for c in combinations(range(1, p + GAP), p - 1)]


def _skipped(pattern: tuple[int, ...]) -> int:
    return pattern[-1] - len(pattern)


@dataclass
class Letters:
    """The letters of some texts, by word.  ``sentence`` and ``doc`` are those of each word."""

    letter: np.ndarray
    word: np.ndarray
    sizes: np.ndarray
    sentence: np.ndarray
    doc: np.ndarray
    starts: np.ndarray


def find_letters(texts: list[str]) -> Letters:
    found = _text.find_words(texts, lower=True)
    owner = np.repeat(np.arange(len(found.starts)), found.ends - found.starts)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(found.ends - found.starts) - (found.ends - found.starts), found.ends - found.starts) + np.repeat(found.starts, found.ends - found.starts)
    codes = _LETTER[found.array[inside]]
    real = codes > 0
    sizes = np.bincount(owner[real], minlength=len(found.starts))
    # A sentence ends after a word whose last byte ends one, and with the text.
    after = np.zeros(len(found.starts), np.int64)
    after[1:] = _SENTENCE_END[found.array[found.ends[:-1] - 1]] | _SENTENCE_END[found.array[found.ends[:-1]]] | (np.diff(found.doc) != 0)
    sentence = np.cumsum(after)
    # Words of one letter in a row, inside a sentence, are one word.
    single = sizes == 1
    joined = np.zeros(len(sizes), bool)
    joined[1:] = single[1:] & single[:-1] & (after[1:] == 0)
    first = ~joined
    unit = np.cumsum(first) - 1
    return Letters(codes[real], unit[owner[real]], np.bincount(unit, weights=sizes, minlength=first.sum()).astype(np.int64), sentence[first], found.doc[first], found.starts[first])


_DECAYS = DECAY ** np.arange(GAP + 1)


def _slots(letter: np.ndarray, at: np.ndarray, pattern: tuple[int, ...]) -> np.ndarray:
    code = letter[at]
    for o in pattern:
        code = code * np.uint32(61) + letter[at + o]
    if len(pattern) == 2:
        code = code + np.uint32(0x5BD1E995)
    return (code * np.uint32(2_654_435_761)) >> np.uint32(32 - SLOT_BITS)


def subsequences(letter: np.ndarray, word: np.ndarray):
    """For each pattern: (word of each occurrence, slot of the subsequence, letters skipped); ``word`` is each letter's."""
    letter = letter.astype(np.uint32)
    for c in PATTERNS:
        n = len(letter) - c[-1]
        if n > 0:
            at = np.flatnonzero(word[:n] == word[c[-1] :])
            yield word[at], _slots(letter, at, c), _skipped(c)


def _pieces(sizes: np.ndarray):
    """(first word, word after the last) of runs of words with about ``PIECE`` letters; a longer word stands alone."""
    ends = np.cumsum(sizes)
    first = 0
    while first < len(sizes):
        before = ends[first] - sizes[first]
        after = max(int(np.searchsorted(ends, before + PIECE, side="right")), first + 1)
        yield first, after, int(before), int(ends[after - 1])
        first = after


def word_values(letter: np.ndarray, sizes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The sum of the weights of each word's subsequences, divided by the word's norm; words of under three letters have 0."""
    out = np.zeros(len(sizes))
    for first, after, a, z in _pieces(sizes):
        if z - a > PIECE:
            out[first] = _long_value(letter[a:z], weights)
            continue
        n = after - first
        word = np.repeat(np.arange(n), sizes[first:after])
        total, keys = np.zeros(n), []
        for own, slot, skipped in subsequences(letter[a:z], word):
            total += np.bincount(own, weights=weights[slot], minlength=n) * _DECAYS[skipped]
            keys.append(own << (SLOT_BITS + 2) | slot.astype(np.int64) << 2 | skipped)
        key = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
        if len(key):
            same = key >> 2
            new = np.flatnonzero(np.diff(same, prepend=-1))
            sums = np.add.reduceat(_DECAYS[key & 3], new)
            norm = np.sqrt(np.bincount(same[new] >> SLOT_BITS, weights=sums * sums, minlength=n))
            out[first:after] = np.divide(total, norm, out=np.zeros(n), where=norm > 0)
    return out


def _long_value(letter: np.ndarray, weights: np.ndarray) -> float:
    """The value of one word of any length, by the sums of all slots; the same as :func:`word_values` in bounded memory."""
    reach = max(c[-1] for c in PATTERNS)
    sums = np.zeros(1 << SLOT_BITS)
    for start in range(0, len(letter), PIECE):
        part = letter[start : start + PIECE + reach].astype(np.uint32)
        for c in PATTERNS:
            n = min(PIECE, len(part) - c[-1])
            if n > 0:
                sums += np.bincount(_slots(part, np.arange(n), c), minlength=len(sums)) * _DECAYS[_skipped(c)]
    norm = np.sqrt(sums @ sums)
    return float(sums @ weights / norm) if norm > 0 else 0.0


@dataclass
class ToxicityModel:
    weights: np.ndarray
    bias: float
    #: Of the logistic curve: constant, highest word, second highest, logarithm of the number of words.
    curve: np.ndarray


#: Where there is no word, and the least that counts: the machine's margin for clean words.
_NOTHING = -1.0


class Judge:
    """Decision values of words; those of forms seen before are remembered by their hash."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias
        self.known, self.value = np.zeros(0, np.uint64), np.zeros(0)

    def words(self, found: Letters) -> np.ndarray:
        begin = np.cumsum(found.sizes) - found.sizes
        out = np.zeros(len(found.sizes))
        long = np.flatnonzero(found.sizes >= 3)
        forms, first, own = np.unique(_text.segment_hashes(found.letter, begin[long], begin[long] + found.sizes[long]), return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, forms)
        old = np.zeros(len(forms), bool)
        inside = at < len(self.known)
        old[inside] = self.known[at[inside]] == forms[inside]
        value = np.empty(len(forms))
        value[old] = self.value[at[old]]
        new = long[first[~old]]
        value[~old] = word_values(_text.take_segments(found.letter, begin[new], found.sizes[new]), found.sizes[new], self.weights)
        if len(self.known) + len(new) > REMEMBERED:
            self.known, self.value = forms, value
        elif len(new):
            known, value_of = np.concatenate([self.known, forms[~old]]), np.concatenate([self.value, value[~old]])
            order = np.argsort(known)
            self.known, self.value = known[order], value_of[order]
        out[long] = value[own]
        return out + self.bias

    def documents(self, texts: list[str | None]) -> np.ndarray:
        """:func:`document_marks` of each text."""
        out = np.zeros((len(texts), 3))
        for first, part in _text.chunks(texts):
            found = find_letters(part)
            out[first : first + len(part)] = document_marks(found, self.words(found), len(part))
        return out


def document_marks(found: Letters, score: np.ndarray, n: int) -> np.ndarray:
    """The two highest word scores of each text, and the logarithm of its number of words.

    The highest is that of the most toxic sentence.  The highest of many words is
    higher, whatever they are, so the curve knows how many there were.
    """
    out = np.full((n, 3), _NOTHING)
    out[:, 2] = np.log1p(np.bincount(found.doc, minlength=n))
    # Scores below the least don't count, so few words are left to sort.
    some = np.flatnonzero(score > _NOTHING)
    top, doc = score[some], found.doc[some]
    order = np.lexsort((-top, doc))
    top, doc = top[order], doc[order]
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    out[doc[first], 0] = top[first]
    second = first + 1
    second = second[second < len(doc)]
    second = second[doc[second] == doc[second - 1]]
    out[doc[second], 1] = top[second]
    return out


def score(texts: list[str | None], model: ToxicityModel, judge: Judge | None = None) -> np.ndarray:
    judge = judge or Judge(model.weights, model.bias)
    z = model.curve[0] + judge.documents(texts) @ model.curve[1:]
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


# ---------------------------------------------------------------- training


def distinct_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, size, letters) of the distinct words of three letters and more of each text."""
    docs, sizes, letters = [], [], []
    for first, part in _text.chunks(texts):
        found = find_letters(part)
        begin = np.cumsum(found.sizes) - found.sizes
        long = np.flatnonzero(found.sizes >= 3)
        form = _text.segment_hashes(found.letter, begin[long], begin[long] + found.sizes[long])
        order = np.lexsort((form, found.doc[long]))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(form[order]) != 0) | (np.diff(found.doc[long[order]]) != 0)
        own = long[order[new]]
        docs.append(first + found.doc[own])
        sizes.append(found.sizes[own])
        letters.append(_text.take_segments(found.letter, begin[own], found.sizes[own]))
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *docs]), np.concatenate([empty, *sizes]), np.concatenate([np.zeros(0, np.uint8), *letters])


class Vocabulary:
    """The distinct words of the sample, and which documents (``doc``) hold which (``id``)."""

    def __init__(self, doc: np.ndarray, sizes: np.ndarray, letters: np.ndarray):
        begin = np.cumsum(sizes) - sizes
        _, first, self.id = np.unique(_text.segment_hashes(letters, begin, begin + sizes), return_index=True, return_inverse=True)
        self.doc = doc
        self.sizes = sizes[first]
        self.letter = _text.take_segments(letters, begin[first], self.sizes)
        self.begin = np.cumsum(self.sizes) - self.sizes

    def __len__(self) -> int:
        return len(self.sizes)

    def documents_of(self, use: np.ndarray) -> np.ndarray:
        """How many of the documents in the mask ``use`` hold each word."""
        return np.bincount(self.id[use[self.doc]], minlength=len(self))

    def features(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row in ``chosen``, slot, weight) of the subsequences of some words, divided by the norm."""
        sizes = self.sizes[chosen]
        letter, word = _text.take_segments(self.letter, self.begin[chosen], sizes), np.repeat(np.arange(len(chosen)), sizes)
        parts = [(own << SLOT_BITS | slot.astype(np.int64), np.full(len(own), _DECAYS[skipped])) for own, slot, skipped in subsequences(letter, word)]
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        key, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        value = np.bincount(at, weights=np.concatenate([p[1] for p in parts]))
        rows = key >> SLOT_BITS
        norm = np.sqrt(np.bincount(rows, weights=value * value, minlength=len(chosen)))
        return rows, key & (1 << SLOT_BITS) - 1, value / norm[rows]


def _initial(vocabulary: Vocabulary, toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """A first score of each word: the highest of its own log odds and those of its unbroken runs of four letters; ``toxic`` and ``clean`` are masks of documents."""
    odds_of = lambda pos, neg: np.log((pos + 0.5) / (toxic.sum() / clean.sum() * neg + 2.0))
    out = odds_of(vocabulary.documents_of(toxic), vocabulary.documents_of(clean))
    n = len(vocabulary.letter) - 3
    if n <= 0:
        return out
    letter, word = vocabulary.letter.astype(np.int64), np.repeat(np.arange(len(vocabulary)), vocabulary.sizes)
    at = np.flatnonzero(word[:n] == word[3:])
    code = ((letter[at] * 61 + letter[at + 1]) * 61 + letter[at + 2]) * 61 + letter[at + 3]
    code, own = np.unique(code, return_inverse=True)[1], word[at]
    # A run counts once for each word form of a document.
    size = code.max(initial=0) + 1
    pos, neg = (np.bincount(code, weights=vocabulary.documents_of(side)[own], minlength=size) for side in (toxic, clean))
    np.maximum.at(out, own, odds_of(pos, neg)[code])
    return out


def _project(vocabulary: Vocabulary, ids: np.ndarray, used: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The words' coordinates in the landmarks' space, some words at a time."""
    out = np.zeros((len(ids), basis.shape[1]), np.float32)
    for start in range(0, len(ids), 128):
        part = ids[start : start + 128]
        rows, slots, values = vocabulary.features(part)
        at = np.searchsorted(used, slots)
        known = (at < len(used)) & (used[np.minimum(at, len(used) - 1)] == slots)
        rows, at = rows[known], at[known]
        if len(rows):
            new = np.flatnonzero(np.diff(rows, prepend=-1))
            out[start + rows[new]] = np.add.reduceat(basis[at] * values[known, None].astype(np.float32), new, axis=0)
    return out


def _squared_hinge(z: np.ndarray, y: np.ndarray, weight: np.ndarray, decay: float) -> np.ndarray:
    """Newton's method on the active rows; the last weight is the bias and isn't shrunk."""
    z = np.concatenate([z, np.ones((len(z), 1), z.dtype)], axis=1)
    shrink = np.full(z.shape[1], decay)
    shrink[-1] = 1e-9
    w = np.zeros(z.shape[1])
    for _ in range(30):
        active = y * (z @ w) < 1
        za, wa = z[active], weight[active]
        new = np.linalg.solve((za.T * wa) @ za + np.diag(shrink), (za.T * wa) @ y[active])
        if np.abs(new - w).max() < 1e-7:
            break
        w = new
    return w


def _witnesses(vocabulary: Vocabulary, value: np.ndarray, docs: np.ndarray, sure: float, most: int = 5) -> np.ndarray:
    """The ids of the highest word of each document in ``docs`` and of its next ones up to ``most`` with a value over ``sure``, as often as they are chosen."""
    keep = docs[vocabulary.doc]
    doc, word = vocabulary.doc[keep], vocabulary.id[keep]
    order = np.lexsort((word, -value[word], doc))
    doc, word = doc[order], word[order]
    new = np.flatnonzero(np.diff(doc, prepend=-1))
    rank = np.arange(len(doc)) - np.repeat(new, np.diff(np.append(new, len(doc))))
    return word[(rank == 0) | ((rank < most) & (value[word] > sure))]


def train(texts: list[str | None], toxic: np.ndarray, prior: float, seed: int = 7) -> ToxicityModel:
    """Fits the machine on documents and their labels; ``prior`` is the share of toxic ones where it will be used."""
    toxic = np.asarray(toxic, np.int64)
    machines = _machines(Vocabulary(*distinct_words(texts)), toxic, seed)
    return _model(machines, toxic, prior, lambda some: [Judge(*m).documents(texts) for m in some])


def _machines(vocabulary: Vocabulary, toxic: np.ndarray, seed: int = 7) -> list[tuple[np.ndarray, float]]:
    """The machine of all documents, and for the even and for the odd ones a machine of the others; none without two classes or words."""
    machine = _machine(vocabulary, toxic, np.ones(len(toxic), bool), seed)
    if machine is None:
        return []
    half = np.arange(len(toxic)) % 2
    return [machine, *[_machine(vocabulary, toxic, half != side, seed + 1 + side) or machine for side in (0, 1)]]


def _model(machines: list[tuple[np.ndarray, float]], toxic: np.ndarray, prior: float, judge) -> ToxicityModel:
    """The curve is fitted on decisions about documents that the machine hasn't seen: each half of the sample is judged by a machine of the other half.

    ``judge`` gives the marks of all documents by each of some machines.
    """
    if not machines:
        return ToxicityModel(np.zeros(1 << SLOT_BITS, np.float32), 0.0, np.array([np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)), 0, 0, 0]))
    half = np.arange(len(toxic)) % 2
    first, second = judge(machines[1:])
    return ToxicityModel(*machines[0], _fit_curve(np.where((half == 0)[:, None], first, second), toxic, prior))


def _machine(vocabulary: Vocabulary, label: np.ndarray, use: np.ndarray, seed: int) -> tuple[np.ndarray, float] | None:
    """(weights, bias) from the documents in the mask ``use``, or None without two classes or words."""
    toxic, clean = use & (label == 1), use & (label == 0)
    if not toxic.any() or not clean.any() or not len(vocabulary):
        return None
    rng = np.random.default_rng(seed)
    value = _initial(vocabulary, toxic, clean)
    in_toxic, in_clean = (vocabulary.documents_of(side) for side in (toxic, clean))
    # Words that clean documents hold nearly as often are no witnesses.
    fair = in_toxic / toxic.sum() > FAIR * in_clean / clean.sum()
    clean_words = np.flatnonzero((in_clean > 0) & ~fair)
    if not len(clean_words):
        return None
    if len(clean_words) > CLEAN_WORDS:
        clean_words = np.sort(rng.choice(clean_words, CLEAN_WORDS, replace=False))
    judged = np.union1d(clean_words, np.flatnonzero(in_toxic))
    # First log odds, then the machine's values.
    weights, bias, sure = None, 0.0, SURE[0]
    # A word of one document may be there by a wrong label; it needs likeness to others.
    several = in_toxic > 1
    for _ in range(ROUNDS):
        chosen, times = np.unique(_witnesses(vocabulary, value, toxic, sure), return_counts=True)
        taken = fair[chosen] & (several[chosen] | (value[chosen] > sure))
        if not taken.any():
            taken = fair[chosen]
        chosen, times = chosen[taken], times[taken]
        if not len(chosen):
            break
        hard = clean_words[np.argsort(-value[clean_words], kind="stable")[: AGAINST // 2]]
        plain = rng.choice(clean_words, min(AGAINST // 2, len(clean_words)), replace=False)
        against = np.union1d(hard, plain)
        marks = chosen[np.argsort(-times, kind="stable")[: LANDMARKS // 2]]
        rest = np.setdiff1d(chosen, marks)
        marks = np.concatenate([marks, rng.choice(rest, min(LANDMARKS // 4, len(rest)), replace=False), rng.choice(hard, min(LANDMARKS - LANDMARKS * 3 // 4, len(hard)), replace=False)])
        marks = np.unique(marks)
        rows, slots, values = vocabulary.features(marks)
        used, column = np.unique(slots, return_inverse=True)
        phi = np.zeros((len(marks), len(used)), np.float32)
        np.add.at(phi, (rows, column), values)
        spectrum, basis = np.linalg.eigh((phi @ phi.T).astype(float))
        ok = spectrum > 1e-5 * spectrum.max()
        root = (basis[:, ok] / np.sqrt(spectrum[ok])).astype(np.float32)
        own = phi.T @ root
        z = np.concatenate([_project(vocabulary, chosen, used, own), _project(vocabulary, against, used, own)])
        y = np.concatenate([np.ones(len(chosen)), -np.ones(len(against))])
        weight = np.concatenate([np.sqrt(times) / np.sqrt(times).sum(), np.full(len(against), 2.0 / len(against))])
        w = _squared_hinge(z, y, weight, 1e-3)
        weights = np.zeros(1 << SLOT_BITS)
        weights[used] = phi.T @ (root @ w[:-1])
        bias = float(w[-1])
        sizes = vocabulary.sizes[judged]
        value = np.full(len(vocabulary), _NOTHING)
        value[judged] = word_values(_text.take_segments(vocabulary.letter, vocabulary.begin[judged], sizes), sizes, weights) + bias
        sure = SURE[1]
        # The next round's arrays take the place of these.
        del phi, own, z, rows, slots, values
        _text.give_back()
    return None if weights is None else (weights.astype(np.float32), bias)


def _fit_curve(top: np.ndarray, toxic: np.ndarray, prior: float) -> np.ndarray:
    """Logistic regression on the marks of documents, with classes weighed to ``prior``; a higher word never makes a document cleaner."""
    x = np.concatenate([np.ones((len(top), 1)), top], axis=1)
    weight = np.where(toxic == 1, prior / max((toxic == 1).sum(), 1), (1 - prior) / max((toxic == 0).sum(), 1))
    w, use = np.zeros(x.shape[1]), np.ones(x.shape[1], bool)
    while True:
        w[use] = _logistic(x[:, use], toxic, weight)
        w[~use] = 0.0
        wrong = (w < 0) & (np.arange(len(w)) % 3 > 0)
        if not wrong.any():
            return w
        use &= ~wrong


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x.T * (weight * p * (1 - p))) @ x + 1e-4 * np.eye(x.shape[1])
        step = np.linalg.solve(hessian, x.T @ (weight * (p - y)) + 1e-4 * w)
        w -= step / max(1.0, np.abs(step).max() / 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


# ---------------------------------------------------------------- tables


def held_out(doc_id: str, folds: int = 5):
    """Whether a row is kept from training: its id's CRC-32, as text, is divisible by ``folds``."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == 0, F.lit(False))


def _sample(docs: DataFrame, taken: DataFrame, chars: int) -> DataFrame:
    """(id, y, text) of the taken labelled rows, by a hash of the id until ``chars`` characters of a class are reached."""
    # At most about as many ids and labels as the sample asks for.
    chosen = F.broadcast(taken.groupBy("id").agg(F.max("y").alias("y")))
    # Rows that repeat an id are one, by partial aggregation.
    own = docs.join(chosen, "id").groupBy("id", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    held = save(own, "toxicity-sample")
    order = Window.partitionBy("y").orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, 0)
    within = held.select("id", "y", F.sum(F.length("text").cast("long")).over(order).alias("sum")).filter(F.col("sum") <= chars).select("id")
    return held.join(F.broadcast(within), "id")


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, sample: dict[int, int] | None = None, folds: int = 5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", chars: int = SAMPLE_CHARS
) -> ToxicityModel:
    """Fits on at most about ``sample`` labelled rows of each class that are not held out, taken by a hash of the id, and ``chars`` characters of each.

    Rows without an id or label aren't used; of rows that repeat an id one is.
    The share of toxic rows comes from all labels that may be used.  Texts of the
    sample and their words stay on the executors, where one task fits the machines.
    """
    sample = SAMPLE if sample is None else sample
    usable = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).filter(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out("id", folds))
    counts = {r["y"]: r["count"] for r in usable.groupBy("y").count().collect()}
    if not counts.get(0) or not counts.get(1):
        prior = counts.get(1, 0) / max(sum(counts.values()), 1)
        return train([], np.zeros(0), prior)
    grain = 1 << 30
    share = {y: min(1.0, sample[y] / counts[y]) for y in (0, 1)}
    taken = usable.filter(F.pmod(F.xxhash64("id"), F.lit(grain)) < F.when(F.col("y") == 1, F.lit(int(share[1] * grain) + 1)).otherwise(F.lit(int(share[0] * grain) + 1)))
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = save(_sample(own, taken, chars), "toxicity-texts")

    def words(batches):
        for batch in _text.pieces(batches):
            doc, sizes, letters = distinct_words(batch.column(1).to_pylist())
            bounds = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            ends = np.concatenate([[0], np.cumsum(sizes)])[bounds]
            lists = pa.ListArray.from_arrays(bounds.astype(np.int32), pa.array(sizes.astype(np.int32)))
            raw = pa.array([letters[a:z].tobytes() for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), lists, raw], ["id", "y", "sizes", "letters"])

    def fit(batches):
        # Of at most sample rows and chars characters.
        some = [b for b in batches if b.num_rows]
        if not some:
            return
        known = pa.Table.from_batches(some).sort_by("id").combine_chunks()
        sizes = known.column("sizes").combine_chunks()
        doc = np.repeat(np.arange(known.num_rows), np.diff(np.asarray(sizes.offsets)))
        vocabulary = Vocabulary(doc, np.asarray(sizes.flatten()).astype(np.int64), np.frombuffer(b"".join(known.column("letters").to_pylist()), np.uint8))
        for place, (weights, bias) in enumerate(_machines(vocabulary, known.column("y").to_numpy().astype(np.int64))):
            yield pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.array([weights.tobytes()], pa.binary()), pa.array([bias])], ["place", "weights", "bias"])

    # One task has the whole vocabulary; only the machines come to the driver.
    known = rows.select("id", "text", "y").mapInArrow(words, "id long, y int, sizes array<int>, letters binary").repartition(1)
    found = known.mapInArrow(fit, "place int, weights binary, bias double").toArrow().sort_by("place").to_pylist()
    machines = [(np.frombuffer(m["weights"], np.float32), m["bias"]) for m in found]
    marked = rows.select("id", "y").toArrow().sort_by("id")
    toxic = marked.column("y").to_numpy().astype(np.int64)

    def judge(machines):
        sent = docs.sparkSession.sparkContext.broadcast(machines)

        def run(batches):
            judges = [Judge(*m) for m in sent.value]
            for batch in _text.pieces(batches):
                tops = np.concatenate([j.documents(batch.column(1).to_pylist()) for j in judges], axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(tops[:, i]) for i in range(6)]], ["id", *"abcdef"])

        found = rows.select("id", "text").mapInArrow(run, "id long, " + ", ".join(f"{c} double" for c in "abcdef")).toArrow().sort_by("id")
        top = np.stack([found.column(c).to_numpy() for c in "abcdef"], axis=1)
        return top[:, :3], top[:, 3:]

    return _model(machines, toxic, counts[1] / (counts[0] + counts[1]), judge)


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) per row, from the text alone.

    Null texts count as empty and get the curve's lowest score; null ids stay
    null; repeated rows are scored each; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        judge = Judge(sent.value.weights, sent.value.bias)
        for batch in _text.pieces(batches):
            marks = score(batch.column(1).to_pylist(), sent.value, judge)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks), pa.array((marks >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, score double, predicted int")
