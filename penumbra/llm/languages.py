"""Operator 3: language identification by error-correcting output codes.

Every language has a codeword; its bits grow with the number of languages. For
each bit, a binary logistic classifier over hashed byte n-grams of words
predicts the bit. The margins of a text are decoded by loss: the codeword with
the least logistic loss wins, each bit weighted by how well its classifier does
on a fifth of the sample that it isn't fitted on. Texts whose two best codewords
lie within ``ambiguity`` of each other's loss are flagged.

The classifiers are fitted in one task on a bounded sample of labelled rows
(``samples.labelled_sample``; the bound is its parameter). Rows are predicted in slices of
bounded text, a distinct word is scored once a slice, and nothing is shuffled.

Null texts and texts without a letter get ``und`` and score 0. A text of an
unlabelled language gets the nearest learned one; of equally near languages the
first by name. Fitting without any labelled row predicts ``und`` everywhere.
Rows are predicted one by one: repeated rows get the same, long texts are read
whole, and other columns stay. An empty table gives no rows.
"""

from __future__ import annotations

from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from penumbra.llm.carry import with_text_columns
from penumbra.llm.ngrams import hashed_ngrams
from penumbra.llm.words import LOWER, Words, split_words

SIZES, BUCKETS = (1, 2, 3, 4), 1 << 15
SLICE_BYTES = 12 << 20
UNDETERMINED = "und"
#: Lower-cases A-Z; ASCII characters that are no letters separate words.
_LETTERS = bytes(LOWER[b] if b >= 128 or chr(b).isalpha() else 32 for b in range(256))

ADDED = "lang_pred string, score double, ambiguous boolean, margins array<float>"


class Model(NamedTuple):
    """Codewords of +1 and -1 (languages by bits) and a weight for each n-gram bucket and bit."""

    languages: list[str]
    codewords: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    loss_weights: np.ndarray
    ambiguity: float


def codewords(n: int, n_bits: int, seed: int = 7) -> np.ndarray:
    """``n`` codewords of -1 and 1 with a large least distance; no bit is the same in all.

    Codewords are drawn one by one, each the candidate that lies farthest from
    those drawn before.
    """
    rng = np.random.default_rng(seed)
    words = np.where(rng.random((1, n_bits)) < 0.5, -1, 1)
    drawn = min(2000, 1 + 200_000 // n)
    while len(words) < n:
        candidates = np.where(rng.random((drawn, n_bits)) < 0.5, -1, 1)
        distance = (n_bits - candidates @ words.T) / 2
        words = np.vstack([words, candidates[np.argmax(np.minimum(distance, n_bits - distance).min(1) + distance.min(1))]])
    same = np.abs(words.sum(0)) == n
    if n > 1:
        words[0, same] *= -1
    return words.astype(np.float32)


def _features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of each distinct word, one word after the other, and where each word begins."""
    parts = [(bucket[inside], np.repeat(np.arange(len(first)), np.diff(np.append(first, len(bucket))))[inside]) for bucket, inside, first in hashed_ngrams(words.vocab, SIZES, BUCKETS)]
    if not parts:
        return np.zeros(0, np.int32), np.zeros(1, np.int64)
    bucket, word = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(word, kind="stable")
    return bucket[order], np.searchsorted(word[order], np.arange(len(words.vocab) + 1))


def fit(texts: list[str], languages: list[str], n_bits: int | None = None, epochs: int = 12, rate: float = 0.5, ambiguity: float = 0.5, seed: int = 7) -> Model:
    """Logistic regression for every bit, by adaptive gradient steps on mini-batches of documents.

    ``n_bits`` is four times the bits that number the languages, at least 15,
    unless given.
    """
    known = sorted(set(languages))
    n_bits = n_bits or max(15, 4 * len(known).bit_length())
    code = codewords(max(1, len(known)), n_bits, seed)
    weights, bias = np.zeros((BUCKETS, n_bits), np.float32), np.zeros(n_bits, np.float32)
    if not known:
        return Model([], code[:0], weights, bias, np.ones(n_bits), ambiguity)
    words = split_words(pa.array(texts, pa.string()), _LETTERS)
    bucket, starts = _features(words)
    sizes, rows = np.diff(starts), []
    for a, b in zip(words.offsets[:-1], words.offsets[1:], strict=True):
        w = words.codes[a:b]
        n = sizes[w]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[w], n)
        ids, count = np.unique(bucket[at], return_counts=True)
        rows.append((ids, (count / max(1, count.sum())).astype(np.float32)))
    target = code[np.searchsorted(known, languages)]
    rng, squares = np.random.default_rng(seed), np.full((BUCKETS, n_bits), 1e-6, np.float32)
    usable = rng.permutation([d for d, (ids, _) in enumerate(rows) if len(ids)]).astype(np.int64)
    tested, usable = usable[: len(usable) // 5], usable[len(usable) // 5 :]
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(usable), max(1, len(usable) // 64)):
            if not len(batch):
                continue
            ids = np.concatenate([rows[d][0] for d in batch])
            share = np.concatenate([rows[d][1] for d in batch])
            first = np.cumsum([0] + [len(rows[d][0]) for d in batch])
            margin = SCALE * np.add.reduceat(weights[ids] * share[:, None], first[:-1], axis=0) + bias
            slope = -target[batch] / (1 + np.exp(np.clip(target[batch] * margin, -30, 30))) / len(batch)
            change = np.zeros_like(weights)
            np.add.at(change, ids, SCALE * np.repeat(slope, np.diff(first), axis=0) * share[:, None])
            squares += change**2
            weights -= rate * change / np.sqrt(squares)
            bias -= 0.1 * slope.sum(0)
    weights[0] = 0
    right = np.zeros(n_bits)
    for d in tested:
        ids, share = rows[d]
        right += (SCALE * (weights[ids] * share[:, None]).sum(0) + bias) * target[d] > 0
    odds = np.log((right + 1) / (len(tested) - right + 1))  # of a bit that is told right
    odds = np.maximum(odds, 0.05)
    return Model(known, code, weights, bias, odds / odds.mean(), ambiguity)


#: Margins are the mean n-gram weight times this.
SCALE = 8.0


def decode(margins: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the nearest codeword, its share (0 to 1) against the others, and whether the second is close."""
    loss = np.zeros((len(margins), len(model.codewords)))
    for b, weight in enumerate(model.loss_weights):
        loss += weight * np.logaddexp(0, -margins[:, b, None] * model.codewords[None, :, b])
    best = loss.argmin(1)
    share = np.exp(loss.min(1, keepdims=True) - loss)
    ordered = np.sort(loss, axis=1)
    close = ordered[:, 1] - ordered[:, 0] < model.ambiguity if loss.shape[1] > 1 else np.zeros(len(loss), bool)
    return best, 1 / share.sum(1), close


def predict_texts(texts: pa.Array, model) -> dict[str, pa.Array]:
    """The columns of ``ADDED``; ``model`` is a broadcast Model."""
    model = model.value
    words = split_words(texts, _LETTERS)
    n_bits = model.weights.shape[1]
    total, count = np.zeros((len(words.vocab), n_bits), np.float32), np.zeros(len(words.vocab), np.int64)
    for bucket, inside, first in hashed_ngrams(words.vocab, SIZES, BUCKETS):
        total += np.add.reduceat(model.weights[bucket], first, axis=0)
        count += np.add.reduceat(inside.astype(np.int64), first)
    margins, filled = np.zeros((len(texts), n_bits), np.float32), np.diff(words.offsets) > 0
    if filled.any():
        first = words.offsets[:-1][filled]
        n = np.add.reduceat(count[words.codes], first)
        margins[filled] = SCALE * np.add.reduceat(total[words.codes], first, axis=0) / n[:, None]
    margins += model.bias
    letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    determined = letters & bool(model.languages)
    names, scores, close = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts)), np.zeros(len(texts), bool)
    if determined.any():
        best, share, near = decode(margins[determined], model)
        names[determined], scores[determined], close[determined] = np.array(model.languages, object)[best], share, near
    return {
        "lang_pred": pa.array(names, pa.string()),
        "score": pa.array(scores, pa.float64()),
        "ambiguous": pa.array(close),
        "margins": pa.array(list(margins), pa.list_(pa.float32())),
    }


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with lang_pred, score, ambiguous and margins, which replace columns of those names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return with_text_columns(docs, text_col, ADDED, partial(predict_texts, model=shared), SLICE_BYTES)
