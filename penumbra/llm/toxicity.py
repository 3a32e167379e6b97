"""Operator 9: toxicity by a bidirectional gated recurrent network, in numpy.

A text's words are cut into overlapping windows. Each word enters the network
by a word vector (hashed) and by the sum of the vectors of its character
n-grams (hashed). A forward and a backward gated recurrent layer read the
window, attention pools their states, and a logistic unit scores the pool. A
text's score is that of its worst window; all windows are scored.

Training is by gradients through time on the worst window of each text of a
mini-batch (Adam). The first coordinate of each vector starts from the
difference of its n-gram's share among toxic and other texts of the sample, in
standard errors; others start at small random values, and at zero for buckets
that the sample lacks. The sample is bounded (``samples.labelled_sample``) and
fitted in one task.

Null, empty and wordless texts have one empty window and so the network's base
score. Without labelled rows of both classes every score is the base 0. Rows are
scored one by one: repeated rows get the same, and long texts are scored whole.
All other columns stay; the score replaces a column of its name. An empty table
gives no rows.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from penumbra.llm.carry import with_text_columns
from penumbra.llm.ngrams import hashed_ngrams
from penumbra.llm.words import LOWER, Words, split_words

WINDOW, STRIDE = 64, 48
SIZES, CHAR_BUCKETS, WORD_BUCKETS = (3, 4, 5), 1 << 16, 1 << 14
CHAR_DIM, WORD_DIM, HIDDEN, ATTENTION = 12, 4, 8, 8
SLICE_BYTES, BATCH = 8 << 20, 4096
#: Lower-cases A-Z; ASCII characters that are neither letters nor digits separate words.
_TABLE = bytes(LOWER[b] if b >= 128 or chr(b).isalnum() else 32 for b in range(256))

Parameters = dict[str, np.ndarray]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def windows(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, number of words) of all windows.

    Windows of ``WINDOW`` words begin every ``STRIDE`` words; the last one ends
    with the text. A shorter text has one window.
    """
    sizes = np.diff(offsets)
    count = np.where(sizes <= WINDOW, 1, 1 + -(-(sizes - WINDOW) // STRIDE))
    doc = np.repeat(np.arange(len(sizes)), count)
    number = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = np.minimum(number * STRIDE, np.maximum(sizes[doc] - WINDOW, 0))
    return doc, offsets[:-1][doc] + start, np.minimum(sizes[doc], WINDOW)


class Lexicon:
    """The distinct words of some texts by their hashed parts."""

    def __init__(self, words: Words):
        self.size = len(words.vocab)
        grams = list(hashed_ngrams(words.vocab, (*SIZES, 12), CHAR_BUCKETS))
        self.grams = [(bucket, first) for bucket, _, first in grams[:-1]]
        self.count = sum(np.add.reduceat(inside.astype(np.float32), first) for _, inside, first in grams[:-1]) if grams else np.zeros(0, np.float32)
        self.scale = (1 / np.sqrt(np.maximum(self.count, 1))).astype(np.float32)[:, None]
        self.word = self._whole(words.vocab)

    @staticmethod
    def _whole(vocab: pa.Array) -> np.ndarray:
        """A bucket for each whole word, from sums of its 1-grams and 2-grams that depend on place."""
        if not len(vocab):
            return np.zeros(0, np.int64)
        total = np.zeros(len(vocab), np.uint64)
        for size, (bucket, _, first) in zip((1, 2, 3), hashed_ngrams(vocab, (1, 2, 3), 1 << 30), strict=True):
            place = np.arange(len(bucket)) - np.repeat(first, np.diff(np.append(first, len(bucket))))
            mixed = (bucket.astype(np.uint64) + np.uint64(1)) * (2 * place.astype(np.uint64) + np.uint64(2 * size + 1)) * np.uint64(0x9E3779B97F4A7C15)
            total += np.add.reduceat(mixed ^ (mixed >> np.uint64(31)), first)
        return (1 + (total >> np.uint64(20)) % np.uint64(WORD_BUCKETS - 1)).astype(np.int64)

    def vectors(self, p: Parameters) -> np.ndarray:
        """The network's input for each distinct word, and zeros for padding after the last."""
        out = np.zeros((self.size + 1, WORD_DIM + CHAR_DIM), np.float32)
        if self.size:
            out[:-1, :WORD_DIM] = p["word"][self.word]
            for bucket, first in self.grams:
                out[:-1, WORD_DIM:] += np.add.reduceat(p["char"][bucket], first, axis=0)
            out[:-1, WORD_DIM:] *= self.scale
        return out


def fresh_parameters(seed: int) -> Parameters:
    rng = np.random.default_rng(seed)
    inputs = WORD_DIM + CHAR_DIM

    def normal(*shape):
        return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

    p = {"word": np.zeros((WORD_BUCKETS, WORD_DIM), np.float32), "char": np.zeros((CHAR_BUCKETS, CHAR_DIM), np.float32)}
    for d in "fb":
        p |= {f"x{d}": normal(inputs, 3 * HIDDEN), f"h{d}": normal(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
    return p | {"a": normal(2 * HIDDEN, ATTENTION), "v": normal(ATTENTION), "o": normal(2 * HIDDEN), "base": np.full(1, -2, np.float32)}


def _layer(p: Parameters, d: str, projected: np.ndarray, codes: np.ndarray, mask: np.ndarray | None, keep: list | None) -> np.ndarray:
    """States of one direction, (time, windows, HIDDEN). ``projected`` holds each word's input to the gates."""
    n, steps = codes.shape
    h, states, wh = np.zeros((n, HIDDEN), np.float32), np.empty((steps, n, HIDDEN), np.float32), p[f"h{d}"]
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        x, y = projected[codes[:, t]], h @ wh
        gates = 1 / (1 + np.exp(-(x[:, : 2 * HIDDEN] + y[:, : 2 * HIDDEN])))
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        new = np.tanh(x[:, 2 * HIDDEN :] + r * y[:, 2 * HIDDEN :])
        before, h = h, new + z * (h - new)
        if mask is not None:
            h = np.where(mask[:, t, None], h, before)
        if keep is not None:
            keep.append((t, before, y, z, r, new))
        states[t] = h
    return states


def forward(p: Parameters, vectors: np.ndarray, codes: np.ndarray, mask: np.ndarray | None, keep: dict | None = None) -> np.ndarray:
    """The logit of each window; ``codes`` are rows of ``vectors``, windows by words."""
    states = []
    for d in "fb":
        projected = vectors @ p[f"x{d}"] + p[f"c{d}"]
        kept = [] if keep is not None else None
        states.append(_layer(p, d, projected, codes, mask, kept))
        if keep is not None:
            keep[d] = kept
    h = np.concatenate(states, axis=2)
    u = np.tanh(h @ p["a"])
    s = u @ p["v"]
    if mask is not None:
        s = np.where(mask.T, s, np.float32(-1e4))
    weight = np.exp(s - s.max(0))
    weight /= weight.sum(0)
    if mask is not None:
        weight = weight * mask.any(1)
    pooled = np.einsum("tn,tnh->nh", weight, h, optimize=False)
    if keep is not None:
        keep |= {"h": h, "u": u, "weight": weight, "pooled": pooled}
    return pooled @ p["o"] + p["base"]


def backward(p: Parameters, vectors: np.ndarray, codes: np.ndarray, mask: np.ndarray | None, keep: dict, slope: np.ndarray) -> tuple[Parameters, np.ndarray]:
    """Gradients of the parameters but the embeddings, and of ``vectors``."""
    g: Parameters = {"o": keep["pooled"].T @ slope, "base": slope.sum(keepdims=True)}
    pool = slope[:, None] * p["o"]
    h, u, weight = keep["h"], keep["u"], keep["weight"]
    dh = weight[:, :, None] * pool
    dw = np.einsum("tnh,nh->tn", h, pool)
    ds = weight * (dw - (weight * dw).sum(0))
    g["v"] = np.einsum("tna,tn->a", u, ds)
    du = ds[:, :, None] * p["v"] * (1 - u**2)
    g["a"] = np.einsum("tnh,tna->ha", h, du)
    dh += du @ p["a"].T
    dvectors = np.zeros_like(vectors)
    for k, d in enumerate("fb"):
        wh, carry, dwh = p[f"h{d}"], np.zeros((codes.shape[0], HIDDEN), np.float32), np.zeros_like(p[f"h{d}"])
        dgates = np.zeros((codes.shape[0], codes.shape[1], 3 * HIDDEN), np.float32)
        for t, before, y, z, r, new in reversed(keep[d]):
            whole = dh[t, :, k * HIDDEN : (k + 1) * HIDDEN] + carry
            live = whole if mask is None else whole * mask[:, t, None]
            dnew = live * (1 - z) * (1 - new**2)
            dz = live * (before - new) * z * (1 - z)
            dr = dnew * y[:, 2 * HIDDEN :] * r * (1 - r)
            dy = np.concatenate([dz, dr, dnew * r], axis=1)
            dwh += before.T @ dy
            carry = live * z + dy @ wh.T + (0 if mask is None else whole - live)
            dgates[:, t] = np.concatenate([dz, dr, dnew], axis=1)
        flat = dgates.reshape(-1, 3 * HIDDEN)
        dprojected = np.zeros((len(vectors), 3 * HIDDEN), np.float32)
        np.add.at(dprojected, codes.ravel(), flat)
        g |= {f"h{d}": dwh, f"c{d}": flat.sum(0), f"x{d}": vectors.T @ dprojected}
        dvectors += dprojected @ p[f"x{d}"].T
    return g, dvectors


def window_codes(codes: np.ndarray, first: np.ndarray, count: np.ndarray, padding: int) -> tuple[np.ndarray, np.ndarray | None]:
    """Word codes of windows, padded to the longest, and the mask of real words if any is shorter."""
    steps = max(1, int(count.max(initial=1)))
    at = first[:, None] + np.arange(steps)
    mask = np.arange(steps) < count[:, None]
    if mask.all():
        return codes[at], None
    padded = np.append(codes, padding)
    return np.where(mask, padded[np.minimum(at, len(codes))], padding), mask


def logits(p: Parameters, vectors: np.ndarray, codes: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The logits of many windows, a batch at a time, those of like length together."""
    out, order = np.empty(len(first), np.float32), np.argsort(count, kind="stable")
    for i in range(0, len(order), BATCH):
        part = order[i : i + BATCH]
        out[part] = forward(p, vectors, *window_codes(codes, first[part], count[part], len(vectors) - 1))
    return out


def _seen_by_class(words: Words, toxic: np.ndarray, parts: list, buckets: int, docs_at_a_time: int = 64) -> np.ndarray:
    """How many texts of each class hold each bucket, counted a few texts at a time."""
    seen = np.zeros((2, buckets))
    for d in range(0, len(toxic), docs_at_a_time):
        some = words.offsets[d : d + docs_at_a_time + 1]
        doc = np.repeat(np.arange(len(some) - 1), np.diff(some))
        pairs = np.unique(doc * (len(words.vocab) + 1) + words.codes[some[0] : some[-1]])
        doc, word = pairs // (len(words.vocab) + 1), pairs % (len(words.vocab) + 1)
        held = np.zeros((len(some) - 1, buckets), bool)
        for bucket, first in parts:
            sizes = np.diff(np.append(first, len(bucket)))[word]
            at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first[word], sizes)
            held[np.repeat(doc, sizes), bucket[at]] = True
        label = toxic[d : d + docs_at_a_time]
        seen += np.stack([held[~label].sum(0), held[label].sum(0)])
    return seen


def _start_vectors(p: Parameters, lexicon: Lexicon, words: Words, toxic: np.ndarray, rng) -> None:
    """Set the vectors of what the sample holds."""
    n = np.array([(~toxic).sum(), toxic.sum()])
    for name, buckets, parts in (("word", WORD_BUCKETS, [(lexicon.word, np.arange(lexicon.size))]), ("char", CHAR_BUCKETS, lexicon.grams)):
        seen = _seen_by_class(words, toxic, parts, buckets)
        share, mean = seen / n[:, None], seen.sum(0) / n.sum()
        error = np.sqrt(np.maximum(mean * (1 - mean), 1e-9) * (1 / n).sum())
        z = (share[1] - share[0]) / error
        p[name][:] = 0.02 * rng.standard_normal(p[name].shape) * (mean > 0)[:, None]
        p[name][:, 0] = np.sign(z) * np.clip((np.abs(z) - 3) / 4, 0, 2)
        p[name][0] = 0


def fit(texts: list[str], toxic: list, epochs: int = 4, least_steps: int = 240, rate: float = 0.01, docs_a_step: int = 64, seed: int = 5) -> Parameters | None:
    """Train the network on whole texts, toxic where the label is 1; None if either class is missing."""
    label, rng = np.array([x == 1 for x in toxic], bool), np.random.default_rng(seed)
    if not label.any() or label.all():
        return None
    p, words = fresh_parameters(seed), split_words(pa.array(texts, pa.string()), _TABLE)
    lexicon = Lexicon(words)
    _start_vectors(p, lexicon, words, label, rng)
    doc, first, count = windows(words.offsets)
    begin = np.searchsorted(doc, np.arange(len(texts) + 1))
    first_moment, second = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    in_epoch = len(texts) // docs_a_step + 1
    epochs = max(epochs, -(-least_steps // in_epoch))
    step, steps = 0, epochs * in_epoch
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(len(texts)), in_epoch):
            if not len(batch):
                continue
            step += 1
            mine = np.concatenate([np.arange(begin[d], begin[d + 1]) for d in batch])
            vectors = lexicon.vectors(p) if step % 8 == 1 else vectors  # refreshed now and then to find the worst windows
            score = logits(p, vectors, words.codes, first[mine], count[mine])
            edge = np.cumsum([0] + [begin[d + 1] - begin[d] for d in batch])
            worst = np.array([mine[a + score[a:b].argmax()] for a, b in zip(edge[:-1], edge[1:], strict=True)])
            codes, mask = window_codes(words.codes, first[worst], count[worst], lexicon.size)
            used, local = np.unique(codes, return_inverse=True)
            own, grams = _vectors_of(p, lexicon, used)
            keep: dict = {}
            out = forward(p, own, local.reshape(codes.shape), mask, keep)
            slope = ((sigmoid(out) - label[batch]) / len(batch)).astype(np.float32)
            g, dvectors = backward(p, own, local.reshape(codes.shape), mask, keep, slope)
            g["word"], g["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
            real = used < lexicon.size
            np.add.at(g["word"], lexicon.word[used[real]], dvectors[real, :WORD_DIM])
            for owner, bucket in grams:
                np.add.at(g["char"], bucket, (dvectors[:, WORD_DIM:][owner]) * lexicon.scale[used[owner]])
            g["word"][0] = g["char"][0] = 0
            norm = np.sqrt(sum(float((x**2).sum()) for x in g.values()))
            pace = rate * (1 - 0.9 * step / steps) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, x in g.items():
                x = x * min(1, 1 / max(norm, 1e-9))
                first_moment[k] += 0.1 * (x - first_moment[k])
                second[k] += 0.001 * (x**2 - second[k])
                p[k] -= (pace * first_moment[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
    return p


def _vectors_of(p: Parameters, lexicon: Lexicon, used: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Vectors of some words, and (row, bucket) of all their n-grams."""
    out, grams, real = np.zeros((len(used), WORD_DIM + CHAR_DIM), np.float32), [], used < lexicon.size
    own = used[real]
    out[real, :WORD_DIM] = p["word"][lexicon.word[own]]
    for bucket, first in lexicon.grams:
        sizes = np.diff(np.append(first, len(bucket)))[own]
        at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first[own], sizes)
        owner = np.repeat(np.flatnonzero(real), sizes)
        grams.append((owner, bucket[at]))
        np.add.at(out[:, WORD_DIM:], owner, p["char"][bucket[at]])
    out[real, WORD_DIM:] *= lexicon.scale[own]
    return out, grams


def score_texts(texts: pa.Array, network, name: str) -> dict[str, pa.Array]:
    """The score of each text; ``network`` is a broadcast of the parameters or None."""
    p = network.value
    if p is None:
        return {name: pa.array(np.zeros(len(texts)), pa.float64())}
    words = split_words(texts, _TABLE)
    doc, first, count = windows(words.offsets)
    out = logits(p, Lexicon(words).vectors(p), words.codes, first, count)
    worst = np.full(len(texts), -np.inf, np.float32)
    np.maximum.at(worst, doc, out)
    return {name: pa.array(sigmoid(worst.astype(np.float64)), pa.float64())}


def score(docs: DataFrame, network: Parameters | None, text_col: str = "text", name: str = "score") -> DataFrame:
    """All columns of ``docs`` with the score, a double called ``name``."""
    shared = docs.sparkSession.sparkContext.broadcast(network)
    return with_text_columns(docs, text_col, f"`{name}` double", partial(score_texts, network=shared, name=name), SLICE_BYTES)
