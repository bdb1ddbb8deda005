"""Toxicity by a bidirectional gated recurrent network with attention pooling.

Tokens are lower-cased runs of letters (A-Z, non-ASCII).  A token's word inputs are
a learned embedding of the word and its smoothed log odds of standing in toxic
documents; its character inputs are the mean of learned embeddings of its runs of
five bytes, and the odds of the run at its head, of the strongest run and of all in
the mean.  Embeddings are found by hash and trained with the network, through all
of its layers.  The network reads all windows of `WINDOW` tokens that begin at
every `STRIDE`th token, each overlapping the next by half: a gated recurrent unit
in each direction, attention over all tokens, and a logistic output.  Every window
of every whole text is scored; the document's score comes from a logistic layer
over its windows' greatest, second and mean output and their number.

Training, in numpy on the driver, uses at most `TRAIN_DOCS` labelled documents of
each label (those with the smallest hash of their id) outside of the held-out
fold, `TRAIN_BYTES` of texts at most.  Each of its `EPOCHS` draws `EPOCH_WINDOWS` of
all their windows anew, toxic and other ones alike.  Odds that train the network
leave the token's own document out, and embeddings are dropped at random, so words
that one document has alone teach little.  Labels are the only thing besides texts
that training sees; scores depend on the text alone.

Scale: scans for the sample, one for the scores, no shuffle of texts; the network,
its embeddings and its odds are some MB, bounded by the sample.

Defined results: a null, empty or letterless text has a window without tokens;
without labels of both kinds every score is 0; repeated labels count once a
document, as toxic if any is; null ids and repeated rows are scored like others; a
very long text is read whole, some windows at a time; an empty table gives an empty
result; other columns, also those named like the operator's own, are ignored, and
kept by accepted().
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytestext import LOWER, U64, Words, chunks, member, mix
from .common import held_out, sampled_ids, table, texts_of
from .language import LETTERS

TRAIN_DOCS = {1: 700, 0: 1100}
TRAIN_BYTES = 48 << 20
EPOCH_WINDOWS = 9000
WINDOW, STRIDE = 32, 16
#: Numbers of a token: odds of the word and of its runs, and embeddings of both.
ODDS, EMBED = 4, 6
INPUTS = ODDS + 2 * EMBED
HIDDEN, ATTENTION = 8, 6
GRAM_ROWS = 1 << 12
#: Documents that a word with an embedding of its own stands in; share of words whose embeddings are left out at a time.
LEAST_DOCS, DROP = 5, 0.8
EMBED_START, EMBED_RATE, EMBED_DECAY = 0.02, 0.001, 0.05
EPOCHS, BATCH, RATE = 14, 256, 0.01
PRIOR = 2.0
GRAM, GRAM_BITS = 5, 18
EDGE = 0x5E  # stands before and after each token
REJECT = 0.7
#: Documents whose training inputs are made at once.
TOGETHER = 64
#: Windows that the network reads at once.
AT_ONCE = 2048


# ---- tokens and their inputs ----


@dataclass
class Tokens:
    """Word hashes of some texts, and per token its runs of GRAM bytes, as buckets."""

    words: np.ndarray
    first: np.ndarray
    grams: np.ndarray
    gram_first: np.ndarray  # one more than tokens


def tokens(buf: np.ndarray, offs: np.ndarray) -> Tokens:
    sizes = np.diff(offs)
    buf = np.insert(LOWER[buf], offs[:-1], EDGE) if len(sizes) else buf
    offs = offs + np.arange(len(offs))
    buf = np.where(LETTERS[buf], buf, np.uint8(EDGE))
    words = Words(buf, offs, LETTERS)
    wide = np.r_[buf, np.full(GRAM, EDGE, np.uint8)].astype(np.uint64)
    runs = np.zeros(len(buf), np.uint64)
    for k in range(GRAM):
        runs |= wide[k : len(buf) + k] << U64(8 * k)
    short = np.flatnonzero(words.ends - words.starts < GRAM - 2)  # their run ends with the edge after them
    runs[words.starts[short] - 1] &= (U64(1) << (U64(8) * (words.ends - words.starts + 2)[short].astype(np.uint64))) - U64(1)
    runs = (mix(runs) >> U64(64 - GRAM_BITS)).astype(np.int32)
    # a token's runs start from the edge before it to GRAM - 1 before the edge after it, one at least
    size = np.maximum(words.ends - words.starts + 3 - GRAM, 1)
    gram_first = np.r_[0, np.cumsum(size)]
    at = np.arange(gram_first[-1]) + np.repeat(words.starts - 1 - gram_first[:-1], size)
    return Tokens(words.hashes(), words.first, runs[at], gram_first)


def tokens_of(texts: list[str]) -> Tokens:
    """Tokens of many texts, made TOGETHER texts at a time."""
    parts = []
    for lo in range(0, len(texts), TOGETHER):
        raw = [(t or "").encode() for t in texts[lo : lo + TOGETHER]]
        parts.append(tokens(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])]))
    join = lambda rows: np.concatenate([[0], *(r[1:] + o for r, o in zip(rows, np.cumsum([0, *(r[-1] for r in rows[:-1])]), strict=True))]).astype(np.int64)
    return Tokens(np.concatenate([p.words for p in parts]), join([p.first for p in parts]), np.concatenate([p.grams for p in parts]), join([p.gram_first for p in parts]))


def odds(toxic: np.ndarray, clean: np.ndarray, n_toxic, n_clean) -> np.ndarray:
    """Smoothed log odds of document counts; 0 for what was never seen."""
    share = (n_toxic + 0.5) / (n_toxic + n_clean + 1.0)
    high = np.log((toxic + PRIOR * share) / (n_toxic + PRIOR * share))
    low = np.log((clean + PRIOR * (1 - share)) / (n_clean + PRIOR * (1 - share)))
    rest = np.log(PRIOR * share / (n_toxic + PRIOR * share)) - np.log(PRIOR * (1 - share) / (n_clean + PRIOR * (1 - share)))
    return np.clip(high - low - rest, -3, 3) / 2


def inputs(word_odds: np.ndarray, gram_odds: np.ndarray, gram_first: np.ndarray) -> np.ndarray:
    """The odds of each token and of its runs."""
    n = len(word_odds)
    out = np.empty((n, ODDS), np.float32)
    if n:
        out[:, 0] = word_odds
        out[:, 1] = gram_odds[gram_first[:-1]]
        out[:, 2] = np.maximum.reduceat(gram_odds, gram_first[:-1])
        out[:, 3] = np.add.reduceat(gram_odds, gram_first[:-1]) / np.diff(gram_first)
    return out


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, size and text of every window; a text without tokens has one of size 0."""
    counts = np.diff(first)
    n = 1 + np.maximum(0, -(-(counts - WINDOW) // STRIDE))
    doc = np.repeat(np.arange(len(counts)), n)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    start = first[:-1][doc] + nth * STRIDE
    return start, np.minimum(WINDOW, first[1:][doc] - start), doc


# ---- the network ----


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Types:
    """Distinct words: rows of the word embeddings (0 for words that training has in few documents), and of the runs' embeddings, those of each word from `first` on."""

    word: np.ndarray
    gram: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, own: Tokens, index: np.ndarray, known: np.ndarray) -> Types:
        """Of the tokens at the index; the known words have the rows from 1 on."""
        size = np.diff(own.gram_first)[index]
        first = np.r_[0, np.cumsum(size)]
        at = np.arange(first[-1]) + np.repeat(own.gram_first[index] - first[:-1], size)
        words = own.words[index]
        row = np.where(member(words, known), np.searchsorted(known, words) + 1, 0)
        return cls(row, own.grams[at] >> (GRAM_BITS - 12), first)

    def some(self, rows: np.ndarray) -> Types:
        size = np.diff(self.first)[rows]
        first = np.r_[0, np.cumsum(size)]
        return Types(self.word[rows], self.gram[np.arange(first[-1]) + np.repeat(self.first[rows] - first[:-1], size)], first)


@dataclass
class Network:
    """Weights: embeddings e of words and runs; per direction (0 forward) inputs w, recurrence u and bias b of update, reset and state; attention; output."""

    e: list[np.ndarray]
    w: list[np.ndarray]
    u: list[np.ndarray]
    b: list[np.ndarray]
    a: np.ndarray
    c: np.ndarray
    v: np.ndarray
    o: np.ndarray
    d: np.ndarray
    moments: dict = field(default_factory=dict)

    @classmethod
    def fresh(cls, n_words: int = 100, seed: int = 3) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
        h = HIDDEN
        small = lambda rows: (EMBED_START * rng.normal(size=(rows, EMBED))).astype(np.float32)
        embeddings = [small(n_words + 1), small(GRAM_ROWS)]
        embeddings[0][0] = 0
        return cls(
            embeddings,
            [draw(INPUTS, 3 * h) for _ in range(2)], [draw(h, 3 * h) for _ in range(2)], [np.zeros(3 * h, np.float32) for _ in range(2)],
            draw(2 * h, ATTENTION), np.zeros(ATTENTION, np.float32), draw(ATTENTION), draw(2 * h), np.zeros(1, np.float32),
        )

    def embedded(self, types: Types) -> np.ndarray:
        """Embedding of each word, and the mean of its runs'."""
        out = np.empty((len(types.word), 2 * EMBED), np.float32)
        out[:, :EMBED] = self.e[0][types.word]
        if len(out):
            out[:, EMBED:] = np.add.reduceat(self.e[1][types.gram], types.first[:-1]) / np.diff(types.first)[:, None]
        return out

    def embedding_grads(self, types: Types, by_type: np.ndarray) -> dict:
        """Gradients of the embeddings for those of each word's embedded()."""
        gw, gg = np.zeros_like(self.e[0]), np.zeros_like(self.e[1])
        np.add.at(gw, types.word, by_type[:, :EMBED])
        gw[0] = 0
        size = np.diff(types.first)
        np.add.at(gg, types.gram, np.repeat(by_type[:, EMBED:] / size[:, None], size, axis=0))
        return {"e0": gw, "e1": gg}

    def projected(self, x: np.ndarray) -> np.ndarray:
        """What inputs give to the gates of both directions, side by side."""
        return x @ np.concatenate(self.w, axis=1) + np.concatenate(self.b)

    def forward(self, projected: np.ndarray, on: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Outputs (log odds) of windows (n, WINDOW, gates) whose tokens `on` exist; keep gets what backward() needs."""
        n, size, _ = projected.shape
        h = HIDDEN
        states = np.empty((n, size, 2 * h), np.float32)
        for way in (0, 1):
            now = np.zeros((n, h), np.float32)
            pre = projected[:, :, way * 3 * h : (way + 1) * 3 * h]
            for t in range(size) if way == 0 else range(size - 1, -1, -1):
                rec = now @ self.u[way]
                gates = _sigmoid(pre[:, t, : 2 * h] + rec[:, : 2 * h])
                z, r = gates[:, :h], gates[:, h:]
                new = np.tanh(pre[:, t, 2 * h :] + r * rec[:, 2 * h :])
                live = on[:, t, None]
                before = now
                now = np.where(live, new + z * (before - new), before)
                states[:, t, way * h : (way + 1) * h] = now
                if keep is not None:
                    keep.append((way, t, before, gates, new, rec[:, 2 * h :]))
        hidden = np.tanh(states @ self.a + self.c)
        score = np.where(on, hidden @ self.v, -1e9)
        weight = np.exp(score - score.max(axis=1, keepdims=True)) * on
        weight /= np.maximum(weight.sum(axis=1, keepdims=True), 1e-9)
        pooled = np.einsum("nt,nth->nh", weight, states)
        if keep is not None:
            keep.append((states, hidden, weight, pooled))
        return pooled @ self.o + self.d[0]

    def backward(self, x: np.ndarray, on: np.ndarray, out_grad: np.ndarray, keep: list) -> dict:
        """Gradients of all weights but the embeddings', and as "x" of the inputs, for the outputs' gradients."""
        h = HIDDEN
        states, hidden, weight, pooled = keep.pop()
        grads = {"o": pooled.T @ out_grad, "d": out_grad.sum(keepdims=True)}
        by_pool = out_grad[:, None] * self.o
        by_weight = np.einsum("nth,nh->nt", states, by_pool)
        by_score = weight * (by_weight - (weight * by_weight).sum(axis=1, keepdims=True))
        by_hidden = by_score[:, :, None] * self.v * (1 - hidden**2)
        grads["v"] = np.einsum("nt,nta->a", by_score, hidden)
        grads["a"] = np.einsum("nth,nta->ha", states, by_hidden)
        grads["c"] = by_hidden.sum(axis=(0, 1))
        by_state = weight[:, :, None] * by_pool[:, None, :] + by_hidden @ self.a.T
        grads["x"] = np.zeros_like(x)
        for way in (0, 1):
            gw, gu, gb = (np.zeros_like(p[way]) for p in (self.w, self.u, self.b))
            carry = np.zeros((len(x), h), np.float32)
            for _, t, before, gates, new, rec in reversed([k for k in keep if k[0] == way]):
                g = by_state[:, t, way * h : (way + 1) * h] + carry
                live = on[:, t, None]
                z, r = gates[:, :h], gates[:, h:]
                g_new = g * (1 - z) * (1 - new**2) * live
                g_pre = np.concatenate([g * (before - new) * z * (1 - z) * live, g_new * rec * r * (1 - r), g_new], axis=1)
                g_rec = np.concatenate([g_pre[:, : 2 * h], g_new * r], axis=1)
                gw += x[:, t].T @ g_pre
                grads["x"][:, t] += g_pre @ self.w[way].T
                gu += before.T @ g_rec
                gb += g_pre.sum(axis=0)
                carry = np.where(live, g * z, g) + g_rec @ self.u[way].T
            grads |= {f"w{way}": gw, f"u{way}": gu, f"b{way}": gb}
        return grads

    def step(self, grads: dict, count: int, rate: float = RATE) -> None:
        """One step of Adam."""
        for name, g in grads.items():
            p = getattr(self, name[0])[int(name[1])] if len(name) > 1 else getattr(self, name)
            if name[0] == "e":  # rows that a batch does not have stay as they are
                (s,) = self.moments.setdefault(name, (np.full_like(p, 1e-6),))
                s += g * g
                p -= EMBED_RATE * (g / np.sqrt(s) + EMBED_DECAY * p * (g != 0))
                continue
            m, s = self.moments.setdefault(name, (np.zeros_like(p), np.zeros_like(p)))
            g = g + 1e-4 * p
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            p -= rate * (m / (1 - 0.9**count)) / (np.sqrt(s / (1 - 0.99**count)) + 1e-6)

    def fit(self, odds_of: np.ndarray, kind: np.ndarray, types: Types, start: np.ndarray, size: np.ndarray, y: np.ndarray, seed: int = 4) -> None:
        """Trains on windows of tokens with odds and a kind (a row of the types) each; y is the windows' label."""
        rng = np.random.default_rng(seed)
        steps = np.arange(WINDOW)
        share = _balanced(y > 0)
        weight = np.where(y > 0, 1.0, max(0.3, y.sum() / max(1, (1 - y).sum()))).astype(np.float32)
        odds_of = np.vstack([odds_of, np.zeros((WINDOW, ODDS), np.float32)])
        kind = np.r_[kind, np.zeros(WINDOW, kind.dtype)]
        count = 0
        for epoch in range(EPOCHS):
            order = rng.choice(len(start), min(EPOCH_WINDOWS, 4 * len(start)), p=share)
            for at in range(0, len(order), BATCH):
                rows = order[at : at + BATCH]
                places = start[rows, None] + steps
                on = steps < size[rows, None]
                used, which = np.unique(kind[places], return_inverse=True)
                own = types.some(used)
                shown = (rng.random((len(used), 1)) >= DROP) / np.float32(1 - DROP)
                x = np.concatenate([odds_of[places], (self.embedded(own) * shown)[which.reshape(places.shape)]], axis=2).astype(np.float32)
                keep: list = []
                z = self.forward(self.projected(x), on, keep)
                grad = ((_sigmoid(z) - y[rows]) * weight[rows] / weight[rows].sum()).astype(np.float32)
                grads = self.backward(x, on, grad, keep)
                by_type = np.zeros((len(used), 2 * EMBED), np.float32)
                np.add.at(by_type, which.ravel(), grads.pop("x")[:, :, ODDS:].reshape(-1, 2 * EMBED))
                count += 1
                self.step(grads | self.embedding_grads(own, by_type * shown), count, RATE * (1 - 0.8 * epoch / EPOCHS))
        self.moments = {}


def read(network: Network, projected: np.ndarray, kind: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The output of every window of the texts, and its text; a token's gates are those of its kind."""
    start, size, doc = windows(first)
    kind = np.r_[kind, np.zeros(WINDOW, np.int64)]
    if not len(projected):
        projected = np.zeros((1, 6 * HIDDEN), np.float32)
    out = np.empty(len(start), np.float32)
    steps = np.arange(WINDOW)
    for at in range(0, len(start), AT_ONCE):
        s, n = start[at : at + AT_ONCE], size[at : at + AT_ONCE]
        on = steps < n[:, None]
        out[at : at + AT_ONCE] = network.forward(projected[kind[s[:, None] + steps]], on)
    return out, doc


def pooled(z: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Per text: greatest, second (the greatest, if alone) and mean output, log of the windows, 1."""
    order = np.lexsort((-z, doc))
    z = z[order]
    head = np.searchsorted(doc, np.arange(n))
    count = np.bincount(doc, minlength=n)
    second = z[np.minimum(head + 1, head + count - 1)]
    return np.stack([z[head], second, np.bincount(doc, z, n) / count, np.log(count), np.ones(n)], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, decay: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic layer, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = _sigmoid(x @ w)
        hessian = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + decay * np.eye(len(w))
        w -= np.clip(np.linalg.solve(hessian, x.T @ (p - y) + decay * w), -2, 2)
    return w


class Scorer:
    """The trained network with its odds; without a network every score is 0."""

    def __init__(self) -> None:
        self.network: Network | None = None
        self.known = np.empty(0, np.uint64)  # words with embeddings of their own
        self.words = np.empty(0, np.uint64)
        self.word_odds = np.empty(0, np.float32)
        self.gram_odds = np.zeros(1 << GRAM_BITS, np.float32)
        self.layer = np.zeros(5)

    def scores(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        n = len(offs) - 1
        if self.network is None or not n:
            return np.zeros(n)
        own = tokens(buf, offs)
        _, index, kind = np.unique(own.words, return_index=True, return_inverse=True)  # a token's inputs follow from its word
        word_odds = np.zeros(len(index), np.float32)
        at = np.flatnonzero(member(own.words[index], self.words))
        word_odds[at] = self.word_odds[np.searchsorted(self.words, own.words[index[at]])]
        z, doc = read(self.network, self.network.projected(self.inputs(own, index, word_odds)), kind, own.first)
        return _sigmoid(pooled(z, doc, n) @ self.layer)

    def inputs(self, own: Tokens, index: np.ndarray, word_odds: np.ndarray) -> np.ndarray:
        """All inputs of the tokens at the index."""
        size = np.diff(own.gram_first)[index]
        first = np.r_[0, np.cumsum(size)]
        at = np.arange(first[-1]) + np.repeat(own.gram_first[index] - first[:-1], size)
        return np.concatenate([inputs(word_odds, self.gram_odds[own.grams[at]], first), self.network.embedded(Types.of(own, index, self.known))], axis=1)


def _document_counts(keys: np.ndarray, first: np.ndarray, toxic: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """In how many toxic and clean documents each key below n stands; a document's keys begin at `first`."""
    counts = np.zeros((2, n), np.int32)
    for d, own in enumerate(toxic.tolist()):
        counts[int(not own), np.unique(keys[first[d] : first[d + 1]])] += 1
    return counts[0], counts[1]


def fitted(texts: list[str], labels: list[int], seed: int = 3) -> Scorer:
    """A scorer from labelled texts."""
    scorer = Scorer()
    toxic = np.array(labels, bool)
    n_toxic, n_clean = int(toxic.sum()), int((~toxic).sum())
    if not n_toxic or not n_clean:
        return scorer
    own = tokens_of(texts)
    doc = np.repeat(np.arange(len(texts)), np.diff(own.first))
    doc = doc.astype(np.int32)
    gram_doc = np.repeat(doc, np.diff(own.gram_first))
    known, first_at, index = np.unique(own.words, return_index=True, return_inverse=True)
    high, low = _document_counts(index, own.first, toxic, len(known))
    scorer.known = known[high + low >= LEAST_DOCS]
    types = Types.of(own, first_at, scorer.known)
    gram_high, gram_low = _document_counts(own.grams, own.gram_first[own.first], toxic, 1 << GRAM_BITS)
    x = np.empty((len(doc), ODDS), np.float32)
    for lo in range(0, len(texts), TOGETHER):  # what a token's own document adds is left out for training
        a, b = own.first[lo], own.first[min(lo + TOGETHER, len(texts))]
        g = slice(own.gram_first[a], own.gram_first[b])
        mine, gram_mine = toxic[doc[a:b]], toxic[gram_doc[g]]
        word_x = odds(high[index[a:b]] - mine, low[index[a:b]] - ~mine, n_toxic - mine, n_clean - ~mine)
        gram_x = odds(gram_high[own.grams[g]] - gram_mine, gram_low[own.grams[g]] - ~gram_mine, n_toxic - gram_mine, n_clean - ~gram_mine)
        x[a:b] = inputs(word_x.astype(np.float32), gram_x.astype(np.float32), own.gram_first[a : b + 1] - own.gram_first[a])
    start, size, of = windows(own.first)
    scorer.network = Network.fresh(len(scorer.known), seed)
    scorer.network.fit(x, index, types, start, size, toxic[of].astype(np.float32), seed + 1)
    z = np.empty(len(start), np.float32)
    steps, padded, kinds = np.arange(WINDOW), np.vstack([x, np.zeros((WINDOW, ODDS), np.float32)]), np.r_[index, np.zeros(WINDOW, np.int64)]
    embedded = scorer.network.embedded(types)
    for at in range(0, len(start), AT_ONCE):
        places = start[at : at + AT_ONCE, None] + steps
        gates = scorer.network.projected(np.concatenate([padded[places], embedded[kinds[places]]], axis=2))
        z[at : at + AT_ONCE] = scorer.network.forward(gates, steps < size[at : at + AT_ONCE, None])
    scorer.layer = logistic(pooled(z, of, len(texts)), toxic.astype(float))
    value = odds(high, low, n_toxic, n_clean)
    some = np.abs(value) > 0.02
    scorer.words, scorer.word_odds = known[some], value[some].astype(np.float32)
    scorer.gram_odds = odds(gram_high, gram_low, n_toxic, n_clean).astype(np.float32)
    return scorer


def _balanced(y: np.ndarray) -> np.ndarray:
    p = np.where(y, 1 / max(1, y.sum()), 1 / max(1, (~y).sum()))
    return p / p.sum()


# ---- Spark ----


def train(docs: DataFrame, labels: DataFrame) -> Scorer:
    """From at most TRAIN_DOCS documents of each label outside of the held-out fold."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    label = {doc_id: value for value, doc_id in sampled_ids(known, "toxic", TRAIN_DOCS)}
    rows = sorted((doc_id, text) for doc_id, text in texts_of(docs, list(label), TRAIN_BYTES))
    return fitted([t for _, t in rows], [label[d] for d, _ in rows])


def scored(batches: Iterable[pa.RecordBatch], scorer: Scorer) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, buf, offs in chunks(batch):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scorer.scores(buf, offs))], ["doc_id", "score"])


def accepted_batches(batches: Iterable[pa.RecordBatch], scorer: Scorer) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, buf, offs in chunks(batch):
            yield part.filter(pa.array(scorer.scores(buf, offs) < REJECT))


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each document."""
    scorer = train(docs, labels)
    rows = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(lambda it: scored(it, scorer), "doc_id bigint, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score below REJECT; all columns."""
    scorer = train(docs, labels)
    return docs.mapInArrow(lambda it: accepted_batches(it, scorer), docs.schema)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
