"""Language identification by segmentation-marginalised unigrams.

A fixed public vocabulary gives the pieces; each language has a probability for
each piece.  A word's probability is the sum over all ways to cut it into
pieces, by the forward algorithm; a text's is the product over its words, and
the prediction is the likeliest language (ties: the first by name).  The score
is the posterior of the predicted language under equal priors.

Words are runs of letters and non-ASCII characters, case folded for A-Z, with
the word mark in front.  A character that no piece covers alone is an arc of
probability FLOOR, the same in all languages, so no word is impossible.

Training: expectation maximisation, with forward-backward counts over the words
of at most `TRAIN_DOCS` documents a language (those with the smallest hash of
their id, `TRAIN_BYTES` of texts at most) outside of the held-out fold, all words of
them.  Probabilities are smoothed by `SMOOTHING` counts.  Only pieces seen in training go to the executors; others
have the same probability in all languages and say nothing.

The sums are those over all ways to cut a word, of any length and script: words of
over `LONGEST` bytes are parted only where no piece crosses, so their parts' sums
multiply, and sums are rescaled as they grow long, so none becomes 0.

Scale: one scan, no shuffle; each chunk scores its distinct words once, all
cuts of all words at a time, known by two 61-bit hashes.

Defined results: `und` with score 0 where the text is null or has no letter, or
nothing was learned; null languages teach nothing; null ids and repeated rows are
scored like others; of equally likely languages the first by name; a very long text
is read whole; an empty table gives an empty result; other columns, also those named
like the operator's own, are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytestext import LOWER, Words, chunks
from .common import held_out, sampled_ids, table
from .pieces import MODEL, NORMAL, SETTING, SPACE, Model

TRAIN_DOCS = 150
TRAIN_BYTES = 16 << 20
ROUNDS = 4
SMOOTHING = 0.1
FLOOR = 1e-7
#: Longer words are parted where no arc crosses, and their sums rescaled every RESCALE bytes; no cut of a word into pieces is lost.
LONGEST, RESCALE = 32, 16
MARK = 0x5F  # stands for the word mark in the machine's alphabet; no word holds it
LETTERS = np.zeros(256, bool)
LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


class Trie:
    """The pieces over bytes: next state by state and byte, and each state's piece."""

    def __init__(self, pieces: list[bytes]):
        children: list[dict[int, int]] = [{}]
        piece_of = [-1]
        for i, piece in enumerate(pieces):
            state = 0
            for byte in piece:
                if byte not in children[state]:
                    children[state][byte] = len(children)
                    children.append({})
                    piece_of.append(-1)
                state = children[state][byte]
            piece_of[state] = i
        used = sorted({b for c in children for b in c})
        self.column = np.zeros(256, np.int32)
        self.column[used] = np.arange(1, len(used) + 1)
        self.next = np.zeros((len(children), len(used) + 1), np.int32)
        for state, own in enumerate(children):
            for byte, to in own.items():
                self.next[state, self.column[byte]] = to
        self.piece_of = np.array(piece_of)
        self.depth = max(map(len, pieces), default=0)


def lattice(trie: Trie, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All arcs (start, end, piece) over the words' bytes; -1 for characters that are no piece."""
    ends = np.repeat(starts + sizes, sizes)
    at = np.flatnonzero((flat & 0xC0) != 0x80)  # arcs start at characters
    column = trie.column[flat]
    state, here, arcs = np.zeros(len(at), np.int32), at, []
    begin = at
    for _ in range(trie.depth):
        live = here < ends[begin]
        begin, here, state = begin[live], here[live], state[live]
        state = trie.next[state, column[here]]
        live = state > 0
        begin, here, state = begin[live], here[live] + 1, state[live]
        hit = np.flatnonzero(trie.piece_of[state] >= 0)
        arcs.append((begin[hit], here[hit], trie.piece_of[state[hit]]))
    one = np.r_[at[1:], len(flat)]
    stop = np.minimum(one, ends[at]) if len(at) else one[:0]
    known = np.zeros(len(flat) + 1, bool)
    for b, e, _ in arcs:
        single = stop[np.searchsorted(at, b)] == e
        known[b[single]] = True
    rest = ~known[at]
    arcs.append((at[rest], stop[rest], np.full(int(rest.sum()), -1)))
    return tuple(np.concatenate(x) for x in zip(*arcs, strict=True))


def forward(starts: np.ndarray, sizes: np.ndarray, arcs: tuple[np.ndarray, ...], weight: np.ndarray) -> np.ndarray:
    """Log of the sum over all paths to each byte place of each word: a row per place, one more than bytes, per language.

    Place of byte b of word w is b + w.  Arcs are taken by their end's distance
    from the word's start, and among those by length, so no two add to one place.
    In long words the places that arcs can still start at are rescaled together.
    """
    begin, end, piece = arcs
    word = np.searchsorted(starts, begin, "right") - 1
    off = end - starts[word]
    order = np.lexsort((end - begin, off))
    begin, end, piece, word, off = (x[order] for x in (begin, end, piece, word, off))
    size = end - begin
    alpha = np.zeros((int(sizes.sum()) + len(sizes), weight.shape[1]))
    alpha[starts + np.arange(len(sizes))] = 1
    breaks = np.flatnonzero(np.r_[True, (off[1:] != off[:-1]) | (size[1:] != size[:-1])]) if len(off) else np.empty(0, int)
    scale = np.zeros_like(alpha)
    longer, limit, reach = np.flatnonzero(sizes > LONGEST), RESCALE, int(size.max(initial=1))
    for a, b in zip(breaks.tolist(), [*breaks[1:].tolist(), len(off)], strict=True):
        while len(longer) and off[a] >= limit:  # the places before the limit are complete
            longer = longer[sizes[longer] >= limit]
            zero = starts[longer] + longer
            rows = zero[:, None] + np.arange(max(0, limit - reach), limit)
            top = alpha[rows].max(axis=1, keepdims=True, initial=0)
            top[top == 0] = 1
            alpha[rows] /= top
            scale[rows] += np.log(top)
            for at in range(limit, limit + RESCALE):
                there = sizes[longer] >= at
                scale[zero[there] + at] = scale[zero[there] + limit - 1]
            limit += RESCALE
        alpha[end[a:b] + word[a:b]] += alpha[begin[a:b] + word[a:b]] * weight[piece[a:b]]
    return np.log(np.maximum(alpha, 1e-300)) + scale


class Identifier:
    """Languages, and per piece (the last row: a character without one) the languages' probabilities."""

    def __init__(self, languages: list[str], pieces: list[bytes], weight: np.ndarray):
        self.languages, self.pieces, self.weight = languages, pieces, weight
        self.trie = Trie(pieces)

    def word_scores(self, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Log probability of each word in each language."""
        arcs = lattice(self.trie, flat, starts, sizes)
        alpha = forward(starts, sizes, arcs, self.weight)
        return alpha[starts + sizes + np.arange(len(sizes))]

    def scores(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Log probability of each text in each language."""
        words = Words(LOWER[buf], offs, LETTERS)
        out = np.zeros((len(offs) - 1, len(self.languages)))
        if not len(words) or not self.languages:
            return out
        _, index, inverse = np.unique(words.hashes(), return_index=True, return_inverse=True)
        if (words.hashes(1)[index][inverse] != words.hashes(1)).any():  # two words have one hash: told apart by both
            pairs = np.stack([words.hashes(), words.hashes(1)], axis=1)
            _, index, inverse = np.unique(pairs, axis=0, return_index=True, return_inverse=True)
            inverse = inverse.ravel()
        flat, starts, sizes, owner = marked([words.text(i) for i in index.tolist()], self.trie)
        parts = self.word_scores(flat, starts, sizes)
        per_word = np.zeros((len(index), parts.shape[1]))
        np.add.at(per_word, owner, parts)
        sums = np.vstack([np.zeros((1, parts.shape[1])), np.cumsum(per_word[inverse], axis=0)])
        return sums[words.first[1:]] - sums[words.first[:-1]]


def marked(words: list[bytes], trie: Trie | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words after the mark as one run of bytes: bytes, starts, sizes, the word of each part.

    With a trie, words of more than LONGEST bytes are parted wherever no arc
    crosses; every way to cut the word passes there, so the parts' sums multiply.
    """
    bodies = [bytes([MARK]) + word for word in words]
    sizes = np.array([len(body) for body in bodies], np.int64)
    long = np.flatnonzero(sizes > LONGEST) if trie is not None else np.empty(0, np.int64)
    if not len(long):
        return np.frombuffer(b"".join(bodies), np.uint8), np.cumsum(sizes) - sizes, sizes, np.arange(len(words))
    short = np.flatnonzero(sizes <= LONGEST)
    flat = np.frombuffer(b"".join(bodies[k] for k in long.tolist()), np.uint8)
    first = np.cumsum(sizes[long]) - sizes[long]
    begin, end, _ = lattice(trie, flat, first, sizes[long])
    crossed = np.cumsum(np.bincount(begin + 1, minlength=len(flat) + 1)[: len(flat) + 1] - np.bincount(end, minlength=len(flat) + 1))
    parts = np.flatnonzero(crossed[:-1] == 0)
    sizes_all = np.r_[sizes[short], np.diff(np.r_[parts, len(flat)])]
    owner = np.r_[short, long[np.searchsorted(first, parts, "right") - 1]]
    body = np.frombuffer(b"".join(bodies[k] for k in short.tolist()), np.uint8)
    return np.r_[body, flat], np.cumsum(sizes_all) - sizes_all, sizes_all, owner


def vocabulary(model: str) -> list[bytes]:
    """The public pieces that words can hold: letters only, a word mark at most in front."""
    with open(model, "rb") as f:
        own = Model(f.read())
    out = set()
    for piece, kind in zip(own.pieces, own.kinds, strict=True):
        body = piece.removeprefix(SPACE)
        if kind == NORMAL and body.isalpha():  # folded as words are: A-Z only
            out.add((bytes([MARK]) if piece[0] == SPACE else b"") + LOWER[np.frombuffer(body.encode(), np.uint8)].tobytes())
    return sorted(out | {bytes([MARK])})


def expected_counts(texts: Iterable[str | None], pieces: list[bytes], trie: Trie) -> np.ndarray:
    """How often each piece stands in the texts, by ROUNDS of expectation maximisation."""
    seen: Counter[bytes] = Counter()
    for text in texts:
        raw = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
        words = Words(raw, np.array([0, len(raw)]), LETTERS)
        seen.update(words.text(i) for i in range(len(words)))
    kept = sorted(seen.items())
    own = np.zeros(len(pieces))
    if not kept:
        return own
    flat, starts, sizes, owner = marked([w for w, _ in kept], trie)
    times = np.array([n for _, n in kept], float)[owner]
    arcs = lattice(trie, flat, starts, sizes)
    begin, end, piece = arcs
    word = np.searchsorted(starts, begin, "right") - 1
    back = mirrored(starts, sizes, arcs)
    weight = np.full((len(pieces) + 1, 1), 1e-4)
    weight[-1] = FLOOR
    for _ in range(ROUNDS):
        alpha = forward(starts, sizes, arcs, weight)[:, 0]
        beta = forward(starts, sizes, back, weight)[:, 0]
        total = alpha[starts + sizes + np.arange(len(sizes))]
        mirror = starts[word] + sizes[word] - (end - starts[word]) + word  # end's place, from the word's end
        share = np.exp(alpha[begin + word] + np.log(weight[piece, 0]) + beta[mirror] - total[word]) * times[word]
        own = np.bincount(piece[piece >= 0], share[piece >= 0], len(pieces))
        weight[:-1, 0] = (own + SMOOTHING) / (own.sum() + SMOOTHING * len(pieces))
    return own


def assembled(counts: dict[str, np.ndarray], pieces: list[bytes]) -> Identifier:
    """Piece probabilities of each language, from the pieces' counts."""
    languages = sorted(counts)
    by_language = np.stack([counts[lang] for lang in languages], axis=1) if languages else np.zeros((len(pieces), 0))
    used = np.flatnonzero(by_language.max(axis=1, initial=0) > 1e-3)
    weight = (by_language[used] + SMOOTHING) / np.maximum(by_language[used].sum(axis=0) + SMOOTHING * len(pieces), 1)
    return Identifier(languages, [pieces[i] for i in used], np.vstack([weight, np.full((1, len(languages)), FLOOR)]))


def fitted(texts: dict[str, list[str]], model: str = MODEL) -> Identifier:
    """The model of some texts of each language."""
    pieces = vocabulary(model)
    trie = Trie(pieces)
    return assembled({lang: expected_counts(own, pieces, trie) for lang, own in texts.items()}, pieces)


def mirrored(starts: np.ndarray, sizes: np.ndarray, arcs: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """The arcs of the words read backwards."""
    begin, end, piece = arcs
    word = np.searchsorted(starts, begin, "right") - 1
    turn = 2 * starts[word] + sizes[word]
    return turn - end, turn - begin, piece


def train(docs: DataFrame, model: str = MODEL) -> Identifier:
    """From at most TRAIN_DOCS documents and TRAIN_BYTES of text a language outside of the held-out fold.

    Ids and sizes of all languages' samples come by one scan each; a third one brings the texts to a task per language, which fits
    it.  The driver receives ids, sizes and one vector of counts a language, no texts.
    """
    spark, pieces = docs.sparkSession, vocabulary(model)
    known = docs.select(F.col("doc_id").cast("bigint"), F.col("lang").cast("string"), "text").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = sampled_ids(known.select("doc_id", "lang"), "lang", TRAIN_DOCS)
    picked = spark.createDataFrame([(lang, doc_id, place) for place, (lang, doc_id) in enumerate(chosen)], "lang string, doc_id bigint, place bigint")
    rows = known.withColumn("_hash", F.xxhash64("text")).join(F.broadcast(picked), ["lang", "doc_id"])  # TRAIN_DOCS rows a language
    least = F.min(F.struct("_hash", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))).alias("least")
    taken, total = [], Counter()
    for lang, doc_id, _, (key, size) in sorted(rows.groupBy("lang", "doc_id", "place").agg(least).collect(), key=lambda r: r["place"]):
        if total[lang] + size <= TRAIN_BYTES:
            total[lang] += size
            taken.append((lang, doc_id, key))
    own = spark.createDataFrame(taken, "lang string, doc_id bigint, _hash bigint")

    def fit(table: pa.Table) -> pa.Table:
        once = dict(zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist(), strict=True))
        counts = expected_counts(once.values(), pieces, Trie(pieces))
        return pa.table({"lang": [table.column("lang")[0].as_py()], "counts": pa.array([counts.tobytes()], pa.binary())})

    fits = rows.join(F.broadcast(own), ["lang", "doc_id", "_hash"]).select("lang", "doc_id", "text").groupBy("lang").applyInArrow(fit, "lang string, counts binary")
    return assembled({r["lang"]: np.frombuffer(bytes(r["counts"])) for r in fits.collect()}, pieces)


SCHEMA = "doc_id bigint, lang_pred string, score double"


def predicted(batches: Iterable[pa.RecordBatch], own: Identifier) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, buf, offs in chunks(batch):
            scores = own.scores(buf, offs)
            plain = np.r_[0, np.cumsum(LETTERS[buf] & (buf < 0x80))]
            letters = plain[offs[1:]] > plain[offs[:-1]]
            other = np.r_[0, np.cumsum(buf >= 0x80)]
            for d in np.flatnonzero(~letters & (other[offs[1:]] > other[offs[:-1]])).tolist():
                letters[d] = any(c.isalpha() for c in buf[offs[d] : offs[d + 1]].tobytes().decode())
            names, posterior = ["und"] * len(letters), np.zeros(len(letters))
            if own.languages:
                best = scores.argmax(axis=1)
                odds = 1 / np.exp(scores - scores.max(axis=1, keepdims=True)).sum(axis=1)
                posterior = np.where(letters, odds, 0.0)
                names = [own.languages[b] if has else "und" for b, has in zip(best.tolist(), letters.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(posterior)], ["doc_id", "lang_pred", "score"])


def identified(docs: DataFrame, model: str | None = None) -> DataFrame:
    """Predictions with the pieces of the model's file: a parameter, or the setting that op2 has."""
    own = train(docs, model or docs.sparkSession.conf.get(SETTING, MODEL))
    rows = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(lambda it: predicted(it, own), SCHEMA)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(table(spark, sf_dir, "documents"))
