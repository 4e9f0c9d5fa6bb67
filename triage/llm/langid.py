"""Language of texts by a linear-chain conditional random field over words.

A word's features are its byte n-grams of one to three bytes with marks for its
ends (so prefixes and suffixes are their own features) and a lexicon: how often
the word's hash bucket occurs in each language, over all training documents.
Transitions between the labels of neighbouring words are learned with the
feature weights, by gradient ascent on the log-likelihood.  Forward-backward
gives every word of a text its label probabilities; a text, code-switched or
not, gets the language with the largest sum over its words with letters, and
that sum's share as ``score``.

The weights are fitted on the driver on a bounded sample: at most
``sample_docs`` training documents for each language (the first in hash order), whole
unless they have over ``sample_words`` words, of which evenly spread stretches are
taken then.  Their chains are stretches of 128 words.  Lexicon counts and predictions
cover all whole texts, and the chain of a text to be labelled runs from its first word
to its last: the messages are carried from stretch to stretch.

Edge cases: a text that is null or has no letter is ``und`` with score 0; rows
with a null or empty ``lang`` are not learned from, rows that repeat ``doc_id`` and
``lang`` once, by the text of lowest hash; if nothing can be learned
all are ``und``; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .quality_model import fold
from .words import Words, mix, slices, words_of

NGRAM_BITS, LEXICON_BITS = 17, 16
NGRAMS, LEXICON = 1 << NGRAM_BITS, 1 << LEXICON_BITS
FIT_STRETCH, STRETCH, CELLS = 128, 4_096, 1 << 18
SAMPLE_DOCS, SAMPLE_WORDS = 400, 65_536


def _lexicon_buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - LEXICON_BITS)).astype(np.int64)


def _ngrams(words: Words, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of the words at ``of`` and how many each has."""
    starts, sizes = words.starts[of], words.ends[of] - words.starts[of]
    width = sizes + 2  # with a mark at either end
    ends = np.cumsum(width)
    owner = np.repeat(np.arange(len(of)), width)
    place = np.arange(ends[-1] if len(ends) else 0) - (ends - width)[owner]
    chars = np.zeros(len(owner), np.uint64)
    inside = (place > 0) & (place <= sizes[owner])
    chars[inside] = words.data[(starts[owner] + place - 1)[inside]]
    chars[place == 0], chars[place == width[owner] - 1] = 1, 2
    pair, triple = np.zeros_like(chars), np.zeros_like(chars)
    pair[:-1] = chars[:-1] | (chars[1:] << np.uint64(8))
    triple[:-2] = pair[:-2] | (chars[2:] << np.uint64(16))
    left = width[owner] - place  # characters from here to the word's end
    found, owners = [], []
    for n, key in ((1, chars), (2, pair), (3, triple)):
        ok = left >= n
        found.append(mix(key[ok] * np.uint64(4) + np.uint64(n)) >> np.uint64(64 - NGRAM_BITS))
        owners.append(owner[ok])
    order = np.argsort(np.concatenate(owners), kind="stable")
    return np.concatenate(found)[order].astype(np.int64), np.bincount(np.concatenate(owners), minlength=len(of))


def _lexicon_counts(langs: list[str]):
    index = {lang: k for k, lang in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(LEXICON * len(langs), np.int64)
        for batch in slices(batches):
            words = words_of(batch["text"], lower=True)
            lang = np.array([index[x] for x in batch["lang"].to_pylist()], np.int64)
            counts += np.bincount(_lexicon_buckets(words.hashes) * len(langs) + np.repeat(lang, np.diff(words.first)), minlength=len(counts))
        table = counts.reshape(LEXICON, len(langs))
        rows = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(rows), *(pa.array(np.ascontiguousarray(table[rows, k])) for k in range(len(langs)))], names=["bucket", *(f"n{k}" for k in range(len(langs)))])

    return count


def _lexicon(training: DataFrame, langs: list[str]) -> np.ndarray:
    """Smoothed log share of each language in each bucket (LEXICON x languages)."""
    names = [f"n{k}" for k in range(len(langs))]
    schema = ", ".join(f"{c} long" for c in ["bucket", *names])
    found = training.select("text", "lang").mapInArrow(_lexicon_counts(langs), schema).groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    counts = np.zeros((LEXICON, len(langs)))
    if found.num_rows:
        counts[found["bucket"].to_numpy()] = np.stack([found[n].to_numpy() for n in names], axis=1)
    rate = (counts + 0.1) / (counts.sum(axis=0) + 0.1 * LEXICON)
    share = rate / rate.sum(axis=1, keepdims=True)
    seen = counts.sum(axis=1, keepdims=True)
    return (np.log(share) - np.log(1 / len(langs))) * (seen / (seen + 5))


def _sample(sample_words: int):
    """Stretches of each document: all of it, or evenly spread ones up to ``sample_words`` words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = words_of(batch["text"])
            lang, out = batch["lang"].to_pylist(), []
            for k in range(batch.num_rows):
                starts = np.arange(words.first[k], words.first[k + 1], FIT_STRETCH)
                most = max(1, sample_words // FIT_STRETCH)
                for start in starts if len(starts) <= most else starts[np.linspace(0, len(starts) - 1, most).astype(int)]:
                    last = min(start + FIT_STRETCH, words.first[k + 1]) - 1
                    out.append({"lang": lang[k], "text": bytes(words.data[words.starts[start] : words.ends[last]]).decode()})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("lang", pa.string()), ("text", pa.string())]))

    return cut


def _normal(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


def forward_messages(psi: np.ndarray, step: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """Label shares of every word given the words up to it, for chains x words x labels; ``start`` are those of the word before."""
    forward = np.empty_like(psi)
    forward[:, 0] = _normal(psi[:, 0] if start is None else (start @ step) * psi[:, 0])
    for t in range(1, psi.shape[1]):
        forward[:, t] = _normal((forward[:, t - 1] @ step) * psi[:, t])
    return forward


def backward_messages(psi: np.ndarray, mask: np.ndarray, step: np.ndarray, end: np.ndarray | None = None) -> np.ndarray:
    """What the words after each say about its label; ``end``: about the last one's."""
    backward = np.ones_like(psi)
    if end is not None:
        backward[:, -1] = end
    for t in range(psi.shape[1] - 2, -1, -1):
        b = _normal((backward[:, t + 1] * psi[:, t + 1]) @ step.T)
        backward[:, t] = np.where(mask[:, t + 1, None], b, 1.0)
    return backward


def _factors(scores: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.exp(scores - scores.max(axis=2, keepdims=True)), np.exp(transitions - transitions.max())


def forward_backward(scores: np.ndarray, mask: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of every word and expected transitions, for chains x words x labels of scores."""
    psi, step = _factors(scores, transitions)
    forward, backward = forward_messages(psi, step), backward_messages(psi, mask, step)
    marginal = _normal(forward * backward)
    expected = np.zeros(step.shape)
    for t in range(psi.shape[1] - 1):
        rows = mask[:, t + 1]
        pair = forward[rows, t][:, :, None] * step * (psi[rows, t + 1] * backward[rows, t + 1])[:, None, :]
        expected += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return marginal, expected


def chain_marginals(scores_of, lengths: np.ndarray, transitions: np.ndarray, stretch: int = STRETCH) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Label probabilities of whole chains, stretch by stretch from the last: its first word,
    the chains that reach it, their words there (mask) and the probabilities.

    ``scores_of(rows, low, high)`` gives the scores of these words.  A first pass keeps
    only the forward messages between stretches.
    """
    def part(low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        rows = np.flatnonzero(lengths > low)
        high = min(low + stretch, int(lengths[rows].max()))
        mask = np.arange(low, high) < lengths[rows][:, None]
        psi, step = _factors(scores_of(rows, low, high), transitions)
        return rows, mask, psi, step

    lows = list(range(0, int(lengths.max(initial=0)), stretch))
    before: list[np.ndarray | None] = [None]
    for low in lows[:-1]:
        rows, mask, psi, step = part(low)
        message = np.full((len(lengths), psi.shape[2]), 1 / psi.shape[2])
        message[rows] = forward_messages(psi, step, None if before[-1] is None else before[-1][rows])[:, -1]
        before.append(message)  # of chains that end before, it is not used
    after = None
    for low, start in zip(reversed(lows), reversed(before)):
        rows, mask, psi, step = part(low)
        ahead = np.ones((len(lengths), psi.shape[2])) if after is None else after
        forward = forward_messages(psi, step, None if start is None else start[rows])
        backward = backward_messages(psi, mask, step, ahead[rows])
        yield low, rows, mask, _normal(forward * backward)
        after = np.ones((len(lengths), psi.shape[2]))
        after[rows] = _normal((backward[:, 0] * psi[:, 0]) @ step.T)


class Field:
    """The conditional random field: n-gram weights, lexicon weights, transitions."""

    def __init__(self, langs: list[str], lexicon: np.ndarray):
        self.langs, self.lexicon = langs, lexicon.astype(np.float32)
        self.ngrams = np.zeros((NGRAMS, len(langs)), np.float32)
        self.lexicon_weight = np.ones(len(langs))
        self.transitions = np.eye(len(langs))

    def _types(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """N-grams and their number for each distinct word, its lexicon row, and each word's type."""
        _, of, kind = np.unique(words.hashes, return_index=True, return_inverse=True)
        grams, sizes = _ngrams(words, of)
        return grams, sizes, kind, of

    def _scores(self, grams, sizes, lexicon) -> np.ndarray:
        if not len(sizes):
            return np.zeros((0, len(self.langs)))
        starts = np.cumsum(sizes) - sizes
        return np.add.reduceat(self.ngrams[grams], starts, axis=0) / np.sqrt(sizes)[:, None] + lexicon * self.lexicon_weight

    def fit(self, texts: pa.Array, labels: np.ndarray, epochs: int = 6, chains: int = 128, seed: int = 5) -> None:
        words = words_of(texts)
        lower = words_of(texts, lower=True)
        grams, sizes, kind, of = self._types(words)
        starts = np.cumsum(sizes) - sizes
        lexicon = self.lexicon[_lexicon_buckets(lower.hashes[of])]
        rng, n = np.random.default_rng(seed), len(labels)
        squares = np.full(self.ngrams.shape, 1e-3, np.float32)
        t_squares, l_squares = np.full(self.transitions.shape, 1e-3), np.full(len(self.langs), 1e-3)
        order = np.arange(n)
        for _ in range(epochs):
            rng.shuffle(order)
            for low in range(0, n, chains):
                rows = order[low : low + chains]
                length = np.diff(words.first)[rows]
                mask = np.arange(length.max()) < length[:, None]
                at = np.where(mask, words.first[rows][:, None] + np.arange(length.max()), 0)
                types, inverse = np.unique(kind[at[mask]], return_inverse=True)
                own = np.repeat(starts[types] - (np.cumsum(sizes[types]) - sizes[types]), sizes[types]) + np.arange(sizes[types].sum())
                g, lex = grams[own], lexicon[types]
                emission = self._scores(g, sizes[types], lex)
                scores = np.zeros((*mask.shape, len(self.langs)))
                scores[mask] = emission[inverse]
                marginal, expected = forward_backward(scores, mask, self.transitions)
                gold = np.eye(len(self.langs))[labels[rows]]
                error = (gold[:, None, :] - marginal)[mask] / len(rows)
                by_type = np.zeros_like(emission)
                np.add.at(by_type, inverse, error)
                l_grad = (by_type * lex).sum(axis=0)
                t_grad = (gold * (length - 1)[:, None]).T @ gold / len(rows) - expected / len(rows) - 1e-3 * self.transitions
                spread = np.repeat(by_type / np.sqrt(sizes[types])[:, None], sizes[types], axis=0)
                touched, place = np.unique(g, return_inverse=True)
                w_grad = np.stack([np.bincount(place, spread[:, k], len(touched)) for k in range(len(self.langs))], axis=1) - 1e-4 * self.ngrams[touched]
                squares[touched] += w_grad**2
                self.ngrams[touched] += 0.3 * w_grad / np.sqrt(squares[touched])
                t_squares += t_grad**2
                self.transitions += 0.1 * t_grad / np.sqrt(t_squares)
                l_squares += l_grad**2
                self.lexicon_weight += 0.1 * l_grad / np.sqrt(l_squares)

    def label(self, texts: pa.Array) -> np.ndarray:
        """Sum of the label probabilities over each text's words with letters (texts x languages)."""
        words, out = words_of(texts), np.zeros((len(texts), len(self.langs)))
        if not len(words.hashes):
            return out
        lower = words_of(texts, lower=True)
        grams, sizes, kind, of = self._types(words)
        emission = self._scores(grams, sizes, self.lexicon[_lexicon_buckets(lower.hashes[of])])
        per_text = np.diff(words.first)
        lettered = np.logical_or.reduceat(LETTER[words.data], words.starts) if len(words.starts) else np.zeros(0, bool)
        order = np.argsort(per_text, kind="stable")
        order = order[per_text[order] > 0]
        cells, group = 0, []
        for k, text in enumerate(order):  # texts of like length, a bounded number of words at a time
            group.append(text)
            cells = len(group) * min(int(per_text[text]), STRETCH)
            if k + 1 < len(order) and cells + min(int(per_text[order[k + 1]]), STRETCH) <= CELLS:
                continue
            own, group = np.array(group), []
            first, lengths = words.first[:-1][own], per_text[own]

            def places(rows: np.ndarray, low: int, high: int) -> np.ndarray:
                return np.minimum(first[rows][:, None] + np.arange(low, high), (first + lengths - 1)[rows][:, None])

            for low, rows, mask, marginal in chain_marginals(lambda rows, low, high: emission[kind[places(rows, low, high)]], lengths, self.transitions):
                marginal[~(mask & lettered[places(rows, low, low + mask.shape[1])])] = 0
                out[own[rows]] += marginal.sum(axis=1)
        return out


LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_words: int = SAMPLE_WORDS) -> Field | None:
    """The field learned from documents with a language outside fold 0 of 5."""
    training = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where(
        (fold(F.col("doc_id"), 5) != 0) & F.col("lang").isNotNull() & (F.col("lang") != "") & F.col("text").isNotNull())
    langs = sorted(r["lang"] for r in training.select("lang").distinct().collect())
    if not langs:
        return None
    lexicon = _lexicon(training, langs)
    chosen = None
    for lang in langs:  # the first documents of each language in hash order
        some = training.where(F.col("lang") == lang).select(F.col("doc_id").alias("__id"), F.col("lang").alias("__lang")).orderBy(F.xxhash64("__id"), "__id").limit(sample_docs)
        chosen = some if chosen is None else chosen.union(some)
    picked = training.join(F.broadcast(chosen), (F.col("doc_id") == F.col("__id")) & (F.col("lang") == F.col("__lang")), "left_semi")
    once = picked.groupBy("doc_id", "lang").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = once.select("text", "lang").mapInArrow(_sample(sample_words), "lang string, text string").toArrow().sort_by([("lang", "ascending"), ("text", "ascending")])
    field = Field(langs, lexicon)
    if rows.num_rows:
        index = {lang: k for k, lang in enumerate(langs)}
        field.fit(rows["text"].combine_chunks(), np.array([index[x] for x in rows["lang"].to_pylist()]))
    return field


def identify(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_words: int = SAMPLE_WORDS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document."""
    field = learn(docs, sample_docs, sample_words)

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most_bytes=1 << 21):
            texts = batch["text"]
            if field is None:
                pred, score = ["und"] * len(texts), np.zeros(len(texts))
            else:
                sums = field.label(texts)
                total = sums.sum(axis=1)
                best = sums.argmax(axis=1)
                known = np.array([bool(n) and _has_letter(t.as_py()) for n, t in zip(total, texts)], bool)
                pred = [field.langs[k] if ok else "und" for k, ok in zip(best, known)]
                score = np.where(known, sums.max(axis=1) / np.maximum(total, 1e-9), 0.0)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(pred, pa.string()), pa.array(np.clip(score, 0, 1))], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "text")
    return rows.mapInArrow(labelled, "doc_id long, held_out boolean, lang_pred string, score double")
