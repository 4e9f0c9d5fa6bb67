"""Token ids of whole texts by a public tokenizer, with the pieces between spaces remembered."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence
from itertools import chain, repeat

import numpy as np

#: The characters that the tokenizers' patterns take as white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
MARK = "<|endoftext|>"
#: Letters of the languages met most; a run of them in front of an ASCII non-letter is a piece.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
SLICE_CHARS = 2_000_000
MOST_KEPT = 600_000
MOST_IDS_KEPT = 4_000_000
MISSES_AT_ONCE = 20_000


class Encoder:
    """Encodes texts exactly as ``Tokenizer.encode(text, add_special_tokens=False)``.

    Both tokenizers cut a text in front of each run of white space before they
    merge, and behind each run of letters, so a text's ids are those of such
    pieces one after the other.  The ids of pieces seen are kept in a
    table; when it holds over MOST_KEPT pieces, those met once are dropped.
    New pieces of letters go to the tokenizer's merges directly, others are
    encoded many at a call, parted by the tokenizer's own end mark.

    ``spaces``: white space yields ids (byte-level tokenizers) or is dropped.
    """

    def __init__(self, path: str, spaces: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self.tokenizer.token_to_id(MARK)
        before = f"[{WHITE}]*" if spaces else ""
        self.spaces = spaces
        self.pieces = re.compile(rf"{before}[{LETTERS}]+(?=[\x00-@\[-`{{-\x7f]|$)|{before}[^{WHITE}]+" + (f"|[{WHITE}]+" if spaces else ""))
        self.letters = re.compile(f" ?[{LETTERS}]+")
        #: Byte-level tokenizers write each byte as a character: printable Latin-1 as itself, the others from U+0100 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        table = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.bytes_of = {c: "".join(table[b] for b in chr(c).encode()) for c in range(256)}
        self.cut = re.compile(f"(?<=[^{WHITE}])[{WHITE}]")
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.first = np.zeros(1 << 12, np.int64)
        self.size = np.zeros(1 << 12, np.int32)
        self.met = np.zeros(1 << 12, np.int32)
        self.n_ids = 0

    def _drop_rare(self) -> None:
        place, flat, first, size, met = self.place, self.flat, self.first, self.size, self.met
        least = max(2, int(np.median(met[: len(place)])) + 1)
        kept = [(w, k) for w, k in place.items() if met[k] >= least]
        self.forget()
        if kept:
            words, at = zip(*kept)
            at = np.array(at)
            ids = np.concatenate([flat[a : a + n] for a, n in zip(first[at].tolist(), size[at].tolist())])
            self._add(words, ids, size[at])

    def _add(self, words: Sequence[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, at = len(words), len(self.place)
        while at + n > len(self.first):
            self.first, self.size, self.met = (np.resize(x, 2 * len(x)) for x in (self.first, self.size, self.met))
        while self.n_ids + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.n_ids : self.n_ids + len(ids)] = ids
        self.first[at : at + n] = self.n_ids + np.cumsum(sizes) - sizes
        self.size[at : at + n] = sizes
        self.met[at : at + n] = 0
        self.n_ids += len(ids)
        self.place.update(zip(words, range(at, at + n)))

    def _learn(self, words: list[str]) -> None:
        letters = self.letters.fullmatch
        simple = [w for w in words if letters(w)]  # one unit for the tokenizer's merges
        if simple:
            tokenize, bytes_of = self.tokenizer.model.tokenize, self.bytes_of
            found = [[t.id for t in tokenize((w if self.spaces else w.lower()).translate(bytes_of))] for w in simple]
            sizes = np.fromiter(map(len, found), np.int32, len(found))
            self._add(simple, np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum())), sizes)
        plain = [w for w in words if "<|" not in w and not letters(w)]
        for k in range(0, len(plain), MISSES_AT_ONCE):
            some = plain[k : k + MISSES_AT_ONCE]
            ids = np.array(self.tokenizer.encode(MARK.join(some), add_special_tokens=False).ids, np.int32)
            marks = np.flatnonzero(ids == self.mark)
            ends = np.concatenate([marks, [len(ids)]])
            sizes = np.diff(np.concatenate([[-1], ends])) - 1
            self._add(some, ids[ids != self.mark], sizes.astype(np.int32))
        for w in words:
            if "<|" in w:
                ids = np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, np.int32)
                self._add([w], ids, np.array([len(ids)], np.int32))

    def _of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after the other, and each word's number of ids."""
        if len(self.place) > MOST_KEPT or self.n_ids > MOST_IDS_KEPT:
            self._drop_rare()
        at = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(at < 0).tolist()
        if new:
            self._learn(sorted({words[k] for k in new}))
            at[new] = [self.place[words[k]] for k in new]
        self.met[: len(self.place)] += np.bincount(at, minlength=len(self.place)).astype(np.int32)
        sizes = self.size[at].astype(np.int64)
        ends = np.cumsum(sizes)
        where = np.repeat(self.first[at] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        ids = self.flat[where]
        return ids, sizes

    def _parts(self, text: str) -> Iterator[str]:
        """The text, cut in front of white space into parts of about SLICE_CHARS."""
        start = 0
        while len(text) - start > SLICE_CHARS:
            m = self.cut.search(text, start + SLICE_CHARS)
            if not m:
                break
            yield text[start : m.start()]
            start = m.start()
        yield text[start:] if start else text

    def encode(self, texts: Sequence[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text in turn (null: none)."""
        words: list[str] = []
        counts: list[int] = []
        chars = 0
        for text in texts:
            if text and len(text) > SLICE_CHARS:
                yield from self._split(words, counts)
                words, counts, chars = [], [], 0
                yield np.concatenate([self._of(self.pieces.findall(p))[0] for p in self._parts(text)])
                continue
            found = self.pieces.findall(text) if text else []
            words += found
            counts.append(len(found))
            chars += len(text) if text else 0
            if chars > SLICE_CHARS:
                yield from self._split(words, counts)
                words, counts, chars = [], [], 0
        yield from self._split(words, counts)

    def _split(self, words: list[str], counts: list[int]) -> Iterator[np.ndarray]:
        if not counts:
            return
        ids, sizes = self._of(words)
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(counts)]
        yield from np.split(ids, ends[:-1])


def encoder(path: str, spaces: bool) -> Encoder:
    """This process's encoder: a worker keeps it, with the pieces it knows, from task to task.

    It is kept with the tokenizers library, since functions of this package
    arrive by value with each task and their module's names end with it.
    """
    import tokenizers

    kept = tokenizers.__dict__.setdefault("kept_encoders", {})
    if (path, spaces) not in kept:
        kept[path, spaces] = Encoder(path, spaces)
    return kept[path, spaces]
