"""Token ids of whole texts, by a public tokenizer file and the tokenizers library.

The library spends most of its time on words it has met before. The vocabulary used here
never joins text over white space, so a text's ids are those of its words, one after
another. `Encoder` asks the library for each distinct word once and keeps the answers, at
most `keep` of them per Python worker, in numpy arrays found by 64-bit word hashes; when
they are full, words that were not met again go and are asked for anew if they come back.
`tests/llm/test_tokens.py` holds it against the library's own whole-text encoding.
"""

from __future__ import annotations

import functools
import os
import unicodedata

import numpy as np

from seriesweave.llm.words import Words, batches, give_back, words

RUN = 200_000  # characters encoded at once; a longer text is a run of its own
KEEP = 500_000  # words that a worker keeps: with their ids about 25 MB
#: Letters followed by one of these are two pre-tokens, whatever the letters are.
_TAILS = np.zeros(256, dtype=bool)
_TAILS[list(b".,;:!?")] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[list(b"abcdefghijklmnopqrstuvwxyz")] = True
_LETTER[128:] = True


def default_tokenizer() -> str:
    """Place of the tokenizer file the queries use; it is the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of texts, as arrays of unsigned 32-bit integers."""

    def __init__(self, path: str, keep: int = KEEP):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.keep = keep
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closing = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.closing[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self.size = 1 << (2 * keep - 1).bit_length()
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(self.size, dtype=np.uint64)  # open addressing; 0 is free
        self.slots = np.zeros(self.size, dtype=np.int32)
        self.count = 0
        self.at = np.zeros(1024, dtype=np.uint32)
        self.length = np.zeros(1024, dtype=np.uint32)
        self.again = np.zeros(1024, dtype=bool)  # met after the run that brought it
        self.ids = np.zeros(4096, dtype=np.min_scalar_type(len(self.closing) - 1))
        self.used = 0

    def _forget_rare(self) -> None:
        """Keep only the words that were met again since the last time."""
        slot = np.flatnonzero(self.keys)
        slot = slot[self.again[self.slots[slot]]]
        hashes, numbers = self.keys[slot], self.slots[slot]
        ids, lengths = self._gather(numbers)
        self._forget()
        self._add(hashes, lengths, ids)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each known word, -1 of others."""
        found = np.full(len(hashes), -1, dtype=np.int64)
        mask = np.uint64(self.size - 1)
        left, slot = np.arange(len(hashes)), hashes & mask
        while len(left):
            keys = self.keys[slot]
            hit = keys == hashes[left]
            found[left[hit]] = self.slots[slot[hit]]
            on = ~hit & (keys != 0)
            left, slot = left[on], (slot[on] + np.uint64(1)) & mask
        return found

    def _add(self, hashes: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        """Keep new, distinct words; ids holds those of one word after another."""
        n = len(hashes)
        while self.count + n > len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
            self.length = np.concatenate([self.length, np.zeros_like(self.length)])
            self.again = np.concatenate([self.again, np.zeros_like(self.again)])
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.at[self.count : self.count + n] = self.used + np.cumsum(lengths) - lengths
        self.length[self.count : self.count + n] = lengths
        self.ids[self.used : self.used + len(ids)] = ids
        mask = np.uint64(self.size - 1)
        left, slot = np.arange(n), hashes & mask
        while len(left):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = hashes[left[free]]
            won = free & (self.keys[slot] == hashes[left])
            self.slots[slot[won]] = self.count + left[won]
            left, slot = left[~won], (slot[~won] + np.uint64(1)) & mask
        self.count += n
        self.used += len(ids)

    def _gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of known words one after another, and how many each has."""
        lengths = self.length[numbers].astype(np.int64)
        ends = np.cumsum(lengths)
        place = np.repeat(self.at[numbers] - (ends - lengths), lengths)
        return self.ids[place + np.arange(len(place))].astype(np.uint32), lengths

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for at in range(0, len(texts), 1000):  # the library's answers take far more memory than the ids
            found = [x.ids for x in self.tokenizer.encode_batch_fast(texts[at : at + 1000], add_special_tokens=False)]
            ids.append(np.array([i for x in found for i in x], dtype=np.uint32))
            lengths.append(np.array([len(x) for x in found], dtype=np.int64))
        return np.concatenate(ids), np.concatenate(lengths)

    def _letters(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As _encode, for words of letters only: many in one call, as each ends in one closing token."""
        ids, lengths = [], []
        for at in range(0, len(texts), 500):
            part = texts[at : at + 500]
            got = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, dtype=np.uint32)
            stops = np.flatnonzero(self.closing[got]) + 1
            if len(stops) == len(part) and stops[-1] == len(got):
                counts = np.diff(stops, prepend=0)
            else:
                got, counts = self._encode(part)
            ids.append(got)
            lengths.append(counts)
        return (np.concatenate(ids), np.concatenate(lengths)) if ids else (np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def _learn(self, w: Words, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> None:
        """Keep the distinct new words among these spans."""
        hashes, pick = np.unique(hashes, return_index=True)
        starts, ends = starts[pick], ends[pick]
        buffer = np.frombuffer(w.data, dtype=np.uint8)
        within = np.concatenate([[0], np.cumsum(~_LETTER[buffer])])
        tailed = _TAILS[buffer[ends - 1]] & (ends - starts > 1) & (within[ends - 1] == within[starts])
        wide = np.concatenate([[0], np.cumsum(buffer > 127)])
        for i in np.flatnonzero(tailed & (wide[ends] > wide[starts])).tolist():
            # Some letters normalise to a letter and a mark, which would join the punctuation.
            tailed[i] = unicodedata.normalize("NFC", w.data[starts[i] : ends[i] - 1].decode()).lower().isalpha()
        if tailed.any():
            first, last = starts[tailed], ends[tailed] - 1
            cores = w.hashes(first, last)
            unknown = (self._find(cores) < 0) & ~np.isin(cores, hashes)
            cores, pick = np.unique(cores[unknown], return_index=True)
            hashes = np.concatenate([hashes, cores])
            starts, ends = np.concatenate([starts, first[unknown][pick]]), np.concatenate([ends, last[unknown][pick]])
            tailed = np.concatenate([tailed, np.zeros(len(cores), dtype=bool)])
        rest = np.flatnonzero(~tailed)
        spans = [w.data[a:b].decode() for a, b in zip(starts[rest].tolist(), ends[rest].tolist())]
        plain = within[ends[rest]] == within[starts[rest]]
        plain &= np.fromiter((x.isalpha() for x in spans), dtype=bool, count=len(spans))
        for chosen, encode in ((plain, self._letters), (~plain, self._encode)):
            if chosen.any():
                ids, lengths = encode([spans[i] for i in np.flatnonzero(chosen)])
                self._add(hashes[rest[chosen]], lengths, ids)
        if tailed.any():
            ids, lengths = self._gather(self._find(w.hashes(starts[tailed], ends[tailed] - 1)))
            marks = buffer[ends[tailed] - 1]
            kinds = np.unique(marks)
            of = {k: self._encode([chr(k)])[0] for k in kinds.tolist()}
            if any(len(x) != 1 for x in of.values()):
                raise ValueError("a punctuation mark is expected to be one id")
            table = np.zeros(256, dtype=np.uint32)
            for k, x in of.items():
                table[k] = x[0]
            self._add(hashes[tailed], lengths + 1, np.insert(ids, np.cumsum(lengths), table[marks]))

    def _batch(self, texts: list[str | None]) -> list[np.ndarray]:
        # Special tokens are matched before lower-casing, so a batch that may hold one keeps its case.
        w = words(texts, lower=not any(text and "<|" in text for text in texts))
        hashes = w.hashes(w.starts, w.ends)
        numbers = self._find(hashes)
        new = numbers < 0
        self.again[numbers[~new]] = True
        if new.any():
            if self.count + 2 * len(np.unique(hashes[new])) > self.keep:
                self._forget_rare()  # the words of this run that were known have been met again
                if self.count + 2 * len(np.unique(hashes[new])) > self.keep // 2:  # else rare words would be sought out at every run
                    self._forget()
                    new[:] = True
                    if 2 * len(np.unique(hashes)) > self.keep:  # more words in one text than are kept
                        return [self._encode([text or ""])[0] for text in texts]
            self._learn(w, w.starts[new], w.ends[new], hashes[new])
            numbers = self._find(hashes)
        ids, lengths = self._gather(numbers)
        ends = np.concatenate([[0], np.cumsum(lengths)])[w.first]
        return [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; a null text is an empty one."""
        return [ids for a, b in batches(texts, RUN) for ids in self._batch(texts[a:b])]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker and file."""
    return Encoder(path)


def release() -> None:
    """Forget encoders and their words; for a worker that goes on to another operator."""
    if encoder.cache_info().currsize:
        encoder.cache_clear()
        give_back()
