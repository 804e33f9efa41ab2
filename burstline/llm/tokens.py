"""Token ids by the `tokenizers` library, with each distinct run of letters or marks encoded once a worker.

Texts of plain characters alone (printable ASCII without apostrophes, Latin-1 letters) are cut in bulk as the
vocabulary file cuts them: runs of letters, single digits, runs of other marks. Each distinct run goes through
the library's own BPE model and its ids are kept. Any other text goes through the library word by word: its
rules never match across ASCII white space, which is dropped, NFC doesn't compose with it, and no added token
holds any, so a text's ids are those of its words in turn.

A run is known by two independent 64-bit hashes. Where only one of them agrees the texts go word by word, so a wrong id needs two different runs
that agree in 128 bits.
"""

from __future__ import annotations

import os
from array import array

import numpy as np

from burstline.llm.common import chunks, word_hashes

_LETTER, _DIGIT, _MARK, _BLANK = 1, 2, 3, 0
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = _MARK
_KIND[0x30:0x3A] = _DIGIT
for _a, _b in ((0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    _KIND[_a:_b] = _LETTER
_ODD = np.ones(256, bool)  # bytes that a plain text doesn't have
_ODD[0x20:0x7F] = _ODD[0x09:0x0E] = False
_ODD[0x27] = True
_RUNS = 1_500_000  # runs kept before the store starts anew


def _byte_alphabet() -> list[str]:
    """The printable stand-in for each byte that byte-level vocabularies use."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.stand_in = _byte_alphabet()
        self._forget()
        self.plain = self._is_checked()

    def _forget(self) -> None:
        self.known, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.at, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.words: dict[bytes, np.ndarray] = {}

    def _is_checked(self) -> bool:
        """Whether plain texts may be cut in bulk: tried on samples, as another vocabulary may have other rules."""
        samples = ["Abc wordlike ÜBER naïve, stop!!", "a| x&&& été. q(e)\nNDANSH!! Ça## 1234 a1b2", "<x> ß ÿ \t\f\v ~", ""]
        raw = [s.encode() for s in samples]
        made = self._bulk(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        if made is None:
            return False
        ids, at = made
        return np.array_equal(ids, np.concatenate([self._whole(s) for s in samples])) and len(at) == len(raw) + 1

    def _whole(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _by_word(self, text: bytes) -> np.ndarray:
        parts = [np.zeros(0, np.uint32)]
        for word in text.split():
            ids = self.words.get(word)
            if ids is None:
                if len(self.words) > _RUNS // 20:
                    self.words.clear()
                ids = self.words[word] = self._whole(word.decode("utf-8", "replace"))
            parts.append(ids)
        return np.concatenate(parts)

    def _learn(self, raw, starts, ends, hashes, checks) -> None:
        """Encode runs met for the first time."""
        if len(self.known) + len(hashes) > _RUNS:
            self.known, self.check, self.at, self.n = self.known[:0], self.check[:0], self.at[:0], self.n[:0]
            self.used = 0
        data, tokenize, new, n = raw.tobytes(), self.tokenizer.model.tokenize, array("I"), []
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            run = data[a:b]
            run = run.decode() if run.isascii() else "".join([self.stand_in[x] for x in run])
            ids = [t.id for t in tokenize(run)]
            new.extend(ids)
            n.append(len(ids))
        if self.used + len(new) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(self.used + 2 * len(new), np.uint32)])
        self.pool[self.used : self.used + len(new)] = np.frombuffer(new, np.uint32) if new else 0
        n = np.asarray(n, np.int64)
        at = self.used + np.cumsum(n) - n
        self.used += len(new)
        place = np.searchsorted(self.known, hashes)
        self.known, self.check, self.at, self.n = (np.insert(old, place, more) for old, more in ((self.known, hashes), (self.check, checks), (self.at, at), (self.n, n)))

    def _bulk(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of plain texts, and where each text's begin; None where two different runs have one hash."""
        low = raw.copy()
        low[(raw >= 0x41) & (raw <= 0x5A)] |= 0x20
        second = np.flatnonzero(raw == 0xC3) + 1
        second = second[second < len(raw)]
        upper = second[(raw[second] >= 0x80) & (raw[second] <= 0x9E)]
        low[upper] += 0x20
        kind = _KIND[raw]
        first = kind != _BLANK
        same = (kind[1:] == kind[:-1]) & (kind[1:] != _DIGIT)
        head = first.copy()
        head[1:] &= ~same
        head[offsets[offsets < len(raw)]] |= first[offsets[offsets < len(raw)]]
        starts = np.flatnonzero(head)
        # A run ends where the next begins, or at the first blank after it.
        blank = np.flatnonzero(~first)
        ends = np.append(starts[1:], len(raw))
        if len(blank):
            i = np.searchsorted(blank, starts)
            ends = np.minimum(ends, np.append(blank, len(raw))[i])
        hashes, checks = word_hashes(low, starts, ends), word_hashes(low, starts, ends, 1)
        distinct, some, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, distinct)
        seen = np.zeros(len(distinct), bool)
        inner = place < len(self.known)
        seen[inner] = self.known[place[inner]] == distinct[inner]
        if not seen.all():
            if len(self.known) + int((~seen).sum()) > _RUNS:
                seen[:] = False
            new = some[~seen]
            self._learn(low, starts[new], ends[new], distinct[~seen], checks[new])
            place = np.searchsorted(self.known, distinct)
        place = place[inverse]
        if not np.array_equal(self.check[place], checks):
            return None
        n = self.n[place]
        stop = np.cumsum(n)
        ids = self.pool[np.repeat(self.at[place] - (stop - n), n) + np.arange(stop[-1] if len(stop) else 0)]
        return ids, np.append(0, stop)[np.searchsorted(starts, offsets)]

    def encode(self, raw: np.ndarray, offsets: np.ndarray):
        """Yields (number of the first text, ids, where each text's begin and the last's end) for runs of texts."""
        for i, j in chunks(offsets):
            part, at = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            odd = _ODD[part]
            pair = np.flatnonzero(part == 0xC3)
            pair = pair[pair + 1 < len(part)]
            pair = pair[(part[pair + 1] != 0x97) & (part[pair + 1] != 0xB7)]
            odd[pair] = odd[pair + 1] = False
            odd[:-1] |= (part[:-1] == 0x3C) & (part[1:] == 0x7C)  # an added token may begin
            odd = np.append(0, np.cumsum(odd))
            other = np.flatnonzero((odd[at[1:]] > odd[at[:-1]]) | (not self.plain))
            made = np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
            if len(other) < j - i:
                rest = part
                if len(other):
                    rest = part.copy()
                    for k in other.tolist():
                        rest[at[k] : at[k + 1]] = 0x20
                made = self._bulk(rest, at)
            if made is None:
                other = np.arange(j - i)
            if not len(other):
                yield i, *made
                continue
            texts = {k: self._by_word(part[at[k] : at[k + 1]].tobytes()) for k in other.tolist()}
            parts = [texts[k] if k in texts else made[0][made[1][k] : made[1][k + 1]] for k in range(j - i)]
            yield i, np.concatenate(parts), np.cumsum([0, *map(len, parts)])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each file and worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
