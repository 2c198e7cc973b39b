"""Token ids of texts, word by word, with the tokenizers library.

The word-level BPE vocabulary drops white space and never merges across it, so a text's ids are
those of its white-space-separated words in a row. Each Python worker keeps the ids of words it
has met, which spares most of the encoding.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np

#: Letters (ASCII and Latin-1) and then ASCII punctuation but the apostrophe: the pre-tokenizer
#: cuts such a word in just these two parts, and its normalizer does no more than lower-case it.
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-@\\[-`{-~]*)")
#: Words kept per worker, about 250 bytes each.
CACHE_WORDS = 700_000
#: Texts are prepared together up to so many bytes.
BLOCK_BYTES = 1 << 18
_LETTER, _MARK = 1, 2
_KINDS = np.zeros(256, np.uint8)
_KINDS[ord("a") : ord("z") + 1] = _LETTER
_KINDS[[b for b in range(33, 127) if not chr(b).isalnum()]] = _MARK


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """``encode`` gives the ids of a text as little-endian unsigned 32-bit integers, ``encode_all`` those of many."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.special = [t.content.encode().lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words: dict[bytes, bytes] = {}

    def _part(self, part: str) -> bytes:
        if not part.isascii():
            part = "".join([self.letters[b] for b in part.encode()])
        return array("I", [t.id for t in self.model.tokenize(part)]).tobytes()

    def _known(self, part: str) -> bytes:
        """The ids of letters in lower case or of marks."""
        key = part.encode()
        ids = self.words.get(key)
        if ids is None:
            ids = self.words[key] = self._part(part)
        return ids

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        if word.isalpha():  # ASCII letters
            return self._part(text) if word.islower() else self._known(text.lower())
        plain = PLAIN.fullmatch(text)
        if not plain:
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        letters, marks = plain.groups()
        lower = letters.lower()
        if lower + marks == text and not (letters and marks):
            return self._part(text)
        return (self._known(lower) if letters else b"") + (self._known(marks) if marks else b"")

    def _as_it_is(self, lower: bytes) -> bool:
        """Whether a text must keep its capitals and words: combining marks (U+0300 to U+036F) compose with some small letters
        and not with their capitals, and special tokens are looked for before anything else."""
        return b"\xcc" in lower or b"\xcd" in lower or any(t in lower for t in self.special)

    @staticmethod
    def _parted(texts: list[bytes]) -> list[bytes]:
        """Lower-case texts with a space wherever an ASCII mark follows an ASCII or Latin-1 letter: the pre-tokenizer cuts there anyway."""
        data = b" ".join(texts)
        codes = np.frombuffer(data, np.uint8)
        kinds = _KINDS[codes]
        letter = kinds == _LETTER
        if b"\xc3" in data:  # begins Latin-1 letters, the signs for times and divided by among them
            letter[1:] |= (codes[:-1] == 0xC3) & (codes[1:] != 0x97) & (codes[1:] != 0xB7)
        cuts = np.flatnonzero(letter[:-1] & (kinds[1:] == _MARK)) + 1
        ends = np.cumsum([len(t) + 1 for t in texts])
        spread, at = np.insert(codes, cuts, 32).tobytes(), (ends + np.searchsorted(cuts, ends)).tolist()
        return [spread[a:b] for a, b in zip([0, *at], at)]

    def _ids(self, words: list[bytes]) -> bytes:
        known = self.words
        found = list(map(known.get, words))
        if None in found:
            if len(known) > CACHE_WORDS:
                known.clear()
            for i in [i for i, ids in enumerate(found) if ids is None]:
                w = words[i]
                ids = known.get(w)
                found[i] = known[w] = self._word(w) if ids is None else ids
        return b"".join(found)

    def encode(self, text: str | None) -> bytes:
        return next(self.encode_all([text]))

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text; many texts at once take less time than one by one."""
        block, kept, size = [], {}, 0
        for text in texts:
            raw = (text or "").encode()
            lower = raw.lower()
            if self._as_it_is(lower):
                kept[len(block)], lower = raw, b""
            block.append(lower)
            size += len(raw)
            if size >= BLOCK_BYTES:
                yield from self._block(block, kept)
                block, kept, size = [], {}, 0
        if block:
            yield from self._block(block, kept)

    def _block(self, block: list[bytes], kept: dict[int, bytes]) -> Iterator[bytes]:
        for i, text in enumerate(self._parted(block)):
            yield self._ids(kept.get(i, text).split())


_encoders: dict[str, WordEncoder] = {}


def encoder(vocabulary: str) -> WordEncoder:
    """The encoder of this Python process, kept from task to task."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = WordEncoder(vocabulary)
    return _encoders[vocabulary]


def release() -> None:
    """Forget what this Python process has kept: workers go on to the tasks of other operators, which need the memory."""
    _encoders.clear()
