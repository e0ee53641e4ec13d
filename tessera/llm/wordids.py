"""Token ids of whole texts, word by word, for a tokenizer whose normalizer and
pre-tokenizer never look across white space (``word_bpe_49k.json``: NFC, lower
case, white space dropped). A text's ids are then those of its words in a row,
and a worker keeps the ids of words it has met."""

from __future__ import annotations

from array import array
from functools import lru_cache

import numpy as np

#: A worker keeps the words it met last and those before them, so many each (about
#: 60 MB in all); older ones are found anew. Ids don't depend on it.
KEPT_WORDS = 150_000
#: "word," is "word" and ",": a letter or digit ends a piece of the pre-tokenizer.
_POINTS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_ENDS = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


class WordEncoder(dict):
    """Lower-cased word (UTF-8) to its ids in bytes, found when first asked for."""

    def __init__(self, path: str, kept: int | None = None):
        from tokenizers import Tokenizer
        self.one = Tokenizer.from_file(path)
        self.tokenize = self.one.model.tokenize
        self.marks = {t.content.encode().lower()[:2] for t in self.one.get_added_tokens_decoder().values()}
        self.code, self.kind = ("H", np.dtype("<u2")) if self.one.get_vocab_size() <= 1 << 16 else ("I", np.dtype("<u4"))
        self.letters = dict(enumerate(_byte_letters()))
        self.before: dict[bytes, bytes] = {}
        self.kept = kept or KEPT_WORDS

    def __missing__(self, word: bytes) -> bytes:
        if (got := self.before.pop(word, None)) is not None:
            self[word] = got
            return got
        if word.isalpha():  # ASCII letters: one piece
            got = array(self.code, [t.id for t in self.tokenize(word.decode())]).tobytes()
        elif (core := word.rstrip(_POINTS)) != word and core and core[-1] in _ENDS:
            got = self[core] + self[word[len(core) :]]
        else:
            whole = word.decode()
            w = whole.lower() if max(whole) < "\u0250" else ""
            if w.isalpha():  # one piece, and its own NFC
                got = array(self.code, [t.id for t in self.tokenize(w.encode().decode("latin-1").translate(self.letters))]).tobytes()
            else:
                got = array(self.code, self.one.encode(whole, add_special_tokens=False).ids).tobytes()
        self[word] = got
        return got

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each UTF-8 text, as encode(text, add_special_tokens=False) gives them."""
        out = []
        for t in texts:
            if len(self) > self.kept:
                self.before = dict(self)
                self.clear()
            low = t.lower()
            if any(m in low for m in self.marks):
                out.append(np.array(self.one.encode(t.decode(), add_special_tokens=False).ids, self.kind))
            else:
                out.append(np.frombuffer(b"".join(map(self.__getitem__, low.split())), self.kind))
        return out


@lru_cache(maxsize=2)
def encoder(path: str, kept: int | None = None) -> WordEncoder:
    return WordEncoder(path, kept)
