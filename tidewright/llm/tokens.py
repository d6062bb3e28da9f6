"""Token ids word by word.

The vocabulary's own splitting never joins what white space separates, so a text's ids are the ids of its words one after
another, and a word is encoded once per worker, not once per occurrence.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable, Iterator

from tidewright.llm.worker import claim

#: Words held per worker; a full cache is emptied, which costs time but changes nothing. Characters split at once.
CACHE, CHUNK = 1_000_000, 2_000_000
#: Python's split() takes these as white space, the vocabulary does not.
ODD = "\x1c\x1d\x1e\x1f"
#: Without these no lower-casing of the text can change what the vocabulary's normalisation composes.
DELICATE = re.compile("[\u0130\u0250-\U0010ffff]")

#: A stop or comma behind a letter and before white space is a piece of its own, so the two may be split.
STOP = re.compile("[.,](?<=[a-z\u00df-\u00f6\u00f8-\u00ff].)(?=[\\x20\\x09-\\x0D])")


def words(text: str) -> list[str]:
    if text.isascii() or not DELICATE.search(text):
        text = STOP.sub(r" \g<0>", text.lower())
    if any(c in text for c in ODD):
        return [w for w in text.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    return text.split()


class IdCache(dict):
    """word -> its ids as little-endian 32-bit bytes."""

    _shared: dict = {}

    def __init__(self, vocabulary: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__()
        self.limit = CACHE
        self.tokenizer = Tokenizer.from_file(vocabulary)

    @classmethod
    def shared(cls, vocabulary: str | None = None) -> IdCache:
        if vocabulary is None:
            import public_tokenizers

            vocabulary = str(public_tokenizers.path("word_bpe_49k.json"))
        if vocabulary not in cls._shared:
            cls._shared[vocabulary] = cls(vocabulary)
        claim("tokens", cls._shared[vocabulary])
        return cls._shared[vocabulary]

    @staticmethod
    def parts(word: str) -> tuple[str, str]:
        """(core, end): a stop or comma behind a letter is a piece of its own."""
        if word[-1] in ".," and word[-2:-1].isalpha() and not DELICATE.match(word[-2]):
            return word[:-1], word[-1]
        return word, ""

    def learn(self, new: set[str]) -> None:
        split = {w: self.parts(w) for w in new}
        todo = list({p for ps in split.values() for p in ps if p and p not in self})
        for w, e in zip(todo, self.tokenizer.encode_batch_fast(todo, add_special_tokens=False), strict=True):
            self[w] = array("I", e.ids).tobytes()
        for w, (core, end) in split.items():
            self[w] = self[core] + self[end] if end else self[core]

    def encode_many(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text, in order."""
        held: list[list[str]] = []
        size = 0
        for t in texts:
            held.append(words(t))
            size += len(t)
            if size >= CHUNK:
                yield from self._encode(held)
                held, size = [], 0
        yield from self._encode(held)

    def _encode(self, lists: list[list[str]]) -> Iterator[bytes]:
        if len(self) > self.limit:
            self.clear()
        new = set().union(*lists).difference(self)
        if new:
            self.learn(new)
        for ws in lists:
            yield b"".join(map(self.__getitem__, ws))

    def encode(self, text: str) -> bytes:
        return next(self.encode_many([text]))
