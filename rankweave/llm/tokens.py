"""Token ids of whole texts under a byte-level BPE vocabulary, from caches in the workers.

The vocabulary's splitting pattern attaches one space to the word that follows it and never crosses from a word
into a later space, so a text without doubled, leading or trailing spaces is encoded word by word: each word with its
space gives the same ids wherever it stands. A table of frequent words answers first, then a bounded cache that
encodes each missing word once. Texts to which the rule doesn't apply go to the library whole. No word is shuffled.
"""

from __future__ import annotations

import base64
import os
import re

VOCABULARY = "byte_bpe_50k.json"
#: Words that a worker remembers before it starts anew.
CACHE_SIZE = 500_000
#: Longest word that a cache keeps, in characters.
MAX_KEY = 48

SPECIAL = "<|endoftext|>"
#: Beyond ASCII, characters on which both tokenizer libraries agree for sure.
odd = re.compile("[^\t\n\r\x20-\x7e¡-¬®-ɏ‐-‧€]").search


def vocabulary_path(name: str) -> str:
    """An absolute path as it is, a bare name as the installed package has it on this machine."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def library(vocabulary: str):
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(vocabulary_path(vocabulary))
    out.no_padding()
    out.no_truncation()
    return out


def word_encoder(vocabulary: str):
    """text -> ids, by the rank file of the same vocabulary: several times faster on short strings."""
    import public_tokenizers
    import tiktoken

    path = vocabulary_path(vocabulary).removesuffix(".json") + ".tiktoken"
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class Words(dict):
    """word -> value(ids of the word after a space); a missing word is encoded once and kept."""

    def __init__(self, vocabulary: str, value, known: dict | None = None, cache_size: int = CACHE_SIZE):
        super().__init__(known or {})
        self.known, self.limit = dict(known or {}), len(known or {}) + cache_size
        self.library, self.encode, self.value = library(vocabulary), word_encoder(vocabulary), value

    def __missing__(self, word: str):
        out = self.value(self.encode(" " + word))
        if len(word) <= MAX_KEY:
            if len(self) >= self.limit:
                self.clear()
                self.update(self.known)
            self[word] = out
        return out

    def values_of(self, text: str) -> list:
        """The values of consecutive pieces that together are the text."""
        if not text:
            return []
        if "  " in text or text[0] == " " or text[-1] == " " or SPECIAL in text or (odd(text) is not None):
            return [self.value(self.library.encode(text, add_special_tokens=False).ids)]
        first, *rest = text.split(" ")
        return [self.value(self.encode(first)), *map(self.__getitem__, rest)]
