"""Token ids of a public tokenizer, with a bounded cache of words.

The tokenizer drops white space and never joins characters across it, so the ids of a text are those
of its words (runs without ASCII white space) one after another; each distinct word goes through the
tokenizers library once for each worker. A test compares this with the library on whole texts.
"""

from __future__ import annotations

import os

import numpy as np

#: Words kept by a worker; beyond it the cache starts anew.
CACHE_WORDS = 2_000_000
#: Bytes of texts whose new words are encoded together.
SLICE_BYTES = 1 << 20
#: ASCII characters that are neither letters, digits nor white space.
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_made: dict[str, "WordTokenizer"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """ids(text): little-endian unsigned 16-bit ids (32-bit if the vocabulary needs it) as bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.cache: dict[bytes, bytes] = {}
        mark = self.tokenizer.encode("\0", add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None

    def _one(self, word: bytes) -> bytes:
        return np.array(self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids, self.dtype).tobytes()

    def _many(self, words: list[bytes]) -> None:
        """Words without NUL in one call, NUL as a word between them: its one id marks the ends."""
        text = b" \0 ".join(words).decode("utf-8", "replace")
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
        ends = np.flatnonzero(ids == self.mark)
        if len(ends) == len(words) - 1:
            raw, w = ids.tobytes(), self.dtype.itemsize
            for word, i, j in zip(words, [0, *(ends + 1)], [*ends, len(ids)], strict=True):
                self.cache[word] = raw[i * w : j * w]

    def ids(self, text: bytes) -> bytes:
        return self.all_ids([text])[0]

    def all_ids(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text. New words of SLICE_BYTES of texts go through the tokenizers library together."""
        out: list[bytes] = []
        begin = size = 0
        for k, text in enumerate(texts):
            size += len(text)
            if size >= SLICE_BYTES:
                out += self._slice(texts[begin : k + 1])
                begin, size = k + 1, 0
        return out + self._slice(texts[begin:])

    def _slice(self, texts: list[bytes]) -> list[bytes]:
        cache = self.cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
        # A-Z alone, which the tokenizer lowers as well
        split = [(t if b"<|" in t else t.lower()).split() for t in texts]
        found = [list(map(cache.get, own)) for own in split]  # one look-up for each word
        missing = [[i for i, ids in enumerate(of) if ids is None] for of in found]
        unseen = {own[i] for own, places in zip(split, missing, strict=True) for i in places}
        new, ends = set(), []
        for w in unseen:
            base = w.rstrip(MARKS)
            if len(base) < len(w) and base[-1:].isalnum() and b"<|" not in w:  # letters and marks are never joined
                ends.append((w, base))
                new.update(x for x in (base, w[len(base) :]) if x not in cache)
            else:
                new.add(w)
        plain = [w for w in new if b"\0" not in w and b"<|" not in w] if self.mark is not None else []
        for i in range(0, len(plain), 256):
            self._many(plain[i : i + 256])
        for w in new:
            if w not in cache:
                cache[w] = self._one(w)
        for w, base in ends:
            cache[w] = cache[base] + cache[w[len(base) :]]
        for own, of, places in zip(split, found, missing, strict=True):
            for i in places:
                of[i] = cache[own[i]]
        return [b"".join(of) for of in found]


def word_tokenizer(path: str) -> WordTokenizer:
    """The worker's tokenizer of this file."""
    if path not in _made:
        _made[path] = WordTokenizer(path)
    return _made[path]
