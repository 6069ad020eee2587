"""Token ids of whole texts by the tokenizers library, with a word cache.

A vocabulary whose file normalises with NFC, white space to blanks and lower case, and splits at everything but letters, single digits and runs of other
signs, never lets a token cross white space: the ids of a text are the ids of its pieces between spaces, tabs and line ends, one after
another. Only pieces not seen lately go to the library; the others come from a cache of two generations with a fixed number of entries. A text of
characters below U+0100, which NFC leaves alone, is lower-cased here first, unless that makes one of the vocabulary's added tokens. A piece of
letters below U+0100, but for signs at its end, goes straight to the library's model, its letters written as the byte level writes them.
Files with other steps get whole texts. tests/llm/test_tokens.py holds all this against encoding whole texts.
"""

from __future__ import annotations

import json
import os
from array import array

import numpy as np

CACHE_WORDS = 600_000
LONG = 64
END_ID = 1
END_SIGNS = '.,;:!?%*#$&)"'
# The steps, as the vocabulary file states them, for which the above holds.
STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
_encoders: dict[str, "Encoder"] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Words(dict):
    """Packed ids by piece; a piece that is not there is brought in by the encoder, from its former generation if it is in that."""

    def __init__(self, learn, old: dict[str, bytes]):
        super().__init__({"": b""})
        self.learn, self.old = learn, old

    def __missing__(self, word: str) -> bytes:
        b = self.old.get(word)
        if b is None:
            b = self.learn(word)
        if len(word) < LONG:  # longer ones are not worth a place
            self[word] = b
        return b


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.model = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            steps = json.load(f)
        self.separable = all(steps.get(k) == v for k, v in STEPS.items())
        self.merge = Tokenizer.from_file(path).model.tokenize
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0x80, 0x100)}
        self.added = [a["content"].lower() for a in steps.get("added_tokens", [])]
        self.kind = np.dtype("<u2") if self.model.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.end = self._pack([END_ID])
        self.words = Words(self._learn, {})

    def _pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _learn(self, word: str) -> bytes:
        """The ids of a piece without blanks."""
        core = word.rstrip(END_SIGNS)
        if not core.isalpha() or not core.isascii() and max(core) >= "\u0100":
            return self._pack(self.model.encode_batch_fast([word], add_special_tokens=False)[0].ids)
        low = core.lower()
        if low != word:
            return self.words[low] + self.words[word[len(core) :]]
        return self._pack([x.id for x in self.merge(word if word.isascii() else word.translate(self.letters))])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """For each text its ids and the end id, packed little-endian in self.kind; a null text is empty."""
        if not self.separable:
            return [self._pack(self.model.encode(t or "", add_special_tokens=False).ids) + self.end for t in texts]
        out: list[bytes] = []
        for t in texts:
            if len(self.words) > CACHE_WORDS:
                self.words.old = {}
                self.words = Words(self._learn, self.words)
            pieces = self._lower(t or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
            out.append(b"".join(map(self.words.__getitem__, pieces)) + self.end)
        return out

    def _lower(self, text: str) -> str:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
        low = text.lower()
        return text if any(a in low for a in self.added) else low


def encoder(path: str) -> Encoder:
    """One encoder a worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
