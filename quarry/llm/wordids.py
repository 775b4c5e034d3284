"""Token ids by the tokenizers library, remembered word by word.

A word-level pre-tokenizer encodes each run between spaces by itself, so the
ids of a text are the ids of its runs in order. Running text repeats its words;
each worker keeps the ids of the runs it has met (a bounded number) and asks the
library only for new ones. Texts that hold the start of a special token go to
the library whole.
"""

from __future__ import annotations

import os
from array import array

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

END_ID = 1
_TAILS = ".,;:!?"
#: Byte-level models show each byte as one letter: those without a sign of their own come after U+00FF.
_SHOWN = {b: 256 + i for i, b in enumerate([*range(33), *range(127, 161), 173])}


class WordIds:
    """ids(text): the text's ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, keep: int = 600_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.keep = keep
        self.marks = {"": b""} | dict(zip(_TAILS, self._encode(list(_TAILS)), strict=True))
        self.known = dict(self.marks)

    def _encode(self, runs: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(runs, add_special_tokens=False)]

    def _letters(self, word: str) -> bytes:
        """Ids of lower-case Latin letters: one pre-token, so the model alone splits it."""
        shown = word if word.isascii() else word.encode().decode("latin-1").translate(_SHOWN)
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _learn(self, runs: set[str]) -> dict[str, bytes]:
        """Ids of runs that are not known; the short ones are kept."""
        known, out, rest = self.known, {}, []
        for run in runs:
            # Letters and a mark after them are separate pre-tokens.
            stem, tail = (run[:-1], run[-1]) if run[-1] in _TAILS else (run, "")
            if stem.isalpha() and stem.islower() and max(stem) < "\u0100":
                out[run] = (known.get(stem) or self._letters(stem)) + known[tail]
            else:
                rest.append(run)
        out.update(zip(rest, self._encode(rest), strict=True))
        known.update(out if max(map(len, out)) <= 40 else {k: v for k, v in out.items() if len(k) <= 40})
        return out

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if "<|" in text:
            return self._encode([text])[0]
        if len(self.known) > self.keep:
            self.known = dict(self.marks)
        if text.isascii() or max(text) < "\u0100":  # each letter's lower case is one letter
            text = text.lower()
        runs = text.replace("\n", " ").split(" ")
        known = self.known
        try:
            return b"".join(map(known.__getitem__, runs))
        except KeyError:
            new = self._learn(set(runs).difference(known))
            return b"".join([known[r] if r in known else new[r] for r in runs])


_made: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One for each worker process and vocabulary file."""
    if path not in _made:
        _made[path] = WordIds(path)
    return _made[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
