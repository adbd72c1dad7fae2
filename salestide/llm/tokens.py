"""Token ids of whole texts, a batch at a time, with the public vocabularies of the workers."""

from __future__ import annotations

import base64
import os
import re
import unicodedata

import numpy as np

#: words that are kept with their ids; a full table is kept as the older one, and a new one begun
MOST_WORDS = 700_000
#: longer words are encoded every time
LONGEST_WORD = 48
#: so many characters are encoded at once
CHARACTERS = 1 << 20
# a mark of one id, and the words that are encoded in one run
_MARK, _RUN = "|", 1000
# simple characters stand before this one; their white space
_SIMPLE = 0x180
_BLANK = "\\x09-\\x0d\\x20"
# runs that one library takes quadratic time for
_LONG = re.compile(r"\S{1000}|\s{1000}")
_loaded: dict[object, object] = {}


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file; a path is returned as it is."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer(name: str):
    """The tokenizer of a JSON vocabulary, loaded once per worker; strings of special tokens are plain text."""
    if name not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(vocabulary(name))
        found.encode_special_tokens = True
        _loaded[name] = found
    return _loaded[name]


def _class(kind: str) -> str:
    """Members of a Unicode category among the simple characters, for a regular expression."""
    return "".join(re.escape(chr(c)) for c in range(_SIMPLE) if unicodedata.category(chr(c)).startswith(kind))


_LETTER, _NUMBER = _class("L"), _class("N")
# the words of the vocabulary's own pattern, in simple texts of lower case
_WORD = re.compile(f"[{_LETTER}]+|'(?:[stmd]|re|ve|ll)|[{_NUMBER}]|[^{_BLANK}{_LETTER}{_NUMBER}]+")
# characters whose white space, lower case or composition needs the tokenizer itself
_OTHER = re.compile(f"[\x1c-\x1f\x85\xa0\u0130{chr(_SIMPLE)}-\U0010ffff]")


class WordIds:
    """Ids of texts under the word vocabulary, as little-endian 32-bit bytes.

    Its words are found by a pattern, and a word has the same ids everywhere.  In
    simple texts (characters up to Latin Extended-A, whose lower case lies there too) the pattern is applied here
    and frequent words are encoded once; new ones are encoded many at a time,
    with a mark of one id between them.  Other texts go to the tokenizer as they
    are.
    """

    def __init__(self, name: str):
        self.encoder = tokenizer(name)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        (self.mark,) = self.encoder.encode(_MARK, add_special_tokens=False).ids

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.encoder.encode_batch_fast(texts, add_special_tokens=False)]

    def _encoded(self, words: list[str]) -> dict[str, bytes]:
        plain = [w for w in words if _MARK not in w]
        runs = [plain[i : i + _RUN] for i in range(0, len(plain), _RUN)]
        found = {}
        for run, body in zip(runs, self._whole([f" {_MARK} ".join(r) for r in runs])):
            ends = [*(np.flatnonzero(np.frombuffer(body, "<u4") == self.mark) * 4).tolist(), len(body)]
            at = 0
            for word, end in zip(run, ends, strict=True):
                found[word] = body[at:end]
                at = end + 4
        rest = [w for w in words if _MARK in w]
        return found | dict(zip(rest, self._whole(rest)))

    def of(self, texts: list[str | None]) -> list[bytes]:
        if len(self.known) > MOST_WORDS:
            self.known, self.older = {}, self.known
        simple = [not _OTHER.search(t or "") for t in texts]
        words = [_WORD.findall(t.lower()) if t and s else [] for t, s in zip(texts, simple)]
        found = [list(map(self.known.get, w)) for w in words]
        lacking = {w for ws, ids in zip(words, found) if None in ids for w, x in zip(ws, ids) if x is None}
        fresh = {w: self.older[w] for w in lacking if w in self.older}
        fresh |= self._encoded([w for w in lacking if w not in fresh])
        out = [b"".join([fresh[w] if x is None else x for w, x in zip(ws, ids)] if None in ids else ids) for ws, ids in zip(words, found)]
        self.known.update((w, x) for w, x in fresh.items() if len(w) <= LONGEST_WORD)
        other = [i for i, s in enumerate(simple) if not s]
        for i, body in zip(other, self._whole([texts[i] for i in other])):
            out[i] = body
        return out


class ByteIds:
    """Ids of texts under a byte-level vocabulary.

    Simple texts go to the faster library where the vocabulary is at hand as
    ranks too; the tokenizer itself takes others, and long runs without (or of
    nothing but) white space, for which it alone is near linear.
    """

    def __init__(self, name: str, ranks: str | None):
        self.encoder, self.fast = tokenizer(name), None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(vocabulary(ranks), "rb") as lines:
                table = {base64.b64decode(x): int(n) for x, n in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def of(self, texts: list[str]) -> list[list[int]]:
        slow = [i for i, t in enumerate(texts) if self.fast is None or _OTHER.search(t) or _LONG.search(t)]
        own = dict(zip(slow, self.encoder.encode_batch_fast([texts[i] for i in slow], add_special_tokens=False)))
        return [own[i].ids if i in own else self.fast.encode_ordinary(t) for i, t in enumerate(texts)]


def word_ids(name: str) -> WordIds:
    if ("words", name) not in _loaded:
        _loaded["words", name] = WordIds(name)
    return _loaded["words", name]


def slices(texts: list[str | None], most: int = CHARACTERS) -> list[tuple[int, int]]:
    """Runs (from, to) of texts of about ``most`` characters, a longer text on its own."""
    found, start, size = [], 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            found.append((start, i + 1))
            start, size = i + 1, 0
    if start < len(texts):
        found.append((start, len(texts)))
    return found
