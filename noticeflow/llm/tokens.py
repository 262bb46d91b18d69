"""Encoding whole texts with the tokenizers library, each distinct chunk once for each worker.

Texts are cut where the vocabulary's own pattern always cuts; a chunk's ids are kept,
up to KEEP chunks, so that words that recur are encoded once. The ids are those that
the library gives for the whole text.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import regex

from noticeflow.llm.common import begin, keeps

#: Chunks whose ids a worker keeps; beyond that they become the old ones, and only those that recur are taken over.
KEEP = 600_000

#: The kinds of vocabulary: chunks that carry their blank before them, or words without blanks.
SPACED, WORDS = "spaced", "words"

_BLANK_AHEAD = re.compile(r" (?=\s|$)")  # of all that _BLANK matches, and a little more; it is faster
_BLANK = regex.compile(r"\s")


def _byte_forms() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it shows, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_byte_form = _byte_forms()
_codecs: dict[tuple[str, str, bool], "Codec"] = {}


def codec(path: str, kind: str, special_as_text: bool = False) -> "Codec":
    """The worker's codec of a vocabulary; it outlives the task."""
    begin("tokens")
    keeps("tokens", _codecs.clear)
    if (path, kind, special_as_text) not in _codecs:
        _codecs[path, kind, special_as_text] = Codec(path, kind, special_as_text)
    return _codecs[path, kind, special_as_text]


def spaced_chunks(text: str) -> list[str]:
    """text in chunks that a pattern of the kind ` ?letters+| ?digits+| ?others+|blanks` never crosses.

    A blank before a character that is none starts a chunk: such a match takes that blank,
    and a run of blanks before it ends there. A blank before another one, or at the end, cuts nothing.
    """
    parts = text.split(" ")
    if not _BLANK_AHEAD.search(text):
        return [parts[0], *[" " + x for x in parts[1:]]]
    out = [parts[0]]
    for x in parts[1:]:
        if x and not _BLANK.match(x):
            out.append(" " + x)
        else:
            out[-1] += " " + x
    return out


class Codec:
    """WORDS drops blanks, so its chunks are what ASCII blanks part: no match and no composed character spans one.

    A string of a special token in a text has that token's id, as the library gives it; with special_as_text it is encoded as ordinary text.
    """

    def __init__(self, path: str, kind: str, special_as_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.kind, self.known, self.old = kind, {}, {}
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # chunks have no such string, but in lower case one may look like it
        self.special = [] if special_as_text else [x.content for x in self.library.get_added_tokens_decoder().values()]
        self.model = self.library.model
        self.type = np.dtype("<u2") if self.library.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.type.itemsize == 2 else "I"

    def chunks(self, text: str) -> list:
        """Chunks of text whose encodings, one after another, are that of text. Words in ASCII lower case: the vocabulary has no other."""
        return text.encode().lower().split() if self.kind == WORDS else spaced_chunks(text)

    def parts(self, chunk) -> tuple:
        """chunk in smaller ones that recur more, where the pattern surely cuts: at a lone line end, before a stop or comma after a letter."""
        if self.kind == WORDS:
            return (chunk[:-1], chunk[-1:]) if len(chunk) > 1 and chunk[-1] in b",." and 97 <= chunk[-2] <= 122 else (chunk,)
        head, line, tail = chunk.partition("\n")
        if line and head and tail and not _BLANK.match(head[-1]) and not _BLANK.match(tail[0]) and "\n" not in tail:
            return (*self.parts(head), line, *self.parts(tail))
        return (chunk[:-1], chunk[-1]) if len(chunk) > 1 and chunk[-1] in ",." and chunk[-2].isalpha() else (chunk,)

    def _learn(self, missing: set) -> None:
        known, old, made, new = self.known, self.old, {}, set()
        for c in missing:
            if (ids := old.get(c)) is not None:
                known[c] = ids
            elif len(own := self.parts(c)) == 1:
                new.add(c)
            else:
                made[c] = own
                for x in own:
                    if x not in known:
                        if (ids := old.get(x)) is not None:
                            known[x] = ids
                        else:
                            new.add(x)
        # A run of letters is one match of the pattern, so the library's model takes it at once.
        tokenize, form, code = self.model.tokenize, _byte_form, self.code
        if self.kind == SPACED:
            plain = [c for c in new if (c[1:] if c[:1] == " " else c).isalpha()]
            for c in plain:
                shown = c.replace(" ", form[32]) if c.isascii() else c.encode().decode("latin-1").translate(form)
                known[c] = array(code, [t.id for t in tokenize(shown)]).tobytes()
        else:
            plain = [c for c in new if c.isalpha()]  # of bytes: ASCII letters
            for c in plain:
                known[c] = array(code, [t.id for t in tokenize(c.decode())]).tobytes()
        new = list(new.difference(plain))
        for i in range(0, len(new), 20_000):
            some = new[i : i + 20_000]
            asked = some if self.kind == SPACED else [x.decode() for x in some]
            for c, e in zip(some, self.library.encode_batch_fast(asked, add_special_tokens=False), strict=True):
                known[c] = np.array(e.ids, self.type).tobytes()
        for c, own in made.items():
            known[c] = b"".join(map(known.__getitem__, own))

    def _whole(self, text: str) -> bytes:
        self.library.encode_special_tokens = False
        ids = self.library.encode(text, add_special_tokens=False).ids
        self.library.encode_special_tokens = True
        return np.array(ids, self.type).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian integers of self.type."""
        whole = {i: self._whole(x) for i, x in enumerate(texts) if any(s in x for s in self.special)}
        cut = [() if i in whole else self.chunks(x) for i, x in enumerate(texts)]
        if missing := set().union(*cut) - self.known.keys():
            self._learn(missing)
        get = self.known.__getitem__
        out = [b"".join(map(get, chunks)) for chunks in cut]
        for i, ids in whole.items():
            out[i] = ids
        if len(self.known) > KEEP:
            self.old, self.known = self.known, {}
        return out

    def encode_bounded(self, texts: list[str], most: int = 4_000_000):
        """encode, over groups of texts of about most characters."""
        some, size = [], 0
        for x in texts:
            some.append(x)
            size += len(x)
            if size >= most:
                yield from self.encode(some)
                some, size = [], 0
        if some:
            yield from self.encode(some)


def ids32(ids: np.ndarray) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return np.ascontiguousarray(ids, "<u4").tobytes()


