"""Token ids of whole texts by a public tokenizer file, with each distinct piece tokenised once per batch."""

from __future__ import annotations

import functools
import gc
import os
import re
from array import array
from itertools import chain, compress
from operator import not_

#: Cutting a text before a run of blanks never changes its ids: in both files' pre-tokenisers a piece never goes on
#: over white space, and a run of blanks is split by what is inside it and by what follows it alone. Nor does cutting
#: between a letter or digit and a comma or full stop, since no piece holds both kinds.
PIECE = re.compile(
    r"[ \t\n\r]*[0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]++(?=[,.])|[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+$"
)
#: A piece with other white space (a run could be cut inside) or with the start of a special token's mark sends its
#: text to the tokenizer whole.
UNUSUAL = re.compile("[\\x0b\\x0c\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]|<\\|")
#: What str.split() takes for white space and the tokenizers don't.
SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")
#: Distinct pieces whose ids a worker remembers, about 150 bytes each.
MEMORY = 800_000
#: Characters that are cut into pieces at once, whatever the size of a batch.
SLICE = 1 << 20


def fits_latin1(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class TextTokenizer:
    """Encodes whole texts with a ``tokenizers`` file, remembering the ids of up to ``memory`` distinct pieces.

    ``encode`` gives exactly ``Tokenizer.encode(text, add_special_tokens=False).ids``, as unsigned 32-bit integers in
    little-endian bytes. A null or empty text has no ids. ``drops_blanks``: the file's
    normaliser lowers letters and its pre-tokeniser drops white space.
    """

    def __init__(self, path: str, drops_blanks: bool = False, memory: int = MEMORY):
        from tokenizers import Tokenizer, normalizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        #: For pieces that the normaliser leaves as they are.
        self.normal = self.tokenizer
        if drops_blanks:
            self.normal = Tokenizer.from_file(path)
            self.normal.normalizer = normalizers.Sequence([])
        self.drops_blanks = drops_blanks
        self.memory = memory
        self.known: dict[str, bytes] = {}

    def _cut(self, text: str | None) -> list[str]:
        if not text:
            return []
        if not self.drops_blanks:
            return PIECE.findall(text)
        if any(map(text.__contains__, SEPARATORS)):
            return [text]
        # such a file's normaliser lowers letters itself; in Latin-1 there is but one way to
        return (text.lower() if fits_latin1(text) else text).split()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        collects = gc.isenabled()
        gc.disable()  # millions of short strings and no cycles
        try:
            out: list[bytes] = []
            held, size = [], 0
            for text in texts:
                held.append(text)
                size += len(text or "")
                if size > SLICE:
                    out += self._encode(held)
                    held, size = [], 0
            return out + self._encode(held)
        finally:
            if collects:
                gc.enable()

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        pieces = [self._cut(t) for t in texts]
        found = [list(map(self.known.get, p)) for p in pieces]
        absent = [list(compress(p, map(not_, f))) for p, f in zip(pieces, found, strict=True)]
        fresh = list(set(chain.from_iterable(absent)))
        # composed small letters without blanks; all of Latin-1 is composed
        normal = [p for p in fresh if fits_latin1(p) and p == p.lower()] if self.drops_blanks else fresh
        batch = dict(zip(normal, self._ids(normal, self.normal), strict=True))
        if len(normal) < len(fresh):
            rest = [p for p in fresh if p not in batch]
            batch.update(zip(rest, self._ids(rest), strict=True))
        whole = {p for p in fresh if UNUSUAL.search(p)}
        out = []
        for text, ids, own in zip(texts, found, absent, strict=True):
            if own:
                if whole and not whole.isdisjoint(own):
                    out.append(self._ids([text])[0])
                    continue
                rest = map(batch.__getitem__, own)
                ids = [i or next(rest) for i in ids]
            out.append(b"".join(ids))
        if len(self.known) < self.memory:
            # pieces without ids aren't kept: an empty value means that a piece has to be looked at again
            self.known.update((p, i) for p, i in batch.items() if i and p not in whole)
        return out

    def _ids(self, texts: list[str], tokenizer=None) -> list[bytes]:
        found = (tokenizer or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]


@functools.lru_cache(maxsize=2)
def shared_tokenizer(path: str, drops_blanks: bool = False, memory: int = MEMORY) -> TextTokenizer:
    """One a Python worker, kept from task to task."""
    return TextTokenizer(path, drops_blanks, memory)
