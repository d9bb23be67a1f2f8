"""Token ids of a public byte-level BPE, fast: pieces are cut and looked up in bulk, and only new ones are merged."""

from __future__ import annotations

import json
import re
import sys
import unicodedata

import numpy as np

_CONTRACTION = re.compile(r"'(?:[stmd]|re|ve|ll)")
#: Texts with characters beyond this go to the tokenizer itself, whose Unicode tables may differ.
PLAIN = 0x250
#: Characters that are cut at once; each takes some 70 bytes meanwhile.
BULK = 400_000
LETTER, DIGIT, OTHER, SPACE, EDGE = range(5)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _classes() -> np.ndarray:
    out = np.full(PLAIN, OTHER, np.uint8)
    for c in range(PLAIN):
        kind = unicodedata.category(chr(c))
        if kind[0] == "L":
            out[c] = LETTER
        elif kind[0] == "N":
            out[c] = DIGIT
        elif chr(c).isspace() and not 0x1C <= c <= 0x1F:
            out[c] = SPACE
    out[0] = EDGE
    return out


_CLASS = _classes()


def _byte_alphabet() -> dict[str, int]:
    """The printable characters that byte-level vocabularies write bytes as."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids equal to those of ``tokenizers`` for the file at ``path``, without added special tokens.

    A text of plain characters is cut to pieces by its classes of characters,
    for many texts at once. Pieces are told apart by a 64-bit hash and their
    ids remembered, up to ``memory`` of them; a new piece is merged by rank.
    Texts with other characters, apostrophes or the text of a special token go
    through the tokenizer.
    """

    def __init__(self, path: str, memory: int = 400_000):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        alphabet = _byte_alphabet()
        special = {t["content"] for t in spec.get("added_tokens", [])}
        self.special = sorted(special)
        ranks = {bytes(alphabet[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        import tiktoken

        self.bpe = tiktoken.Encoding("bpe", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
        self.memory = memory
        self._forget()

    def _forget(self) -> None:
        self.names = np.zeros(0, np.uint64)
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        fast = []
        for i, t in enumerate(texts):
            if not t:
                out[i] = np.zeros(0, np.uint32)
            elif self._plain(t):
                fast.append(i)
            else:
                out[i] = np.array(self.slow.encode(t, add_special_tokens=False).ids, np.uint32)
        at = 0
        while at < len(fast):
            end, held = at, 0
            while end < len(fast) and (end == at or held + len(texts[fast[end]]) < BULK):
                held += len(texts[fast[end]])
                end += 1
            for i, ids in zip(fast[at:end], self._bulk([texts[i] for i in fast[at:end]])):
                out[i] = ids
            at = end
        return out

    def _plain(self, t: str) -> bool:
        if "'" in t or "\0" in t or any(s in t for s in self.special):
            return False
        return t.isascii() or max(t) < chr(PLAIN)

    def _bulk(self, texts: list[str]) -> list[np.ndarray]:
        joined = "\0" + "\0".join(texts) + "\0"
        code = np.frombuffer(joined.encode(f"utf-32-{'le' if sys.byteorder == 'little' else 'be'}"), np.uint32)
        kind = _CLASS[code]
        # Runs of a class are pieces ...
        first = np.empty(len(code), bool)
        first[0] = True
        np.not_equal(kind[1:], kind[:-1], out=first[1:])
        # ... but the last white space before something else stands apart, and a blank there joins what follows.
        gap = kind == SPACE
        last = gap[:-1] & (kind[1:] < SPACE)
        first[:-1] |= last
        first[1:] &= ~(last & (code[:-1] == 32))
        start = np.flatnonzero(first)
        length = np.diff(np.r_[start, len(code)])
        edge = kind[start] == EDGE
        # A polynomial hash of each piece from running sums; the length tells padded ones apart.
        name = self._hash(code, start, length)
        unique, at, back = np.unique(name, return_index=True, return_inverse=True)
        spot = self._known(unique, joined, start[at], length[at])
        sizes, offset = self.lengths[spot][back], self.starts[spot][back]
        sizes[edge] = 0
        total = np.cumsum(sizes)
        flat = self.ids[np.arange(total[-1]) + np.repeat(offset - (total - sizes), sizes)]
        cuts = total[np.flatnonzero(edge)]
        return [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:])]

    @staticmethod
    def _hash(code: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        c = code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        c ^= c >> np.uint64(29)
        n = len(code)
        if len(_POWERS[0]) < n:
            _POWERS[0] = _powers(_BASE, n)
            _POWERS[1] = _powers(pow(_BASE, -1, 1 << 64), n)
        c *= _POWERS[0][:n]
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(c, out=total[1:])
        h = (total[start + length] - total[start]) * _POWERS[1][start] + length.astype(np.uint64)
        return (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)

    def _known(self, unique: np.ndarray, joined: str, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Where the ids of each piece are; unknown ones are merged and remembered."""
        spot = np.searchsorted(self.names, unique)
        new = np.ones(len(unique), bool)
        inside = spot < len(self.names)
        new[inside] = self.names[spot[inside]] != unique[inside]
        if new.any():
            if len(self.names) and len(self.names) + new.sum() > self.memory:
                self._forget()
                new[:] = True
            merge = self.bpe._core_bpe.encode_single_piece
            got = [merge(joined[s : s + n].encode()) for s, n in zip(start[new].tolist(), length[new].tolist())]
            sizes = np.fromiter(map(len, got), np.int64, len(got))
            starts = len(self.ids) + np.cumsum(sizes) - sizes
            flat = np.fromiter((i for g in got for i in g), np.uint32, int(sizes.sum()))
            names = np.concatenate([self.names, unique[new]])
            order = np.argsort(names, kind="stable")
            self.names = names[order]
            self.starts = np.concatenate([self.starts, starts])[order]
            self.lengths = np.concatenate([self.lengths, sizes])[order]
            self.ids = np.concatenate([self.ids, flat])
            spot = np.searchsorted(self.names, unique)
        return spot


_BASE = 0xA0761D6478BD642F
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)
