"""Fast exact use of a byte-level BPE tokenizer: parts between single spaces are encoded once and remembered.

The byte-level pre-tokenizer begins a new piece at every space between two characters that are not white space, and makes
a line end between two such characters a piece of its own; no merge crosses pieces. So texts are cut there, with numpy
over a whole batch, and a part that was seen before (by a 64-bit hash) gets its ids from a table. New parts that follow a
space are encoded many in a line: after that, a token that begins with a space opens each. Spaces and line ends beside
other white space, or at an end of a text, are not cut at; such stretches are encoded alone.
"""

from __future__ import annotations

import os

import numpy as np

from quarry.llm.common import mix, powers

#: Parts that a worker remembers at most (later ones are learnt for each batch alone) and slots of their table: some 30 MB.
MEMORY, SLOTS = 600_000, 1 << 20
#: Bytes of text that are best encoded together.
BATCH = 1 << 20
#: New parts that are encoded in one line.
LINE = 512

_ASCII_SPACE = np.zeros(256, bool)
_ASCII_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


def _is_space(c: np.ndarray, d: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Whether the characters whose UTF-8 bytes are (c, d, e), or (c, d), are white space beyond ASCII."""
    two = (c == 0xC2) & ((d == 0x85) | (d == 0xA0))
    general = (c == 0xE2) & (d == 0x80) & ((e <= 0x8A) | (e == 0xA8) | (e == 0xA9) | (e == 0xAF))
    return two | general | ((c == 0xE1) & (d == 0x9A) & (e == 0x80)) | ((c == 0xE2) & (d == 0x81) & (e == 0x9F)) | ((c == 0xE3) & (d == 0x80) & (e == 0x80))


def _ascending(x: np.ndarray) -> np.ndarray:
    """Distinct numbers in order; a stable sort is quick on runs that are in order."""
    x = np.sort(x, kind="stable")
    return x[np.concatenate(([True], x[1:] != x[:-1]))]


class Encoder:
    """Token ids of whole texts as arrays of `kind`, equal to Tokenizer.encode(text, add_special_tokens=False).ids."""

    def __init__(self, path: str, memory: int = MEMORY, slots: int = SLOTS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallel units
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.plain = not any(" " in t.content or "\n" in t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        space = self.tokenizer.encode(" ", add_special_tokens=False).tokens[0]
        self.opens = np.zeros(size, bool)
        self.opens[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith(space)]] = True
        self.memory, self.mask = memory, np.uint64(slots - 1)
        self.keys, self.place = np.zeros(slots, np.uint64), np.zeros(slots, np.int32)
        self.flat, self.off, self.len = np.zeros(1 << 20, self.kind), np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int32)
        self.n_parts = self.n_flat = 0

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Number of each known part, or -1."""
        out = np.full(len(h), -1, np.int64)
        at, todo = h & self.mask, np.arange(len(h))
        while len(todo):
            key = self.keys[at]
            hit = key == h[todo]
            out[todo[hit]] = self.place[at[hit]]
            go = ~hit & (key != 0)
            at, todo = (at[go] + np.uint64(1)) & self.mask, todo[go]
        return out

    def _insert(self, h: np.ndarray, number: np.ndarray) -> None:
        at, todo = h & self.mask, np.arange(len(h))
        while len(todo):
            free = self.keys[at] == 0
            slot, first = np.unique(at[free], return_index=True)
            won = todo[free][first]
            self.keys[slot], self.place[slot] = h[won], number[won]
            rest = np.ones(len(h), bool)
            rest[won] = False
            keep = rest[todo]
            at, todo = at[keep], todo[keep]
            at = np.where(self.keys[at] != 0, (at + np.uint64(1)) & self.mask, at)

    def _append(self, ids: np.ndarray, lengths: np.ndarray, parts: int, used: int) -> tuple[int, int]:
        """Adds parts' ids behind the `parts` parts and `used` ids that are there."""
        while used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while parts + len(lengths) > len(self.off):
            self.off, self.len = np.concatenate((self.off, np.zeros_like(self.off))), np.concatenate((self.len, np.zeros_like(self.len)))
        self.flat[used : used + len(ids)] = ids
        self.off[parts : parts + len(lengths)] = used + np.concatenate(([0], np.cumsum(lengths[:-1])))
        self.len[parts : parts + len(lengths)] = lengths
        return parts + len(lengths), used + len(ids)

    def _cuts(self, a: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where parts begin, and the spaces and line ends that are not cut at."""
        at = np.flatnonzero((a == 32) | (a == 10))
        if not self.plain:
            return _ascending(begin[begin < len(a)]), at
        inside = np.ones(len(a) + 1, bool)
        inside[begin] = False  # a text's first place has no place before it
        b = np.concatenate((np.zeros(3, np.uint8), a, np.full(3, 32, np.uint8)))  # b[i + 3] is a[i]
        before, after = b[at + 2], b[at + 4]
        ok = inside[at] & inside[at + 1] & ~_ASCII_SPACE[before] & ~_ASCII_SPACE[after]
        wide = np.flatnonzero(ok & ((before > 127) | (after > 127)))
        if len(wide):
            w = at[wide]
            odd = _is_space(b[w], b[w + 1], b[w + 2]) | _is_space(b[w + 4], b[w + 5], b[w + 6])
            two = (b[w + 1] == 0xC2) & ((b[w + 2] == 0x85) | (b[w + 2] == 0xA0))
            ok[wide[odd | two]] = False
        good = at[ok]
        ends = good[a[good] == 10]
        return _ascending(np.concatenate((begin[begin < len(a)], good, ends + 1))), at[~ok]

    def encode(self, texts: list[str | bytes]) -> list[np.ndarray]:
        data = [t.encode() if isinstance(t, str) else t for t in texts]
        buf = b"".join(data)
        if not buf:
            return [np.zeros(0, self.kind) for _ in data]
        a = np.frombuffer(buf, np.uint8)
        begin = np.concatenate(([0], np.cumsum(np.fromiter(map(len, data), np.int64, len(data)))))
        starts, odd = self._cuts(a, begin)
        ends = np.append(starts[1:], len(a))
        p, q = powers(len(a) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((a.astype(np.uint64) + np.uint64(1)) * p[: len(a)])))
        h = mix((sums[ends] - sums[starts]) * q[starts] + (ends - starts).astype(np.uint64), 5) | np.uint64(1)
        number = self._find(h)
        missing = np.flatnonzero(number < 0)
        if len(missing):
            new, first, turn = np.unique(h[missing], return_index=True, return_inverse=True)
            at = missing[first]
            alone = np.zeros(len(starts), bool)
            alone[np.searchsorted(starts, odd, "right") - 1] = True
            alone = alone[at] | (a[starts[at]] != 32)
            s, e = starts[at].tolist(), ends[at].tolist()
            parts, used = self.n_parts, self.n_flat
            told = np.empty(len(new), np.int64)
            line, rest = np.flatnonzero(~alone), np.flatnonzero(alone).tolist()
            for i in range(0, len(line), LINE):
                own = line[i : i + LINE]
                ids = np.array(self.tokenizer.encode(b"".join([buf[s[k] : e[k]] for k in own.tolist()]).decode(), add_special_tokens=False).ids, self.kind)
                opened = np.flatnonzero(self.opens[ids])
                if len(opened) == len(own) and opened[0] == 0:
                    told[own] = parts + np.arange(len(own))
                    parts, used = self._append(ids, np.diff(np.append(opened, len(ids))), parts, used)
                else:
                    rest += own.tolist()
            if rest:
                got = [x.ids for x in self.tokenizer.encode_batch_fast([buf[s[k] : e[k]].decode() for k in rest], add_special_tokens=False)]
                told[rest] = parts + np.arange(len(rest))
                parts, used = self._append(np.array([i for x in got for i in x], self.kind), np.array([len(x) for x in got], np.int64), parts, used)
            number[missing] = told[turn]
            if parts <= self.memory:
                self._insert(new, told.astype(np.int32))
                self.n_parts, self.n_flat = parts, used
        lengths = self.len[number].astype(np.int64)
        upto = np.concatenate(([0], np.cumsum(lengths)))
        ids = self.flat[np.repeat(self.off[number] - upto[:-1], lengths) + np.arange(upto[-1])]
        cuts = upto[np.searchsorted(starts, begin)].tolist()
        return [ids[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker and vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
