"""Splitting text where no pre-token crosses, so that byte-level BPE can be remembered piece by piece.

Every match of the pre-tokenizer's pattern either starts at a space before a non-blank or doesn't contain one. So a
text falls apart before each such space, and the ids of the text are the ids of its parts in order. Parts repeat far
more than texts do; a bounded memory of parts makes tokenizing cost what the rare parts cost.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A space before a blank or at the end: the part after it is joined to the one before.
ODD = re.compile(r" (?=\s|[\x1c-\x1f]|\Z)")
#: What comes after such a space, for Arrow, whose \s knows ASCII only.
BLANK_FIRST = "^([\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]|$)"


def parts(text: str) -> list[str]:
    """The parts in order; joined they are the text."""
    first, *rest = text.split(" ")
    out = [first]
    for p in rest:
        if p and not p[0].isspace():
            out.append(" " + p)
        else:
            out[-1] += " " + p
    return out


class Recent:
    """Values by key in two generations of at most ``most`` keys each: what the older one still gives moves to the newer."""

    def __init__(self, most: int) -> None:
        self.most, self.now, self.before = most, {}, {}

    def unknown(self, keys: set) -> list:
        """Those of ``keys`` without a value; the values of all others are in ``now`` afterwards."""
        if len(self.now) > self.most:
            self.now, self.before = {}, self.now
        now, before, out = self.now, self.before, []
        for k in keys.difference(now):
            if (v := before.get(k)) is None:
                out.append(k)
            else:
                now[k] = v
        return out


class Memory:
    """Values of parts: ``fill`` gives them for a list of parts; a bounded number is remembered between batches.

    Texts that hold one of ``whole`` (tokens that a tokenizer cuts out before anything else) are given to ``fill_whole``
    as they are, one value each: what stands beside such a token is split otherwise. ``fill_after`` may give the values
    of parts that start at a space, from what comes after it. ``cut`` gives the parts of texts with blanks in a row.
    """

    def __init__(
        self, fill: Callable[[list[str]], list], most: int = 120_000, whole: tuple[str, ...] = (), fill_whole: Callable[[list[str]], list] | None = None, fill_after: Callable[[list[str]], list] | None = None,
        cut: Callable[[str], list[str]] = parts,
    ) -> None:
        # A part that follows a space is known by what comes after the space; any other part by its whole text.
        self.after, self.whole, self.marks, self.fill_whole, self.cut = Recent(most), Recent(most // 4), whole, fill_whole, cut
        self.ways = ((self.after, fill_after or (lambda keys: fill([" " + x for x in keys]))), (self.whole, fill))

    def values(self, texts: list[str]) -> list[list]:
        """For each text the values of its parts."""
        if apart := [k for k, t in enumerate(texts) if any(m in t for m in self.marks)]:
            out = iter(self.values([t for k, t in enumerate(texts) if k not in set(apart)]))
            whole = dict(zip(apart, self.fill_whole([texts[k] for k in apart]), strict=True))
            return [[whole[k]] if k in whole else next(out) for k in range(len(texts))]
        odd = {k: self.cut(t) for k, t in enumerate(texts) if ODD.search(t)}
        rest = [[""] if k in odd else t.split(" ") for k, t in enumerate(texts)]
        first = [p.pop(0) for p in rest]
        for keys, (known, fill) in zip((set(chain.from_iterable(rest)), set(first).union(*odd.values())), self.ways, strict=True):
            if new := known.unknown(keys):
                known.now.update(zip(new, fill(new), strict=True))
        one, other = self.after.now.__getitem__, self.whole.now.__getitem__
        return [list(map(other, odd[k])) if k in odd else [other(p), *map(one, rest[k])] for k, p in enumerate(first)]

    def arrays(self, texts: pa.Array) -> list[bytes]:
        """For each text the values of its parts joined, where values are bytes: 4 for each id.

        Arrow splits and numbers the parts, so that Python sees each different part of the batch once. Texts with a part
        that needs care (see ``parts`` and ``fill_whole``) go through ``values``.
        """
        if not len(texts):
            return []
        split = pc.split_pattern(texts, " ")
        coded = pc.dictionary_encode(split.flatten())
        at, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
        careful = pc.match_substring_regex(coded.dictionary, BLANK_FIRST).to_numpy(zero_copy_only=False)
        size = split.value_lengths().to_numpy().astype(np.int64)
        ends = np.cumsum(size)
        rest = np.ones(len(at), bool)
        rest[ends - size] = False
        bad = careful[at] & rest
        for mark in self.marks:
            bad |= pc.match_substring(coded.dictionary, mark).to_numpy(zero_copy_only=False)[at]
        odd = np.zeros(len(texts), bool)
        odd[np.searchsorted(ends, np.flatnonzero(bad), side="right")] = True
        if odd.any():
            stay = ~np.repeat(odd, size)
            at, rest, size = at[stay], rest[stay], size[~odd]
            ends = np.cumsum(size)
        mine = iter(self._joined(at, rest, ends, names))
        other = iter([b"".join(v) for v in self.values(texts.filter(pa.array(odd)).to_pylist())] if odd.any() else [])
        return [next(other if o else mine) for o in odd.tolist()]

    def _joined(self, at: np.ndarray, rest: np.ndarray, ends: np.ndarray, names: list[str]) -> list[bytes]:
        """The joined values of texts given by the numbers of their parts; ``rest``: those that aren't a text's first."""
        if not len(ends):
            return []
        used = np.zeros(len(names), bool)
        used[at[rest]] = True
        after, starts = list(compress(names, used.tolist())), [names[k] for k in at[~rest].tolist()]
        known = []
        for keys, (memory, fill) in zip((after, starts), self.ways, strict=True):
            if new := memory.unknown(set(keys)):
                memory.now.update(zip(new, fill(new), strict=True))
            known += map(memory.now.__getitem__, keys)
        place = np.zeros(len(names), np.int64)
        place[used] = np.arange(len(after))
        at = place[at]
        at[~rest] = len(after) + np.arange(len(starts))
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        begin = np.cumsum(size) - size
        table, each = np.frombuffer(b"".join(known), "<u4"), size[at]
        until = np.cumsum(each)
        from_place = np.repeat((begin[at] - until + each).astype(np.int32), each)  # a batch has far fewer than 2^31 ids
        from_place += np.arange(int(until[-1]), dtype=np.int32)
        ids = table[from_place].tobytes()
        cut = [0, *(4 * until[ends - 1]).tolist()]
        return [ids[a:b] for a, b in zip(cut, cut[1:], strict=False)]
