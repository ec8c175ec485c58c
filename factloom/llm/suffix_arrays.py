"""Suffix arrays of shards by induced sorting, and their permuted common prefixes.

The steps are those of induced sorting with the inner loops taken a bucket at a time: suffixes are classed
as smaller or larger than the next, the leftmost-smaller substrings are sorted by one round of induction and
named, the string of names is sorted in the same way (until all names differ), and a second round induces all
suffixes from them. A string of many symbols has small buckets, so consecutive ones are taken together: suffixes
that are induced within such a group are put in order by that of the suffixes which they are induced from.
Common prefixes are compared only where the preceding bytes differ; everywhere else they are one shorter than at
the position before.
"""

from __future__ import annotations

import numpy as np

#: Buckets are grouped where there are more than this, each group with about so many suffixes.
MOST_BUCKETS, GROUP = 400, 4096
END = 0
SEPARATOR = 255


def smaller_types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last suffix counts as smaller."""
    n = len(text)
    step = np.sign(text[1:].astype(np.int64) - text[:-1])
    at = np.where(step != 0, np.arange(n - 1), n)
    following = np.minimum.accumulate(at[::-1])[::-1]
    return np.append(np.append(step, 1)[np.minimum(following, n - 1)] > 0, True)


class _Induction:
    """Sorts all suffixes of a text (which ends with its only smallest symbol) from some of its leftmost-smaller ones in order."""

    def __init__(self, text: np.ndarray):
        self.text, self.small = text, smaller_types(text)
        leftmost = self.small.copy()
        leftmost[1:] &= ~self.small[:-1]
        leftmost[0] = False
        self.leftmost, self.lms = leftmost, np.flatnonzero(leftmost)
        size = np.bincount(text)
        self.group = np.arange(len(size))
        if len(size) > MOST_BUCKETS:
            self.group = np.unique((np.cumsum(size) - 1) // GROUP, return_inverse=True)[1]
        self.groups = int(self.group[-1]) + 1
        self.alone = np.bincount(self.group) == 1
        self.of_group = lambda places: self.group[self.text[places]]
        # How many suffixes of the other type come before those of each symbol.
        small = np.bincount(text[self.small], minlength=len(size))
        self.small_before, self.large_upto = np.cumsum(small) - small, np.cumsum(size - small)

    def _before(self, places: np.ndarray, small: bool) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes one place before these, if of the wanted type, and which of these they belong to."""
        at = np.flatnonzero(places > 0)
        at = at[self.small[places[at] - 1] == small]
        return places[at] - 1, at

    def _deal(self, places: np.ndarray, pending: list[list[np.ndarray]], here: int, small: bool) -> np.ndarray:
        """Sends the suffixes before ``places`` to their groups; gives back those of this group."""
        before, _ = self._before(places, small)
        if not len(before):
            return before
        groups = self.of_group(before)
        order = np.argsort(groups, kind="stable")
        groups, before = groups[order], before[order]
        cuts = np.flatnonzero(groups[1:] != groups[:-1]) + 1
        kept = before[:0]
        for group, part in zip(groups[np.append(0, cuts)].tolist(), np.split(before, cuts)):
            if group == here:
                kept = part
            else:
                pending[group].append(part)
        return kept

    def _within(self, own: np.ndarray, seeds: np.ndarray, here: int, small: bool) -> tuple[np.ndarray, np.ndarray]:
        """A group of several buckets in order, and which of its suffixes are not seeds.

        In each bucket come the suffixes dealt from earlier groups, then those induced within the group, then the seeds. The
        second are sorted by what they are induced from, following twice as many steps each time.
        """
        front, link = np.concatenate([own, seeds]), np.arange(len(own) + len(seeds))
        items, links = [front], [link]
        while True:
            before, at = self._before(front, small)
            inside = self.of_group(before) == here
            front, at = before[inside], at[inside]
            if not len(front):
                break
            links.append(link[at] if len(items) == 1 else at + first)
            first = sum(map(len, items))
            items.append(front)
        first = len(own) + len(seeds)
        places, link = np.concatenate(items), np.concatenate(links)
        kind = np.repeat([0, 2, 1], [len(own), len(seeds), len(places) - first])
        bucket = (-3 if small else 3) * self.text[places].astype(np.int64) + kind
        second = np.where(kind == 1, 0, np.arange(len(places)))
        while True:
            key = (bucket - bucket.min()) * len(second) + second
            order = np.argsort(key)
            new = key[order[1:]] != key[order[:-1]]
            bucket = np.empty(len(order), dtype=np.int64)
            bucket[order] = np.append(0, np.cumsum(new))
            if new.all():
                return places[order], kind[order] < 2
            second, link = bucket[link], link[link]

    def _sweep(self, seeds: np.ndarray, small: bool) -> np.ndarray:
        """All suffixes of one type in the order of the sweep (downwards for the smaller ones), from seeds in that order."""
        pending: list[list[np.ndarray]] = [[] for _ in range(self.groups)]
        if small:
            pending[0].append(np.array([len(self.text) - 1]))
        ends = np.cumsum(np.bincount(self.of_group(seeds), minlength=self.groups)[:: -1 if small else 1])
        dealt = dict(zip(range(self.groups)[:: -1 if small else 1], np.split(seeds, ends[:-1])))
        out = []
        for here, mine in dealt.items():
            parts = pending[here]
            own = np.concatenate(parts) if parts else mine[:0]
            if not len(own) and not len(mine):
                continue
            if self.alone[here]:
                front = own
                while len(front):
                    front = self._deal(front, pending, here, small)
                    parts.append(front)
                self._deal(mine, pending, here, small)
                out += parts
            else:
                places, induced = self._within(own, mine, here, small)
                self._deal(places, pending, here, small)
                out.append(places[induced])
            pending[here] = []
        return np.concatenate(out) if out else seeds[:0]

    def induce(self, lms: np.ndarray) -> np.ndarray:
        large = self._sweep(lms[np.argsort(self.text[lms], kind="stable")], False)
        small = self._sweep(large[::-1], True)[::-1]
        out = np.empty(len(self.text), dtype=np.int64)
        out[np.arange(len(large)) + self.small_before[self.text[large]]] = large
        out[np.arange(len(small)) + self.large_upto[self.text[small]]] = small
        return out

    def names(self) -> tuple[np.ndarray, int]:
        """A name for each leftmost-smaller substring, in text order; smaller substrings have smaller names."""
        sorted_ = self.induce(self.lms)
        sorted_ = sorted_[self.leftmost[sorted_]]
        place = np.zeros(len(self.text), dtype=np.int64)
        place[self.lms] = np.arange(len(self.lms))
        length = np.append(np.diff(self.lms), 0)[place[sorted_]]
        a, b = sorted_[:-1], sorted_[1:]
        equal = length[:-1] == length[1:]
        open_, offset = np.flatnonzero(equal), 0
        while len(open_):
            same = self.text[a[open_] + offset] == self.text[b[open_] + offset]
            equal[open_[~same]] = False
            offset += 1
            open_ = open_[same & (length[open_] >= offset)]
        named = np.append(0, np.cumsum(~equal))
        out = np.zeros(len(self.lms), dtype=np.int64)
        out[place[sorted_]] = named
        return out, int(named[-1]) + 1


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Places of the suffixes in order; the text's last symbol is its only END."""
    if len(text) == 1:
        return np.zeros(1, dtype=np.int64)
    induction = _Induction(text)
    names, count = induction.names()
    order = np.argsort(names) if count == len(names) else suffix_array(names)
    return induction.induce(induction.lms[order])


def permuted_common_prefixes(text: np.ndarray, suffixes: np.ndarray) -> np.ndarray:
    """For each place, how many symbols its suffix shares with the one before it in order."""
    n = len(text)
    before = np.empty(n, dtype=np.int64)
    before[suffixes[1:]], before[suffixes[0]] = suffixes[:-1], -1
    # Where the symbols in front are equal too, the prefix is one shorter than at the place before.
    plain = (before > 0) & np.append(False, np.ones(n - 1, bool))
    plain[plain] = text[np.flatnonzero(plain) - 1] == text[before[plain] - 1]
    plain[1:] &= before[:-1] >= 0
    heads = np.flatnonzero(~plain)
    shared = np.zeros(len(heads), dtype=np.int64)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.ndarray((n + 1,), dtype="<u8", buffer=padded, strides=(1,))
    open_ = np.flatnonzero(before[heads] >= 0)
    while len(open_):
        left, right = heads[open_] + shared[open_], before[heads[open_]] + shared[open_]
        differ = words[left] ^ words[right]
        # The lowest set bit tells the first byte that differs; past the end the pads differ from the END symbol's place only in number.
        low = differ & (~differ + np.uint64(1))
        equal = np.where(differ == 0, 8, np.bitwise_count(low - np.uint64(1)).astype(np.int64) // 8)
        shared[open_] += equal
        go = (equal == 8) & (np.maximum(left, right) + 8 < n)
        open_ = open_[go]
    last = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, n)))
    return np.maximum(shared[last] - (np.arange(n) - heads[last]), 0)


def repeated_starts(pieces: list[bytes], width: int) -> list[np.ndarray]:
    """For each piece, the places where a string of ``width`` bytes starts that starts elsewhere in the pieces too."""
    sizes = np.array([len(p) for p in pieces])
    joined = np.frombuffer(b"".join(pieces), np.uint8)
    ends = np.cumsum(sizes)
    # Bytes of UTF-8 stay below 0xF5, so one more leaves room for the end below and the separator above.
    text = np.append(np.insert(joined + np.uint8(1), ends, SEPARATOR), np.uint8(END)) if len(pieces) else np.array([END], np.uint8)
    suffixes = suffix_array(text)
    prefixes = permuted_common_prefixes(text, suffixes)
    again = prefixes >= width
    again[suffixes[:-1]] |= prefixes[suffixes[1:]] >= width
    starts = ends - sizes + np.arange(len(pieces))
    return [np.flatnonzero(again[a : a + max(0, n - width + 1)]) for a, n in zip(starts.tolist(), sizes.tolist())]
