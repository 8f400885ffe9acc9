"""Deep-shallow sorting of fixed-length windows of byte strings: a suffix array of a bucket, cut off at the window's
length. A small helper that runs inside tasks.

Shallow: multikey quicksort with eight-byte characters; all groups that are still open are partitioned by their next
character at once. Deep: groups that agree on the shallow prefix are ordered by blind tries, which branch on single
bytes and compare a string in full only with one leaf.
"""

from __future__ import annotations

import numpy as np

WORD = 8


def words_at(data: bytes) -> np.ndarray:
    """The eight-byte big-endian character at every place; the end is padded."""
    padded = np.frombuffer(data + bytes(WORD), np.uint8)
    return np.ndarray(len(data), ">u8", padded, strides=(1,))


class BlindTrie:
    """Strings of one length. An inner node is [place, {byte: node}], a leaf a list of the equal strings' numbers."""

    def __init__(self, size: int):
        self.size, self.root, self.text = size, None, {}

    def insert(self, number: int, string: bytes) -> None:
        if self.root is None:
            self.root = self._leaf(number, string)
            return
        node = self.root
        while isinstance(node, tuple):
            node = node[1].get(string[node[0]]) or next(iter(node[1].values()))
        other = self.text[node[0]]
        if other == string:
            node.append(number)
            return
        fork = next(k for k in range(self.size) if other[k] != string[k])
        above, node = None, self.root
        while isinstance(node, tuple) and node[0] < fork:
            above, node = node, node[1][string[node[0]]]
        leaf = self._leaf(number, string)
        if isinstance(node, tuple) and node[0] == fork:
            node[1][string[fork]] = leaf
            return
        new = (fork, {other[fork]: node, string[fork]: leaf})
        if above is None:
            self.root = new
        else:
            above[1][string[above[0]]] = new

    def _leaf(self, number: int, string: bytes) -> list[int]:
        self.text[number] = string
        return [number]

    def classes(self) -> list[list[int]]:
        """Groups of equal strings, in the strings' order."""
        out, stack = [], [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack += [node[1][c] for c in sorted(node[1], reverse=True)]
            else:
                out.append(node)
        return out


def sort_windows(data: bytes, starts: np.ndarray, length: int, shallow: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): the windows ``data[s:s + length]`` in order, and for each place of the order the number of its
    group of equal windows. ``shallow`` is a multiple of eight below ``length``."""
    order = np.arange(len(starts))
    group = np.zeros(len(starts), np.int64)
    if not len(starts):
        return order, group
    word = words_at(data)
    open_ = np.ones(len(starts), bool)  # by place: its group has more than one window
    for depth in range(0, shallow, WORD):
        at = np.flatnonzero(open_)
        if not len(at):
            break
        char = word[starts[order[at]] + depth].astype(np.uint64)
        by = np.lexsort((char, group[at])) if depth else np.argsort(char, kind="stable")
        order[at], char, own = order[at][by], char[by], group[at][by]
        new = np.concatenate(([True], (char[1:] != char[:-1]) | (own[1:] != own[:-1])))
        group[at] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        alone = new & np.concatenate((new[1:], [True]))
        open_[at[alone]] = False
    at = np.flatnonzero(open_)
    if len(at):
        own = group[at]
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        size = np.diff(np.concatenate((first, [len(at)])))
        _pairs(word, data, starts, order, group, at[first[size == 2]], shallow, length)
        for f, n in zip(at[first[size > 2]].tolist(), size[size > 2].tolist(), strict=True):
            trie = BlindTrie(length - shallow)
            for k in order[f : f + n].tolist():
                s = int(starts[k])
                trie.insert(k, data[s + shallow : s + length])
            place = f
            for equal in trie.classes():
                order[place : place + len(equal)] = equal
                group[place : place + len(equal)] = place
                place += len(equal)
    return order, group


def _pairs(word, data, starts, order, group, place, shallow, length) -> None:
    """Tries with two leaves: one comparison each, for all of them at once."""
    if not len(place):
        return
    a, b = starts[order[place]], starts[order[place + 1]]
    sign = np.zeros(len(place), np.int8)
    depths = [*range(shallow, length - WORD + 1, WORD)]
    if length % WORD:
        depths.append(length - WORD)
    for depth in depths:
        x, y = word[a + depth].astype(np.uint64), word[b + depth].astype(np.uint64)
        sign = np.where(sign == 0, (x > y).astype(np.int8) - (x < y).astype(np.int8), sign)
    swap = place[sign > 0]
    order[swap], order[swap + 1] = order[swap + 1], order[swap]
    group[place[sign != 0] + 1] = place[sign != 0] + 1
