"""Deep-shallow sorting of short byte strings.

Strings are split by multikey quicksort, a word of eight bytes at a time, to a shallow depth; the groups
that still agree there share a long prefix, and a blind trie orders each of them. The quicksort works on
all its groups at once: every round parts each group by its own pivot into less, equal and greater, and
the equal part goes on with the next word.
"""

from __future__ import annotations

import numpy as np

#: Bytes to which multikey quicksort sorts; what agrees so far goes to a blind trie.
SHALLOW = 48
WORD = 8


def padded(strings: list[bytes], width: int) -> np.ndarray:
    """Strings as rows of bytes, filled up with zeros."""
    kind = f"S{width}"
    return np.array(strings, kind).view(np.uint8).reshape(len(strings), width) if strings else np.zeros((0, width), np.uint8)


def suffix_order(strings: list[bytes], groups: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Order of the strings by group, then by bytes, a prefix first. ``rows`` are the strings padded."""
    if not strings:
        return np.zeros(0, np.int64)
    order = np.argsort(groups, kind="stable")
    words = np.ascontiguousarray(rows[:, :SHALLOW]).view(">u8").astype(np.uint64)
    place = np.arange(len(order))
    bucket = np.cumsum(np.diff(groups[order], prepend=groups[order[0]]) != 0)
    depth = np.zeros(len(order), np.int64)
    deep: list[np.ndarray] = []
    while len(place):
        starts = np.flatnonzero(np.diff(bucket, prepend=-1))
        sizes = np.diff(starts, append=len(bucket))
        alive = np.repeat(sizes > 1, sizes)
        shallow = depth < words.shape[1]
        finished = alive & ~shallow
        if finished.any():
            ends = np.flatnonzero(np.diff(bucket[finished], prepend=-1))
            deep += np.split(place[finished], ends[1:])
        alive &= shallow
        place, bucket, depth = place[alive], bucket[alive], depth[alive]
        if not len(place):
            break
        starts = np.flatnonzero(np.diff(bucket, prepend=-1))
        sizes = np.diff(starts, append=len(bucket))
        chosen = order[place]
        word = words[chosen, depth]
        pivot = np.repeat(word[starts + sizes // 2], sizes)
        side = np.repeat(np.arange(len(starts)) * 3, sizes) + 1 + (word > pivot) - (word < pivot)
        moved = np.argsort(side, kind="stable")
        order[place] = chosen[moved]
        bucket = side[moved]
        depth = depth[moved] + (bucket % 3 == 1)
    for places in deep:
        chosen = order[places]
        order[places] = chosen[trie_order([strings[i] for i in chosen])]
    return order


def shared_bytes(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differing = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differing.bit_length() + 7) // 8


def trie_order(strings: list[bytes]) -> list[int]:
    """Order of strings by a blind trie: nodes know only where they branch and on which byte.

    A string goes down by the bytes at the branching places alone, is compared once with the leaf it
    comes to, and is then hung in where the two part. Equal strings share a leaf; the end of a string
    comes before any byte.
    """
    if len(strings) == 2:
        return [0, 1] if strings[0] <= strings[1] else [1, 0]
    root: list | tuple = [0]  # a leaf is a list of equal strings, a node is (place, {byte: child})
    for i in range(1, len(strings)):
        s, n = strings[i], len(strings[i])
        leaf = root
        while type(leaf) is tuple:
            place, children = leaf
            child = children.get(s[place] if place < n else -1)
            leaf = child if child is not None else next(iter(children.values()))
        t = strings[leaf[0]]
        if s == t:
            leaf.append(i)
            continue
        part = shared_bytes(s, t)
        mine, other = s[part] if part < n else -1, t[part] if part < len(t) else -1
        above, node = None, root
        while type(node) is tuple and node[0] < part:
            above, node = node, node[1][s[node[0]]]
        if type(node) is tuple and node[0] == part:
            node[1][mine] = [i]
            continue
        fork = (part, {other: node, mine: [i]})
        if above is None:
            root = fork
        else:
            above[1][s[above[0]]] = fork
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if type(node) is tuple:
            stack += [node[1][b] for b in sorted(node[1], reverse=True)]
        else:
            out += node
    return out


def shared_prefixes(rows: np.ndarray, lengths: np.ndarray, groups: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each string of the order shares with the one before it; -1 at the start of a group."""
    if not len(order):
        return np.zeros(0, np.int64)
    here, before = order[1:], order[:-1]
    differs = rows[here] != rows[before]
    lcp = np.where(differs.any(axis=1), differs.argmax(axis=1), rows.shape[1])
    lcp = np.minimum(lcp, np.minimum(lengths[here], lengths[before]))
    return np.concatenate(([-1], np.where(groups[here] == groups[before], lcp, -1)))
