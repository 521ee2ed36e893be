"""Deep-shallow sorting of byte strings, with the common prefix of each neighbour pair.

Shallow: multikey quicksort, ``STEP`` bytes as one key, down to ``SHALLOW`` bytes.
Deep: strings that still agree are ordered by a blind trie, which branches only where
strings differ, so long common prefixes are compared once per string and not per byte
of depth.
"""

from __future__ import annotations

STEP = 8
SHALLOW = 24


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


class _Node:
    """A branch at ``depth``; children by the byte there, -1 for a string that ends."""

    __slots__ = ("children", "depth")

    def __init__(self, depth: int):
        self.depth, self.children = depth, {}


def _at(s: bytes, depth: int) -> int:
    return s[depth] if depth < len(s) else -1


def _blind_trie(strings: list[bytes], members: list[int]) -> tuple[list[int], list[int]]:
    """Order and neighbour prefixes of the members. A leaf is a list of equal strings."""
    root: _Node | list[int] = [members[0]]
    for k in members[1:]:
        s, node = strings[k], root
        while isinstance(node, _Node):  # blind: only the branching bytes are looked at
            node = node.children.get(_at(s, node.depth)) or next(iter(node.children.values()))
        other = strings[node[0]]
        shared = common_prefix(s, other)
        if shared == len(s) == len(other):
            node.append(k)
            continue
        parent, at, node = None, 0, root
        while isinstance(node, _Node) and node.depth < shared:
            parent, at = node, _at(s, node.depth)
            node = node.children[at]
        if isinstance(node, _Node) and node.depth == shared:
            node.children[_at(s, shared)] = [k]
            continue
        branch = _Node(shared)
        branch.children = {_at(other, shared): node, _at(s, shared): [k]}
        if parent is None:
            root = branch
        else:
            parent.children[at] = branch
    order: list[int] = []
    shared_with_last: list[int] = []
    stack: list[tuple[_Node | list[int], int]] = [(root, 0)]
    while stack:
        node, shared = stack.pop()
        if isinstance(node, _Node):
            keys = sorted(node.children, reverse=True)
            stack.extend((node.children[c], shared if c == keys[-1] else node.depth) for c in keys)
        else:
            order.extend(node)
            shared_with_last.append(shared)
            shared_with_last.extend([len(strings[node[0]])] * (len(node) - 1))
    return order, shared_with_last


def deep_shallow(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """(order, shared): shared[k] is the common prefix of places k - 1 and k; shared[0] is 0."""
    order: list[int] = []
    shared: list[int] = []
    # (members, depth they agree to, prefix shared with what is ordered before them)
    stack: list[tuple[list[int], int, int]] = [(list(range(len(strings))), 0, 0)]
    while stack:
        members, depth, before = stack.pop()
        if not members:
            continue
        if len(members) == 1 or depth >= SHALLOW:
            found, inner = ([members[0]], [0]) if len(members) == 1 else _blind_trie(strings, members)
            order.extend(found)
            shared.append(before)
            shared.extend(inner[1:])
            continue
        keys = {k: strings[k][depth : depth + STEP] for k in members}
        pivot = keys[members[len(members) // 2]]
        less = [k for k in members if keys[k] < pivot]
        same = [k for k in members if keys[k] == pivot]
        more = [k for k in members if keys[k] > pivot]
        # The prefix shared across a border is known once the neighbours stand; -1 marks it.
        parts = [(less, depth, before)]
        ended = len(pivot) < STEP
        parts.append((same, SHALLOW if ended else depth + STEP, before if not less else -1))
        parts.append((more, depth, -1))
        stack.extend(reversed([p for p in parts if p[0]]))
    for k in range(1, len(order)):
        if shared[k] == -1:
            shared[k] = common_prefix(strings[order[k - 1]], strings[order[k]])
    if shared:
        shared[0] = 0
    return order, shared
