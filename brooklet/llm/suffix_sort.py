"""Deep-shallow suffix sorting of some byte strings.

Shallow: multikey quicksort over characters of 8 bytes, down to a depth.  Deep:
strings that are still equal there go into a blind trie, which stores branching
places only and needs one comparison of whole strings per insertion.
"""

from __future__ import annotations

STEP = 8
SHALLOW = 256  # bytes


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    size = min(len(a), len(b))
    if a[:size] == b[:size]:
        return size
    differ = int.from_bytes(a[:size]) ^ int.from_bytes(b[:size])
    return size - (differ.bit_length() + 7) // 8


class _Node:
    __slots__ = ("children", "depth")

    def __init__(self, depth: int, children: dict) -> None:
        self.depth, self.children = depth, children


def _at(text: bytes, place: int) -> int:
    return text[place] if place < len(text) else -1  # a string's end sorts first


def blind_sort(texts: list[bytes], members: list[int]) -> list[int]:
    """``members`` in the order of their texts; a leaf lists the members with one text."""
    root: _Node | list = [members[0]]
    for member in members[1:]:
        text, node = texts[member], root
        while isinstance(node, _Node):  # blind: bytes between the branches are not looked at
            child = node.children.get(_at(text, node.depth))
            node = next(iter(node.children.values())) if child is None else child
        other = texts[node[0]]
        depth = common(text, other)
        if depth == len(text) == len(other):
            node.append(member)
            continue
        parent, place = None, root
        while isinstance(place, _Node) and place.depth < depth:
            parent, place = place, place.children[_at(text, place.depth)]
        if isinstance(place, _Node) and place.depth == depth:
            place.children[_at(text, depth)] = [member]
            continue
        split = _Node(depth, {_at(other, depth): place, _at(text, depth): [member]})
        if parent is None:
            root = split
        else:
            parent.children[_at(text, parent.depth)] = split
    found, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, _Node):
            stack.extend(node.children[byte] for byte in sorted(node.children, reverse=True))
        else:
            found.extend(node)
    return found


def deep_shallow(texts: list[bytes], shallow: int = SHALLOW) -> tuple[list[int], list[int]]:
    """Places of ``texts`` in sorted order, and each one's common prefix with the one before (the first: 0)."""
    order, stack = [], [(list(range(len(texts))), 0)]
    while stack:
        members, depth = stack.pop()
        if len(members) <= 1:
            order.extend(members)
        elif depth >= shallow:
            order.extend(blind_sort(texts, members))
        else:
            keys = [texts[member][depth : depth + STEP] for member in members]
            pivot = sorted((keys[0], keys[len(keys) // 2], keys[-1]))[1]
            less, same, more = [], [], []
            for key, member in zip(keys, members):
                (same if key == pivot else less if key < pivot else more).append(member)
            stack.append((more, depth))
            # A short key is the end of the text: these texts are equal.
            stack.append((same, depth + STEP if len(pivot) == STEP else shallow))
            stack.append((less, depth))
    return order, [0, *(common(texts[a], texts[b]) for a, b in zip(order, order[1:]))] if order else []
