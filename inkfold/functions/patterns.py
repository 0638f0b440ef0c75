"""Regular expressions for many literals at once."""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import combinations
from math import prod

#: Characters at the beginning of a literal that are looked at before the trie, and signs that text is reckoned to have.
BEGINNING, SIGNS = 3, 27
#: Share of the positions that must be spared the trie to make one more pass over the text worth its time.
PASS = 0.018
#: Literals with more different first characters than this are found in one pass.
FIRST_CHARACTERS = 64


def _trie(words: list[str]) -> dict:
    root: dict = {}
    for w in words:
        node = root
        for ch in w:
            node = node.setdefault(ch, {})
        node[""] = {}
    return root


def _alternatives(node: dict, keys: list[str]) -> str:
    if len(keys) <= 3:
        return "|".join(re.escape(k) + _trie_regex(node[k]) for k in keys)
    half = len(keys) // 2
    parts = []
    for side in (keys[:half], keys[half:]):
        first = "".join(re.escape(k) for k in side)
        parts.append(f"(?=[{first}])(?:{_alternatives(node, side)})")
    return "|".join(parts)


def _trie_regex(node: dict) -> str:
    keys = sorted(k for k in node if k)
    if not keys:
        return ""
    body = _alternatives(node, keys)
    if "" in node:
        return f"(?:{body})?"
    return body if len(keys) == 1 else f"(?:{body})"


def trie_regex(literals: list[str]) -> str:
    """Pattern matching the longest of some literals at a position.

    Common beginnings are shared and wide branches are split by character class, so that a position
    is decided in a few steps however many literals there are.
    """
    return _trie_regex(_trie(literals))


def _sets(literals: list[str]) -> list[set[str]]:
    """Characters that occur at each of the first places, as far as all of some literals reach."""
    return [set(places) for places in zip(*(w[:BEGINNING] for w in literals))]


def _let_by(sets: list[set[str]]) -> float:
    """Share of the positions where such a beginning stands, if all signs were as frequent."""
    return prod(len(s) / SIGNS for s in sets)


def _class(chars: set[str]) -> str:
    return "[" + "".join(re.escape(c) for c in sorted(chars)) + "]"


@lru_cache(maxsize=256)
def scan_passes(literals: tuple[str, ...]) -> tuple[str, ...]:
    """Patterns that together capture, as group 1, the longest of some literals at every position where one starts.

    A pass holds literals with like beginnings. It looks at one class of first characters, then at the classes of the next
    ones, and tries its trie only where these fit: most positions cost one test.
    """
    firsts = {w[:1] for w in literals}
    if "" in firsts or len(firsts) > FIRST_CHARACTERS or any(c > "\uffff" for w in literals for c in w):
        return (f"(?=({trie_regex(list(literals))}))",)
    parts = [([w for w in literals if w[0] == c]) for c in sorted(firsts)]
    parts = [(words, _sets(words)) for words in parts]

    def more(a, b) -> float:
        return _let_by([x | y for x, y in zip(a[1], b[1])]) - _let_by(a[1]) - _let_by(b[1])

    while len(parts) > 1:
        a, b = min(combinations(parts, 2), key=lambda ab: more(*ab))
        if more(a, b) > PASS:
            break
        parts = [p for p in parts if p is not a and p is not b]
        parts.append((a[0] + b[0], [x | y for x, y in zip(a[1], b[1])]))
    out = []
    for words, sets in parts:
        after = f"(?={''.join(map(_class, sets[1:]))})" if sets[1:] else ""
        out.append(f"{_class(sets[0])}{after}(?<=(?=({trie_regex(sorted(words))}))(?s:.))")
    return tuple(out)


def presence_passes(literals: list[str]) -> tuple[str, ...]:
    """Patterns of which one is found where any of some literals occurs; literals that hold another one are left out."""
    return scan_passes(tuple(sorted({w for w in literals if not any(o != w and o in w for o in literals)})))
