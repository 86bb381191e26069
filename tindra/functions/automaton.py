"""Aho-Corasick automata in flat arrays, walked over many texts at once by numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Characters of a piece of text: pieces of all texts of a batch are walked side by side.
PIECE = 1024


@dataclass
class Automaton:
    """goto[state, class] for every state and character class; kind[code point] is a class, 0 for characters of no alias. own: the
    alias that ends in a state, or -1; up: the nearest shorter state with one, or 0. best: the largest rank of those that end there."""

    goto: np.ndarray
    kind: np.ndarray
    own: np.ndarray
    up: np.ndarray
    best: np.ndarray
    longest: int


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' code points in one array, and where each text ends."""
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), ends


def build(aliases: list[str], ranks: list[int]) -> Automaton:
    """aliases: different texts that aren't empty; ranks: over 0, the larger one wins where several end in one place."""
    letters, _ = codes(aliases)
    known = np.unique(letters)
    kind = np.zeros(0x110000, np.uint16 if len(known) < 65_000 else np.uint32)
    kind[known] = np.arange(1, len(known) + 1)
    kids: list[dict[int, int]] = [{}]
    last = []
    for a in aliases:
        at = 0
        for k in kind[codes([a])[0]].tolist():
            if (to := kids[at].get(k)) is None:
                to = kids[at][k] = len(kids)
                kids.append({})
            at = to
        last.append(at)
    n = len(kids)
    own, best = np.full(n, -1, np.int32), np.zeros(n, np.int64)
    own[last], best[last] = np.arange(len(aliases)), ranks
    goto, fail, up, level = np.zeros((n, len(known) + 1), np.int32), np.zeros(n, np.int32), np.zeros(n, np.int32), [0]
    while level:  # by depth: a state's fallback is shorter, so it is done
        below = []
        for s in level:
            if s:
                f = fail[s]
                goto[s] = goto[f]
                up[s] = f if own[f] >= 0 else up[f]
                best[s] = max(best[s], best[f])
            for k, to in kids[s].items():
                fail[to] = goto[fail[s], k] if s else 0
                below.append(to)
            for k, to in kids[s].items():
                goto[s, k] = to
        level = below
    return Automaton(goto, kind, own, up, best, max(map(len, aliases), default=0))


def walk(a: Automaton, texts: list[str]):
    """Yields (texts' numbers, states, places among all texts' characters) where an alias ends. A text is cut into pieces; each starts as many characters
    early as an alias is long, less one, and what ends before its own first character belongs to the piece before."""
    points, ends = codes(texts)
    begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    pieces = np.maximum(1, -(-(ends - begins) // PIECE))
    of = np.repeat(np.arange(len(texts)), pieces)
    first = begins[of] + (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * PIECE
    stop, start = np.minimum(first + PIECE, ends[of]), np.maximum(first - (a.longest - 1), begins[of])
    order = np.argsort(-(stop - start), kind="stable")
    of, first, stop, at = of[order], first[order], stop[order], start[order]
    left, state, kinds, live = stop - at, np.zeros(len(of), np.int64), a.kind[points], len(of)
    for step in range(int(left.max(initial=0))):
        while live and left[live - 1] <= step:
            live -= 1
        here = at[:live] + step
        state[:live] = a.goto[state[:live], kinds[here]]
        hit = np.flatnonzero((a.best[state[:live]] > 0) & (here >= first[:live]))
        if len(hit):
            yield of[hit], state[hit], here[hit]


def best_of(a: Automaton, texts: list[str]) -> np.ndarray:
    """The largest rank of the aliases in each text, 0 without one."""
    out = np.zeros(len(texts), np.int64)
    for who, state, _ in walk(a, texts):
        np.maximum.at(out, who, a.best[state])
    return out


def apart(keys: np.ndarray, ends: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which places count when those of a key may not overlap: the first, and each that starts at or after the end of the last that
    counts. Sorted by key and end; size is the length of each."""
    near = np.zeros(len(keys), bool)
    near[1:] = (keys[1:] == keys[:-1]) & (ends[1:] - ends[:-1] < size[1:])
    yes = ~near
    # only runs of places that overlap need looking at one by one; a run starts with one that counts
    key, end = keys.tolist(), ends.tolist()
    for i in np.flatnonzero(near).tolist():
        if not near[i - 1]:
            last = end[i - 1]
        if end[i] - last >= size[i]:
            yes[i], last = True, end[i]
    return yes


def counts(a: Automaton, texts: list[str], n: int, lengths: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, alias, occurrences), overlapping ones each; n: how many aliases there are. With the aliases' lengths, from the left
    and without overlap instead, as replacing would meet them."""
    n, found, places = max(n, 1), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for who, state, here in walk(a, texts):
        while len(state):
            ends = a.own[state] >= 0
            found.append(who[ends] * n + a.own[state[ends]])
            if lengths is not None:
                places.append(here[ends])
            state = a.up[state]
            who, here, state = who[state > 0], here[state > 0], state[state > 0]
    keys = np.concatenate(found)
    if lengths is not None and len(keys):
        ends = np.concatenate(places)
        order = np.lexsort((ends, keys))
        keys, ends = keys[order], ends[order]
        keys = keys[apart(keys, ends, lengths[keys % n])]
    keys, times = np.unique(keys, return_counts=True)
    return keys // n, keys % n, times
