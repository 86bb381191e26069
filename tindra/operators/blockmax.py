"""Exact top-k over posting lists with block maxima: blocks that can't reach the threshold are never opened.

Between two neighbouring block ends of any of a question's lists no block changes, so WAND's bound has one value there: the sum
of the blocks' largest contributions. Such cells are taken highest bound first, in growing batches. A cell whose bound is below
the threshold (the k-th best score so far) is skipped with all its postings. In a live cell the pivot is the first list, by
ascending maxima, at which their running sum reaches the threshold: a document that is in no list from the pivot on can't reach
it, so only postings of those lists are opened, and the others are looked up for exact scores.
"""

from __future__ import annotations

from collections import Counter

import numpy as np

Lists = list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def best(lists: Lists, top: int, slack: float = 0, trace: Counter | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the `top` best documents over lists (places ascending, contributions >= 0, block ends, block maxima),
    best first, ties by place; documents of score 0 aren't found. slack: how far below the k-th best a score may lie and still be
    returned, for callers who round scores. trace counts postings and those that were opened."""
    kind = np.result_type(*[c.dtype for _, c, _, _ in lists])
    lasts = [p[e - 1] for p, _, e, _ in lists]  # each block's last place
    stops = np.unique(np.concatenate(lasts))  # cell c: places after stops[c - 1], up to stops[c]
    bound = np.zeros((len(lists), len(stops)), kind)
    for r, (last, (_, _, _, tops)) in enumerate(zip(lasts, lists, strict=True)):
        at = np.searchsorted(last, stops)
        bound[r, at < len(last)] = tops[at[at < len(last)]]
    whole = bound.sum(axis=0)
    order = np.argsort(-whole, kind="stable")
    edges = [np.concatenate([[0], np.searchsorted(p, stops, side="right")]) for p, _, _, _ in lists]  # postings of each cell
    places, scores, floor, done, width = np.zeros(0, np.int64), np.zeros(0, kind), None, 0, 2
    while done < len(order):
        cells = order[done : done + width]
        done, width = done + len(cells), width * 2
        b = bound[:, cells]
        if floor is None:
            opened = b > 0
        else:
            live = whole[cells] >= floor
            cells, b = cells[live], b[:, live]
            if not len(cells):
                break  # bounds fall, so all others are too low as well
            rise = np.argsort(b, axis=0, kind="stable")
            opened = np.zeros(b.shape, bool)
            np.put_along_axis(opened, rise, np.cumsum(np.take_along_axis(b, rise, axis=0), axis=0) >= floor, axis=0)
        found = []
        for r, (p, _, _, _) in enumerate(lists):
            mine = cells[opened[r]]
            lo, n = edges[r][mine], edges[r][mine + 1] - edges[r][mine]
            at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            found.append(p[at])
        docs = np.unique(np.concatenate(found))
        s = np.zeros(len(docs), kind)
        for p, c, _, _ in lists:
            at = np.searchsorted(p, docs)
            at[at == len(p)] = 0
            hit = p[at] == docs
            s[hit] += c[at[hit]]
        places, scores = np.concatenate([places, docs]), np.concatenate([scores, s])
        keep = np.lexsort((places, -scores))
        keep = keep[scores[keep] > 0]
        if len(keep) >= top:
            floor = scores[keep[top - 1]] - slack
            keep = keep[scores[keep] >= floor] if slack else keep[:top]
        places, scores = places[keep], scores[keep]
        if trace is not None:
            trace["opened"] += sum(map(len, found))
    if trace is not None:
        trace["postings"] += sum(len(p) for p, _, _, _ in lists)
    return places, scores
