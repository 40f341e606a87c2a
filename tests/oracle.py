"""A plain NumPy trainer, row by row and candidate by candidate, to compare with."""

import numpy as np


def gain(g, left, lam):
    nl, nr = left.sum(), (~left).sum()
    if nl == 0 or nr == 0:
        return None
    return g[left].sum() ** 2 / (nl + lam) + g[~left].sum() ** 2 / (nr + lam)


def goes_left(column, value, is_cat):
    return column == value if is_cat else column < value


def best(cols, cats, g, rows, lam, pooled=None):
    """Best candidate among the node's own values; gains over ``pooled`` rows if given."""
    found = None
    for f, column in enumerate(cols):
        for value in sorted(set(column[rows])):
            own = goes_left(column[rows], value, cats[f])
            if own.all() or not own.any():
                continue
            over = rows if pooled is None else pooled
            score = gain(g[over], goes_left(column[over], value, cats[f]), lam)
            if score and score > 0 and (found is None or score > found[0] + 1e-9):
                found = (score, f, value)
    return found


def grow(cols, cats, g, depth, lam, min_split=2, sibling=False):
    """{node id: leaf rows} and {node id: (gain, feature, value)}."""
    leaves, splits = {}, {}
    queue = [(0, np.arange(len(g)), None)]
    while queue:
        node, rows, other = queue.pop(0)
        level = (node + 1).bit_length() - 1
        pooled = np.concatenate([rows, other]) if sibling and other is not None else None
        split = best(cols, cats, g, rows, lam, pooled) \
            if level < depth and len(rows) >= min_split else None
        if split is None:
            leaves[node] = rows
            continue
        splits[node] = split
        left = goes_left(cols[split[1]][rows], split[2], cats[split[1]])
        queue += [(2 * node + 1, rows[left], rows[~left]), (2 * node + 2, rows[~left], rows[left])]
    return leaves, splits


def boost(cols, cats, y, trees, depth, eta, lam):
    pred, trace = np.full(len(y), y.mean()), []
    for _ in range(trees):
        g = pred - y
        leaves, _ = grow(cols, cats, g, depth, lam)
        total = 0.0
        pred = pred.copy()
        for rows in leaves.values():
            value = -g[rows].sum() / (len(rows) + lam)
            total += value
            pred[rows] += eta * value
        trace.append((g.sum(), total))
    return pred, trace
