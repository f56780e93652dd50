"""Label-stratified dealing of units (records or patients) into folds of equal size.

Iterative stratification: the label with the fewest undealt units comes first; each of its units goes to the fold that still wants
most of that label, of equals to the one with most room. That is sequential, so units are dealt in blocks by the md5 of their
keys, each in one task and each into ``n`` parts that are even by themselves. How many units of each label a part has is
a small table; with it the driver gives the parts of every block to the folds so that what the blocks leave uneven cancels out.
"""

from __future__ import annotations

import numpy as np


def deal(ends: np.ndarray, label: np.ndarray, times: np.ndarray, weight: np.ndarray, n: int, n_labels: int) -> np.ndarray:
    """The part, 0 to n - 1, of each unit. Unit i has ``label[ends[i]:ends[i + 1]]``, each so many ``times``, and fills ``weight[i]``.

    A part is not filled beyond the even share while another has room, so with weights of 1 sizes differ by one at most.
    """
    units = len(weight)
    unit = np.repeat(np.arange(units), np.diff(ends))
    want = np.repeat((np.bincount(label, weights=times, minlength=n_labels) / n)[:, None], n, axis=1)
    floor, size = int(weight.sum()) // n, np.zeros(n, np.int64)
    part = np.full(units, -1, np.int64)
    rows = [slice(a, b) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def put(i: int, wish: np.ndarray) -> None:
        fits = size + weight[i] <= floor
        if not fits.any():
            fits = size == size.min()
        best = np.where(fits, wish, -np.inf)
        top = np.flatnonzero(best == best.max())
        p = top[np.argmin(size[top])]
        part[i] = p
        size[p] += weight[i]
        want[label[rows[i]], p] -= times[rows[i]]

    open_ = np.ones(len(label), bool)
    while open_.any():
        left = np.bincount(label[open_], minlength=n_labels)
        rarest = int(np.argmin(np.where(left > 0, left, units + 1)))
        own = np.unique(unit[open_ & (label == rarest)])
        for i in own[np.argsort(-weight[own], kind="stable")].tolist():
            put(i, want[rarest])
        open_ &= part[unit] < 0
    rest = np.flatnonzero(part < 0)
    for i in rest[np.argsort(-weight[rest], kind="stable")].tolist():
        put(i, -size.astype(float))
    return part


def evened(part: np.ndarray, ends: np.ndarray, label: np.ndarray, times: np.ndarray, weight: np.ndarray, n: int, n_labels: int, rounds: int = 600, tried: int = 256) -> np.ndarray:
    """Parts after swaps of units of one weight between two parts, as long as a swap lowers the sum of squared deviations.

    A round takes the label that is spread most unevenly, and the best of the swaps between its fullest and its emptiest part, of
    up to ``tried`` units that have it with as many that haven't.
    """
    part, size = part.copy(), np.diff(ends)
    unit = np.repeat(np.arange(len(weight)), size)
    tally = np.zeros((n, n_labels))
    np.add.at(tally, (part[unit], label), times)
    by = np.argsort(label, kind="stable")
    holders = np.split(unit[by], np.searchsorted(label[by], np.arange(1, n_labels)))
    stuck: set[tuple[int, int, int]] = set()

    def dense(units: np.ndarray) -> np.ndarray:
        own = size[units]
        at = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own - ends[:-1][units], own)
        out = np.zeros((len(units), n_labels))
        np.add.at(out, (np.repeat(np.arange(len(units)), own), label[at]), times[at])
        return out

    for _ in range(rounds):
        spread = np.ptp(tally, axis=0)
        places = [(int(c), int(tally[:, c].argmax()), int(tally[:, c].argmin())) for c in np.argsort(-spread, kind="stable") if spread[c] > 1]
        if not (places := [x for x in places if x not in stuck]):
            break
        c, a, b = places[0]
        x = holders[c][part[holders[c]] == a]
        without = part == b
        without[holders[c]] = False
        y = np.flatnonzero(without)
        good = None
        for w in np.intersect1d(weight[x], weight[y])[:8]:
            own, other = x[weight[x] == w][:tried], y[weight[y] == w][:tried]
            p, q, gap = dense(own), dense(other), tally[a] - tally[b]
            # moving d from a to b changes the sum of squares by 2 d (d - gap)
            cost = (p * (p - gap)).sum(axis=1)[:, None] + (q * (q + gap)).sum(axis=1)[None, :] - 2 * p @ q.T
            i, j = np.unravel_index(int(cost.argmin()), cost.shape)
            if cost[i, j] < -1e-9 and (good is None or cost[i, j] < good[0]):
                good = cost[i, j], own[i], other[j], p[i] - q[j]
        if good is None:
            stuck.add((c, a, b))
            continue
        _, i, j, moved = good
        part[i], part[j] = b, a
        tally[a] -= moved
        tally[b] += moved
        stuck.clear()
    return part


def joined(tallies: np.ndarray, passes: int = 60) -> np.ndarray:
    """fold[block, part] from tallies[block, part, label], the last label being the size: the folds' sums come near their mean.

    Block by block the parts are matched with the folds, and then matched anew against all other blocks. Labels that stay uneven weigh
    more from pass to pass; the pass whose least even label is best counts.
    """
    blocks, n, _ = tallies.shape
    away = tallies - tallies.mean(axis=1, keepdims=True)
    scale = np.ones(tallies.shape[2])
    scale[-1] = 1e6  # sizes before labels
    fold, total, best = np.tile(np.arange(n), (blocks, 1)), np.zeros(away.shape[1:]), None
    for step in range(passes):
        for k in range(blocks):
            if step:
                total[fold[k]] -= away[k]
            cost = 2 * (away[k] * scale) @ total.T  # of part p in fold f; the squares themselves are the same wherever it goes
            to = fold[k].copy() if step else _greedy(cost)
            while True:
                gain = cost[np.arange(n), to][:, None] + cost[np.arange(n), to][None, :] - cost[:, to] - cost[:, to].T
                i, j = np.unravel_index(int(gain.argmax()), gain.shape)
                if gain[i, j] <= 1e-9 * (1 + np.abs(cost).max()):
                    break
                to[i], to[j] = to[j], to[i]
            fold[k] = to
            total[to] += away[k]
        spread = total.max(axis=0) - total.min(axis=0)
        found = (round(float(spread[-1])), float(spread[:-1].max(initial=0)), float((spread**2).sum()))
        if best is None or found < best[0]:
            best = found, fold.copy()
        if found[0] <= 1 and found[1] <= 1:
            break
        scale[:-1] *= 1 + 0.3 * np.maximum(spread[:-1] - 1, 0) / max(1e-9, spread[:-1].max(initial=0))
        scale[:-1] /= scale[:-1].sum() / max(1, len(scale) - 1) or 1.0
    return best[1]


def _greedy(cost: np.ndarray) -> np.ndarray:
    to, free = np.full(len(cost), -1), np.ones(len(cost), bool)
    for p in np.argsort(cost.min(axis=1) - cost.max(axis=1), kind="stable"):
        to[p] = int(np.argmin(np.where(free, cost[p], np.inf)))
        free[to[p]] = False
    return to
