"""A small causal self-attention model over subword ids in NumPy.

One masked attention head runs over windows of ids; its hidden states give the next id by a softmax over all ids that is
factored by a tree: one of ``FAN`` classes, one of ``FAN`` groups of the class, an id of the group. Each level has output
vectors of its own, down to one for each id, and starts from counts: the log share of an alternative after ids of the
last id's class. So a network of zeros is a class bigram model, and training adds to it. The probabilities of all ids
sum to one.

Long sequences are cut into overlapping windows in which only the part not yet scored counts, so each token is scored
once, with at least ``WINDOW - STRIDE`` ids before it where the text has them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np

WINDOW, STRIDE = 16, 12
WIDTH, FAN = 8, 32
LEAVES = FAN * FAN
#: Windows that pass through the attention head together (small enough for a core's cache), and through the tree.
CHUNK, BLOCK = 256, 1 << 15
#: Rows of softmaxes that are worked on together.
ROWS = 2048
#: Scores up to this need no shift by their row's maximum before the exponentials.
TOP = 40.0
START = 1
#: Neighbour buckets on each side of an id's profile.
BUCKETS = 64

_BEFORE = np.tri(WINDOW, dtype=np.float32)


@dataclass
class Tree:
    """Class and leaf of each id, and the counts' log shares (natural): ``classes_log`` (class), ``groups_log`` (class before, class, group), ``ids_log`` (class before, place)."""

    classes: np.ndarray
    leaf: np.ndarray
    #: Ids by leaf, the place of each id among them, and where each leaf begins.
    order: np.ndarray
    place: np.ndarray
    first: np.ndarray
    classes_log: np.ndarray
    groups_log: np.ndarray
    ids_log: np.ndarray

    @cached_property
    def both_weight(self) -> np.ndarray:
        """Shares of the classes and of the groups side by side, a row for each class before and class."""
        return np.exp(np.concatenate([np.tile(self.classes_log, (LEAVES, 1)), self.groups_log.reshape(LEAVES, FAN)], axis=1))

    @cached_property
    def id_weight(self) -> np.ndarray:
        return np.exp(np.ascontiguousarray(self.ids_log))

    @cached_property
    def alike(self) -> list[bool]:
        """Classes whose shares are the same whatever stands before."""
        ends = self.first[::FAN]
        same = (self.ids_log == self.ids_log[0]).all(axis=0)
        return [bool((self.groups_log[:, c] == self.groups_log[0, c]).all() and same[ends[c] : ends[c + 1]].all()) for c in range(FAN)]

    @cached_property
    def place16(self) -> np.ndarray:
        """Places in two bytes if they fit, which sorts several times faster."""
        return self.place.astype(np.uint16 if len(self.place) <= 1 << 16 else np.int64)

    @cached_property
    def bias(self) -> np.ndarray:
        """Log share of each id after each class, summed over the levels."""
        return np.ascontiguousarray(self.classes_log[self.classes] + self.groups_log.reshape(FAN, LEAVES)[:, self.leaf] + self.ids_log[:, self.place])


def id_classes(profile: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Classes of ids by their neighbours: k-means on rows of neighbour counts, apart for ids that begin a word (``first``) and the others. Ids without counts are dealt out."""
    n = profile.sum(axis=1)
    unit = np.sqrt(profile / np.maximum(n, 1)[:, None])
    half = FAN // 2
    out = np.zeros(len(first), np.int64)
    for own, offset in ((np.nonzero(first)[0], 0), (np.nonzero(~first)[0], half)):
        used = own[n[own] > 0]
        used = used[np.argsort(-n[used], kind="stable")]
        out[own] = offset + np.arange(len(own)) % half
        if len(used) <= half:
            continue
        centres = unit[used[:half]].copy()
        for _ in range(8):
            near = np.argmax(unit[used] @ centres.T, axis=1)
            for c in range(half):
                mine = used[near == c]
                if len(mine):
                    mean = np.average(unit[mine], axis=0, weights=n[mine])
                    centres[c] = mean / max(np.linalg.norm(mean), 1e-9)
        out[used] = offset + np.argmax(unit[used] @ centres.T, axis=1)
    return out


def build_tree(classes: np.ndarray, first: np.ndarray, pairs: np.ndarray) -> Tree:
    """The tree over given classes, with shares from counts (class before, id) of all training texts.

    Ids that begin a word have one share whatever stands before; those of the others lean on the overall share where a
    class was seen rarely. A class's groups hold ids of like frequency, few of frequent ones, which keeps most softmaxes short.
    """
    total = pairs.sum(axis=0) + 0.1
    overall = total / np.bincount(classes, total, FAN)[classes]
    context = np.stack([np.bincount(classes, row, FAN)[classes] for row in pairs])
    strength = 20.0
    share = np.where(first, overall, (pairs + strength * overall) / (context + strength))
    by_class = np.lexsort((-total, classes))
    sizes = np.bincount(classes, minlength=FAN)
    rank = np.empty(len(classes), np.int64)
    rank[by_class] = np.arange(len(classes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    leaf = classes * FAN + np.minimum(FAN - 1, np.sqrt(rank / sizes[classes]) * FAN).astype(np.int64)
    order = np.argsort(leaf, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    groups = np.stack([np.bincount(leaf, row, LEAVES) for row in share])
    log = np.log(np.maximum(groups, 1e-12))
    whole = np.bincount(classes, total, FAN)
    return Tree(classes, leaf, order, place, np.searchsorted(leaf[order], np.arange(LEAVES + 1)), np.log(np.maximum(whole, 1e-9) / whole.sum()).astype(np.float32), log.reshape(FAN, FAN, FAN).astype(np.float32), np.ascontiguousarray((np.log(share) - log[:, leaf])[:, order], np.float32))


class Network:
    """All weights as one matrix of rows of ``WIDTH``, with views of its parts."""

    def __init__(self, matrix: np.ndarray, size: int) -> None:
        self.matrix = matrix
        at = 0
        for name, shape in self.shapes(size).items():
            rows = int(np.prod(shape)) // WIDTH
            setattr(self, name, matrix[at : at + rows].reshape(shape))
            at += rows

    @property
    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """What takes inputs to queries against inputs, and to outputs of values."""
        q, k, v = np.split(self.qkv, 3, axis=1)
        return q @ k.T * np.float32(WIDTH**-0.5), v @ self.out

    @staticmethod
    def shapes(size: int) -> dict[str, tuple[int, ...]]:
        return {"embed": (size, WIDTH), "ids": (size, WIDTH), "groups": (FAN, WIDTH, FAN), "qkv": (WIDTH, 3 * WIDTH), "out": (WIDTH, WIDTH), "head": (WIDTH, FAN), "place": (WINDOW, WIDTH)}

    @classmethod
    def rows(cls, size: int) -> int:
        return sum(int(np.prod(s)) // WIDTH for s in cls.shapes(size).values())

    @classmethod
    def start(cls, size: int, seed: int = 0) -> Network:
        """Weights before training: random inputs, outputs that leave the counts as they are."""
        rng = np.random.default_rng(seed)
        net = cls(np.zeros((cls.rows(size), WIDTH), np.float32), size)
        net.embed[:] = rng.standard_normal(net.embed.shape) * 0.3
        net.place[:] = rng.standard_normal(net.place.shape) * 0.1
        for w in (net.qkv, net.out):
            w[:] = rng.standard_normal(w.shape) * WIDTH**-0.5
        return net


@dataclass
class Model:
    """A network on its tree."""

    tree: Tree
    matrix: np.ndarray

    @cached_property
    def net(self) -> Network:
        return Network(self.matrix, len(self.tree.classes))

    @property
    def outputs(self) -> list[np.ndarray]:
        """Output vectors of classes, groups and ids, a row each."""
        return [self.net.head.T, self.net.groups.transpose(0, 2, 1).reshape(-1, WIDTH), self.net.ids]

    def both(self, top: int) -> np.ndarray:
        """Output vectors of the classes and of a class's groups side by side, their log shares (of groups after the first class) below."""
        return np.concatenate([np.concatenate([self.net.head, self.net.groups[top]], axis=1), np.concatenate([self.tree.classes_log, self.tree.groups_log[0, top]])[None]])

    @cached_property
    def vectors(self) -> np.ndarray:
        """Output vector of each id, summed over the levels that tell ids apart. For weights that stay."""
        tree, (tops, groups, ids) = self.tree, self.outputs
        return tops[tree.classes] + groups[tree.leaf] + ids[tree.place] * (np.diff(tree.first)[tree.leaf] > 1)[:, None]


def _far(z: np.ndarray) -> bool:
    """True if scores leave the range in which exponentials need no shift. Rows are then shifted, which is exact and slower."""
    return bool(z.max(initial=0) > TOP or z.min(initial=0) < -2 * TOP)


def _wide(x: np.ndarray, size: int) -> np.ndarray:
    """A vector as ``size`` equal columns. Products with these are several times faster than with one column, where rows are short."""
    return np.repeat(x, size).reshape(-1, size)


def _forward(m: Network, ids: np.ndarray, skip: int = 0) -> tuple[np.ndarray, ...]:
    """(hidden states of windows of ids from place ``skip`` on, and what the gradient needs: inputs, queries against inputs, outputs of values, exponentials, reciprocals of their sums, outputs of the head).

    Queries meet keys, and values their output, as one matrix each.
    """
    x = m.embed.take(ids.ravel(), axis=0).reshape(*ids.shape, WIDTH)
    x += m.place
    own = np.ascontiguousarray(x[:, skip:])
    one, two = m.pairs
    q, v = (own.reshape(-1, WIDTH) @ one).reshape(own.shape), (x.reshape(-1, WIDTH) @ two).reshape(x.shape)
    e = q @ x.transpose(0, 2, 1)
    if _far(e):
        e += (_BEFORE[skip:] - 1) * np.float32(1e9)
        e -= e.max(axis=-1, keepdims=True)
    np.exp(e, out=e)
    e *= _BEFORE[skip:]
    r = _wide(1 / (e.reshape(-1, WINDOW) @ np.ones(WINDOW, e.dtype)), WIDTH).reshape(own.shape)
    c = e @ v
    c *= r
    return own + c, x, q, v, e, r, c


def _backward(m: Network, g: Network, saved: tuple[np.ndarray, ...], dhidden: np.ndarray) -> np.ndarray:
    """Gradient of the inputs of ``_forward``; the head's matrices are added to ``g``."""
    x, q, v, e, r, c = saved
    flat = lambda y: y.reshape(-1, WIDTH)
    # A softmax's gradient takes off the mean of what comes back, which is known from the head's output.
    ds = dhidden @ v.transpose(0, 2, 1)
    c *= dhidden
    ds -= _wide(flat(c) @ np.ones(WIDTH, c.dtype), WINDOW).reshape(ds.shape)
    ds *= e
    dq = ds @ x
    dq *= r
    q *= r
    r *= dhidden
    dv = e.transpose(0, 2, 1) @ r
    dx = ds.transpose(0, 2, 1) @ q
    dx += dhidden
    one, two = m.pairs
    rows = flat(dx)
    rows += flat(dq) @ one.T
    rows += flat(dv) @ two.T
    scale = np.float32(WIDTH**-0.5)
    done, dtwo = flat(x).T @ flat(dq) * scale, flat(x).T @ flat(dv)
    (wq, wk, wv), (gq, gk, gv) = np.split(m.qkv, 3, axis=1), np.split(g.qkv, 3, axis=1)
    gq += done @ wk
    gk += done.T @ wq
    gv += dtwo @ m.out.T
    g.out += wv.T @ dtwo
    return dx


def _shares(z: np.ndarray, scale: np.float32, weight: np.ndarray | None = None) -> float:
    """Softmax of each row, with weights, times ``scale`` in place; the sum of the logs of what rows are divided by."""
    loss = 0.0
    if _far(z):
        top = z.max(axis=1)
        z -= top[:, None]
        loss = float(top.sum())
    np.exp(z, out=z)
    if weight is not None:
        z *= weight
    s = z @ np.ones(z.shape[1], z.dtype)
    z *= _wide(scale / s, z.shape[1])
    return loss + float(np.log(s).sum())


def _starts(x: np.ndarray) -> np.ndarray:
    """Where the values of a sorted array that is not empty begin."""
    return np.concatenate([[0], np.nonzero(x[1:] != x[:-1])[0] + 1])


def gradient(m: Model, windows: np.ndarray) -> tuple[float, np.ndarray]:
    """(mean loss in nats, gradient) of windows of ``WINDOW + 1`` ids; places with -1 do not count.

    The goals' own part is summed by id, then by group and class; softmaxes are worked on in the order of the tree.
    """
    tree, net = m.tree, m.net
    ids, goal = np.maximum(windows[:, :-1], 0), windows[:, 1:].ravel()
    live = np.nonzero(goal >= 0)[0]
    out = np.zeros_like(m.matrix)
    if not len(live):
        return 0.0, out
    g = Network(out, len(tree.classes))
    saved = [_forward(net, ids[i : i + CHUNK]) for i in range(0, len(ids), CHUNK)]
    place = tree.place16.take(goal.take(live))
    by = np.argsort(place, kind="stable")
    live, place = live.take(by), place.take(by)
    n, scale = len(live), np.float32(1 / len(live))
    h = np.concatenate([x[0] for x in saved]).reshape(-1, WIDTH).take(live, axis=0)
    last = tree.classes.take(ids.ravel().take(live))

    new = _starts(place)
    own = place[new].astype(np.int64)
    leaf = tree.leaf[tree.order[own]]
    by_leaf = _starts(leaf)
    leaves = leaf[by_leaf]
    by_class = _starts(leaves // FAN)
    tops, groups, vectors = m.outputs
    several = (np.diff(tree.first)[leaf] > 1)[:, None]
    vectors = tops[leaf // FAN] + groups[leaf] + vectors[own] * several
    dh = np.repeat(vectors * -scale, np.diff(new, append=n), axis=0)
    sums = np.add.reduceat(h, new, axis=0)
    loss = float((sums * vectors).sum()) + float(tree.bias.take(last * len(tree.classes) + tree.order.take(place)).sum())
    sums *= -scale
    goals = sums * several
    sums = np.add.reduceat(sums, by_leaf, axis=0)
    g.groups[leaves // FAN, :, leaves % FAN] = sums
    g.head[:, leaves[by_class] // FAN] = np.add.reduceat(sums, by_class, axis=0).T

    # Softmaxes of classes and groups side by side. A place of ones takes the shares along.
    h1 = np.ones((n, WIDTH + 1), h.dtype)
    h1[:, :WIDTH] = h
    ends = np.searchsorted(place, tree.first[::FAN]).tolist()
    for c, (i, j) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        both = m.both(c)
        for a in range(i, j, ROWS):
            b = min(j, a + ROWS)
            if tree.alike[c]:
                z, weight = h1[a:b] @ both, None
            else:
                z, weight = h[a:b] @ both[:-1], tree.both_weight.take(last[a:b] * FAN + c, axis=0).reshape(-1, FAN)
            loss -= _shares(z.reshape(-1, FAN), scale, weight)
            sums = h[a:b].T @ z
            g.head += sums[:, :FAN]
            g.groups[c] += sums[:, FAN:]
            dh[a:b] += z @ both[:-1].T
    # Rows with the ids of their leaf, leaves of one size together. A leaf of a single id has nothing to tell apart.
    sizes, begin, first = np.diff(tree.first)[leaves], new[by_leaf], tree.first[leaves]
    rank = np.argsort(sizes, kind="stable")
    rank = rank[np.searchsorted(sizes[rank], 2) :]
    if len(rank):
        number, size, begin, first = np.diff(begin, append=n)[rank], sizes[rank], begin[rank], first[rank]
        ends = np.cumsum(number * size)
        cells = np.empty(int(ends[-1]), h.dtype)
        back = np.zeros_like(h)
        parts = [
            (cells[e - r * k : e].reshape(r, k), h[a : a + r], back[a : a + r], net.ids[f : f + k], g.ids[f : f + k])
            for a, r, k, e, f in zip(begin.tolist(), number.tolist(), size.tolist(), ends.tolist(), first.tolist(), strict=True)
        ]
        for z, mine, _, vectors, _ in parts:
            np.matmul(mine, vectors.T, out=z)
        same = _starts(size)
        rows = np.cumsum(number)
        before = last.take(np.repeat(begin - rows + number, number) + np.arange(rows[-1])) * len(tree.classes) + np.repeat(first, number)
        for i, j in zip(same.tolist(), [*same[1:].tolist(), len(size)], strict=True):
            k, a, b = int(size[i]), int(rows[i] - number[i]), int(rows[j - 1])
            z = cells[ends[i] - number[i] * k : ends[j - 1]].reshape(-1, k)
            loss -= _shares(z, scale, tree.id_weight.take(_wide(before[a:b], k) + np.tile(np.arange(k), b - a).reshape(-1, k)))
        for z, mine, result, vectors, sums in parts:
            np.matmul(z, vectors, out=result)
            np.matmul(z.T, mine, out=sums)
        dh += back
    g.ids[own] += goals

    dhidden = np.zeros((ids.size, WIDTH), h.dtype)
    dhidden[live] = dh
    dhidden = dhidden.reshape(*ids.shape, WIDTH)
    dx = np.concatenate([_backward(net, g, s[1:], dhidden[i * CHUNK : (i + 1) * CHUNK]) for i, s in enumerate(saved)])
    g.place[:] = dx.sum(axis=0)
    seen = ids.ravel().astype(tree.place16.dtype)
    by = np.argsort(seen, kind="stable")
    seen = seen.take(by)
    new = _starts(seen)
    g.embed[seen[new]] = np.add.reduceat(dx.reshape(-1, WIDTH).take(by, axis=0), new, axis=0)
    return -loss / n, out


def train(m: Model, windows: np.ndarray, steps: int, batch: int = 256, rate: float = 0.01, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(change of the matrix, weight of each row) after Adam steps on windows, each used once before any comes again.

    A row weighs as much as the windows that touched it, so that the changes of several trainers can be averaged. Rows
    that no window touches have no gradient and stay, so a step leaves them out.
    """
    rng = np.random.default_rng(seed)
    tree = m.tree
    weight = np.full(len(m.matrix), float(len(windows)))
    seen, goals = windows[:, :-1], windows[:, 1:]
    size = len(tree.classes)
    weight[:size] = np.bincount(seen[seen >= 0], minlength=size)
    visits = np.bincount(tree.leaf[goals[goals >= 0]], minlength=LEAVES)
    weight[size : 2 * size] = np.repeat(visits, np.diff(tree.first))
    used = np.nonzero(weight)[0]
    now = Model(tree, m.matrix.copy())
    m1, m2 = np.zeros_like(m.matrix[used]), np.zeros_like(m.matrix[used])
    queue = np.empty(0, np.int64)
    for step in range(1, steps + 1):
        while len(queue) < min(batch, len(windows)):
            queue = np.concatenate([queue, rng.permutation(len(windows))])
        g = gradient(now, windows.take(queue[:batch], axis=0))[1].take(used, axis=0)
        queue = queue[batch:]
        m1 += np.float32(0.1) * (g - m1)
        m2 += np.float32(0.01) * (g * g - m2)
        size = np.float32(rate * min(1, step / 10) / (1 - 0.9**step))
        now.matrix[used] -= size * m1 / (np.sqrt(m2 / np.float32(1 - 0.99**step)) + np.float32(1e-8))
    return now.matrix - m.matrix, weight


def _log_sums(z: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """Log of the weighted sum of exponentials of each row; ``weight`` is one row for all, or one each."""
    far = _far(z)
    if far:
        top = z.max(axis=1)
        z -= top[:, None]
    np.exp(z, out=z)
    if weight is not None and weight.ndim == 2:
        z *= weight
        weight = None
    out = np.log(z @ (np.ones(z.shape[1], z.dtype) if weight is None else weight))
    return out + top if far else out


def _tree_scores(m: Model, h: np.ndarray, last: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """Natural log probabilities of ids after hidden states and the classes of the ids before."""
    tree, net = m.tree, m.net
    place = tree.place16.take(goal)
    by = np.argsort(place, kind="stable")
    h, last, goal, place = h.take(by, axis=0), last.take(by), goal.take(by), place.take(by)
    got = (h * m.vectors.take(goal, axis=0)) @ np.ones(WIDTH, h.dtype)
    got += tree.bias.take(last * len(tree.classes) + goal)
    ends = np.searchsorted(place, tree.first).tolist()
    for c, (i, j) in enumerate(zip(ends[:-1:FAN], ends[FAN::FAN], strict=True)):
        both = m.both(c)
        for a in range(i, j, ROWS):
            b = min(j, a + ROWS)
            # What begins a word has one share whatever stands before.
            if tree.alike[c]:
                z, weight = np.concatenate([h[a:b], np.ones((b - a, 1), h.dtype)], axis=1) @ both, None
            else:
                z, weight = h[a:b] @ both[:-1], tree.both_weight.take(last[a:b] * FAN + c, axis=0).reshape(-1, FAN)
            got[a:b] -= _log_sums(z.reshape(-1, FAN), weight).reshape(-1, 2) @ np.ones(2, h.dtype)
    for leaf, (i, j, f, e) in enumerate(zip(ends[:-1], ends[1:], tree.first[:-1].tolist(), tree.first[1:].tolist(), strict=True)):
        if i == j or e - f == 1:
            continue
        vectors, weight = net.ids[f:e].T, tree.id_weight[:, f:e]
        for a in range(i, j, ROWS):
            b = min(j, a + ROWS)
            got[a:b] -= _log_sums(h[a:b] @ vectors, weight[0] if tree.alike[leaf // FAN] else weight.take(last[a:b], axis=0))
    out = np.empty_like(got)
    out[by] = got
    return out


def score(m: Model, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """log10 probability of each sequence; ``ids`` are the sequences one after another. An empty one has 0."""
    total = np.zeros(len(lengths))
    if not len(ids):
        return total
    windows = np.where(lengths > 0, 1 + np.maximum(0, -(-(lengths - WINDOW) // STRIDE)), 0)
    owner = np.repeat(np.arange(len(lengths)), windows)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    # Inputs are shifted by one: the start id stands before each sequence. Places past an end do not count.
    ends = np.cumsum(lengths + 1)
    starts = ends - lengths - 1
    stream = np.full(int(ends[-1]) + WINDOW + 1, START, np.int64)
    inside = np.ones(int(ends[-1]), bool)
    inside[starts] = False
    stream[: len(inside)][inside] = ids
    begin = starts[owner] + number * STRIDE
    left = lengths[owner] - number * STRIDE
    net = m.net
    # A text's first window counts from its beginning, the others from where the one before ends.
    for skip, some in ((0, np.nonzero(number == 0)[0]), (WINDOW - STRIDE, np.nonzero(number)[0])):
        place = np.arange(WINDOW)
        for i in range(0, len(some), BLOCK):
            one = some[i : i + BLOCK]
            at = begin.take(one)[:, None] + place
            h = np.concatenate([_forward(net, stream.take(at[j : j + CHUNK]), skip)[0] for j in range(0, len(at), CHUNK)])
            live = np.nonzero((place[skip:] < left.take(one)[:, None]).ravel())[0]
            at = at[:, skip:].ravel().take(live)
            got = _tree_scores(m, h.reshape(-1, WIDTH).take(live, axis=0), m.tree.classes.take(stream.take(at)), stream.take(at + 1))
            total += np.bincount(owner.take(one.take(live // (WINDOW - skip))), got, len(total))
    return total / np.log(10.0)
