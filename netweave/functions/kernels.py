"""Dense numerical kernels for one graph or matrix of bounded size: eigenvectors, linkage, cuts, support vectors."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Nodes up to which a graph is held dense in one task.
DENSE_NODES = 4096


def check_size(n: int) -> None:
    if n > DENSE_NODES:
        raise ValueError(f"a dense kernel takes at most {DENSE_NODES} nodes, not {n}")


def check_symmetric(a: np.ndarray) -> None:
    if not np.allclose(a, a.T, rtol=1e-9, atol=1e-12, equal_nan=True):
        raise ValueError("a Laplacian needs a symmetric network")


def canonical(vector: np.ndarray) -> np.ndarray:
    """The sign in which the largest entry (the first of several) is positive."""
    peak = np.abs(vector).round(9).argmax()
    return -vector if vector[peak] < 0 else vector


def laplacian(a: np.ndarray, fiedler: bool = True) -> np.ndarray:
    """Degree matrix (column sums) less ``a``; without ``fiedler`` scaled on both sides by the degrees' roots, 0 for isolated nodes.

    A network that is not symmetric raises ValueError.
    """
    check_symmetric(a)
    d = a.sum(axis=0)
    l = np.diag(d) - a  # noqa: E741
    if fiedler:
        return l
    root = np.divide(1.0, np.sqrt(np.abs(d)), out=np.zeros_like(d), where=d > 0)
    return root[:, None] * l * root[None, :]


def second_vector(a: np.ndarray, fiedler: bool = True) -> np.ndarray:
    """The eigenvector of the second smallest eigenvalue of the Laplacian of a symmetric ``a``."""
    _, vectors = np.linalg.eigh(laplacian(a, fiedler))
    return canonical(vectors[:, 1]) if len(a) > 1 else np.ones(len(a))


def page_rank(a: np.ndarray, in_rank: bool = False, damping: float = 0.85, steps: int = 500) -> np.ndarray:
    """Stationary scores of a small graph: rank runs from columns to rows of ``a`` if ``in_rank``, else along its edges."""
    own = a if in_rank else a.T
    scores = np.zeros(len(a))
    live = np.flatnonzero(own.sum(axis=0) != 0)
    n = len(live)
    if n <= 1:
        return scores
    m = own[np.ix_(live, live)]
    total = m.sum(axis=0)
    m = np.divide(m, total, out=np.zeros_like(m), where=total != 0)
    v = np.full(n, 1.0 / n)
    for _ in range(steps):
        w = damping * (m @ v) + (1 - damping) / n * v.sum()
        w /= w.sum()
        done = np.abs(w - v).max() < 1e-13
        v = w
        if done:
            break
    scores[live] = v
    return scores


def leading_vector(a: np.ndarray) -> np.ndarray:
    """The eigenvector of the largest eigenvalue, its real part, with a nonnegative sum."""
    values, vectors = np.linalg.eig(a)
    v = np.real(vectors[:, np.argmax(values)])
    return -v if v.sum() < 0 else v


#: How the distances of two merged clusters make the merged one's, by their sizes and own distance.
UPDATES = {
    "single": lambda dx, dy, dxy, nx, ny, nz: np.minimum(dx, dy),
    "complete": lambda dx, dy, dxy, nx, ny, nz: np.maximum(dx, dy),
    "average": lambda dx, dy, dxy, nx, ny, nz: (nx * dx + ny * dy) / (nx + ny),
    "weighted": lambda dx, dy, dxy, nx, ny, nz: (dx + dy) / 2,
    "centroid": lambda dx, dy, dxy, nx, ny, nz: np.sqrt(np.maximum((nx * dx**2 + ny * dy**2) / (nx + ny) - nx * ny * dxy**2 / (nx + ny) ** 2, 0)),
    "median": lambda dx, dy, dxy, nx, ny, nz: np.sqrt(np.maximum((dx**2 + dy**2) / 2 - dxy**2 / 4, 0)),
    "ward": lambda dx, dy, dxy, nx, ny, nz: np.sqrt(np.maximum(((nx + nz) * dx**2 + (ny + nz) * dy**2 - nz * dxy**2) / (nx + ny + nz), 0)),
}


def linkage(distance: np.ndarray, method: str = "average") -> np.ndarray:
    """Agglomeration of a distance matrix: rows (left, right, height, size), clusters numbered on from the items; ties go to the lowest pair."""
    if method not in UPDATES:
        raise ValueError(f"method {method!r} is none of {sorted(UPDATES)}")
    n = len(distance)
    d = np.array(distance, float)
    np.fill_diagonal(d, np.inf)
    name, size, z = np.arange(n), np.ones(n), []
    for step in range(n - 1):
        x, y = divmod(int(np.argmin(d)), n)
        x, y = min(x, y), max(x, y)
        left, right = sorted((name[x], name[y]))
        z.append((left, right, d[x, y], size[x] + size[y]))
        others = np.isfinite(d[x]) & np.isfinite(d[y])
        d[x, others] = d[others, x] = UPDATES[method](d[x, others], d[y, others], d[x, y], size[x], size[y], size[others])
        d[x, y] = d[y, x] = np.inf
        d[y, :] = d[:, y] = np.inf
        size[x] += size[y]
        name[x] = n + step
    return np.array(z).reshape(-1, 4)


def cut(z: np.ndarray, n_clusters: int | None = None, height: float | None = None) -> np.ndarray:
    """Labels of the items after all merges up to ``height``, or until ``n_clusters`` are left; numbered by their first item."""
    n = len(z) + 1
    steps = int((z[:, 2] <= height).sum()) if height is not None else n - (n_clusters or 1)
    parent = list(range(2 * n - 1))
    for k in range(max(0, min(steps, n - 1))):
        parent[int(z[k, 0])] = parent[int(z[k, 1])] = n + k
    labels, names = np.zeros(n, int), {}
    for i in range(n):
        root = i
        while parent[root] != root:
            root = parent[root]
        labels[i] = names.setdefault(root, len(names))
    return labels


def leaf_order(z: np.ndarray) -> list[int]:
    """The items as a dendrogram has them from left to right."""
    n = len(z) + 1
    order, stack = [], [2 * n - 2]
    while stack:
        k = stack.pop()
        if k < n:
            order.append(int(k))
        else:
            stack += [int(z[k - n, 1]), int(z[k - n, 0])]
    return order


def circle(n: int) -> np.ndarray:
    turn = 2 * np.pi * np.arange(n) / max(n, 1)
    return np.column_stack([np.cos(turn), np.sin(turn)])


def spring(a: np.ndarray, steps: int = 50) -> np.ndarray:
    """Places by springs of ``a``'s weights against a push between all nodes, from a circle; the moves shrink to none."""
    n = len(a)
    at, near = circle(n), 1 / np.sqrt(max(n, 1))
    pull = np.abs(a) * (1 - np.eye(n))
    for k in range(steps):
        square = (at**2).sum(axis=1)
        far = np.maximum(np.sqrt(np.maximum(square[:, None] + square[None, :] - 2 * at @ at.T, 0)), 0.01)
        force = near**2 / far**2 - pull * far / near
        move = at * force.sum(axis=1)[:, None] - force @ at
        length = np.maximum(np.sqrt((move**2).sum(axis=1)), 0.01)
        at = at + move / length[:, None] * (0.1 * (1 - k / steps))
    at = at - at.mean(axis=0)
    return at / max(np.abs(at).max(), 1e-12)


def support_vector(x: np.ndarray, y: np.ndarray, c: float = 1.0, steps: int = 60) -> np.ndarray:
    """Weights, and last the intercept, of the linear machine with squared hinge loss; the intercept is penalised like a weight.

    Newton's method on the primal with halved steps; ``y`` is -1 or 1.
    """
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])

    def loss(w: np.ndarray) -> float:
        return 0.5 * w @ w + c * (np.maximum(1 - y * (a @ w), 0) ** 2).sum()

    now = loss(w)
    for _ in range(steps):
        short = 1 - y * (a @ w)
        active = short > 0
        gradient = w - 2 * c * a[active].T @ (y[active] * short[active])
        if np.abs(gradient).max() < 1e-9:
            break
        step = np.linalg.solve(np.eye(len(w)) + 2 * c * a[active].T @ a[active], gradient)
        scale = 1.0
        while loss(w - scale * step) > now and scale > 1e-8:
            scale /= 2
        w = w - scale * step
        now = loss(w)
    return w


def predict(x: np.ndarray, y: np.ndarray, test: np.ndarray) -> np.ndarray:
    """0 or 1 for the rows of ``test``; a training set of one class predicts it."""
    if len(np.unique(y)) < 2:
        return np.full(len(test), int(y[0]) if len(y) else 0)
    w = support_vector(x, np.where(y == 1, 1.0, -1.0))
    return (test @ w[:-1] + w[-1] > 0).astype(int)


#: Margins this near to a bound are not settled by it.
NEAR = 1e-7


def reaches(a: np.ndarray, margin: np.ndarray, inverse: np.ndarray, c: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """(leverage, reach) of the rows of ``a``: their length under the inverse Hessian, and how far, under the Hessian, one Newton step
    moves the weights when the row is left out."""
    square = np.einsum("ij,jk,ik->i", a, inverse, a, optimize=True)
    return np.sqrt(square), 2 * c * np.maximum(1 - margin, 0) * np.sqrt(square) / np.maximum(1 - 2 * c * square, 1e-12)


@dataclass
class Solved:
    """A fitted machine from which subjects are left out one at a time, by updates of low rank.

    Within ``radius`` of the weights, by the length that the Hessian gives, only the subjects ``near`` the margin can enter or leave
    the loss: a score moves by no more than the row's leverage times that length. All others add a ``fixed`` quadratic with ``pull``.
    A minimum found inside the radius is the machine's own, since the loss is convex; outside it is not settled.
    """

    weights: np.ndarray
    fixed: np.ndarray
    pull: np.ndarray
    near: np.ndarray
    signs: np.ndarray
    radius: float
    c: float = 1.0
    on: np.ndarray = field(init=False)
    inverse: np.ndarray = field(init=False)
    least: np.ndarray = field(init=False)
    ratio: float = field(init=False)

    def __post_init__(self) -> None:
        self.on = 1 - self.signs * (self.near @ self.weights) > 0
        active = self.near[self.on]
        whole = self.fixed + 2 * self.c * active.T @ active
        self.inverse, self.least = np.linalg.inv(whole), np.linalg.inv(self.fixed)
        self.ratio = float(np.abs(np.linalg.eigvals(self.least @ whole)).max())

    def stays(self, a: np.ndarray, signs: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Whether the rows of ``a`` are predicted right by the machines without them, as a bound for all rows at once says.

        Within the radius the Hessian without a row is at least K: the fixed one, less the row's own part if it is in it. So the weights
        move by no more than the row's pull under K, and its margin falls by no more than the pull times its squared length under K's
        inverse; nothing on the radius is as low as the start where twice that move, by the Hessian of all rows, ends inside.
        """
        margin = signs * (a @ self.weights)
        square = np.einsum("ij,jk,ik->i", a, self.least, a, optimize=True)
        share = np.where(places < 0, 1 - 2 * self.c * square, 1.0)
        safe, pull = np.maximum(share, 1e-12), 2 * self.c * np.maximum(1 - margin, 0)
        inside = 2 * pull * np.sqrt(self.ratio * square) / safe < self.radius
        return (share > 1e-6) & inside & (margin - pull * square / safe > NEAR)

    def without(self, a: np.ndarray, sign: float, place: int = -1, steps: int = 60) -> tuple[np.ndarray, bool]:
        """(weights without a subject, whether they are settled); ``place`` is the subject's among the near ones, -1 if it is none.

        The Hessian of each Newton step is that of all subjects, less the one left out, more or less those that changed sides: its
        inverse comes from the given one by a system of as many rows as changed.
        """
        twice, own = 2 * self.c, place < 0
        others = np.arange(len(self.near)) != place

        def told(v: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
            short = np.where(others, np.maximum(1 - self.signs * (self.near @ v), 0), 0)
            along, off = self.fixed @ v, own * (1 - sign * (a @ v))
            loss = 0.5 * v @ along - self.pull @ v + self.c * (short @ short - off**2)
            return loss, along - self.pull - twice * self.near.T @ (self.signs * short) + twice * sign * off * a, short > 0

        least = 1e-9 + 1e-12 * np.abs(self.pull).sum()
        v, (loss, gradient, on) = self.weights, told(self.weights)
        for _ in range(steps):
            if np.abs(gradient).max() <= least:
                break
            changed = on != self.on
            rows, change = self.near[changed], np.where(on[changed], twice, -twice)
            if own:
                rows, change = np.vstack([rows, a]), np.append(change, -twice)
            step, turned = self.inverse @ gradient, self.inverse @ rows.T
            if len(rows):
                step = step - turned @ np.linalg.solve(np.diag(1 / change) + rows @ turned, rows @ step)
            scale = 1.0
            after = told(v - step)
            while after[0] > loss + 1e-12 * abs(loss) and scale > 1e-8:
                scale /= 2
                after = told(v - scale * step)
            v, (loss, gradient, on) = v - scale * step, after
        moved = v - self.weights
        length = moved @ self.fixed @ moved + twice * ((self.near[self.on] @ moved) ** 2).sum()
        return v, bool(np.abs(gradient).max() <= least and length <= self.radius**2)


def left_out(x: np.ndarray, y: np.ndarray, c: float = 1.0, spread: float = 2.0) -> np.ndarray:
    """0 or 1 for every row of ``x``, by the machine of all others; rows of one class predict it, none predict 0.

    The machine of all rows is updated for each row that its margin and then ``Solved.stays`` leave open; the radius is ``spread`` times the longest first
    step. A row whose update is not settled is fitted anew.
    """
    ones = int((y == 1).sum())
    if not ones or ones == len(y):
        return np.full(len(y), int(bool(ones) and len(y) > 1))
    signs, a = np.where(y == 1, 1.0, -1.0), np.hstack([x, np.ones((len(x), 1))])
    w = support_vector(x, signs, c)
    score = a @ w
    margin = signs * score
    last = np.where(y == 1, ones, len(y) - ones) == 1
    guess = np.where(last, y != 1, score > 0).astype(int)
    unsure = np.flatnonzero(~last & (margin >= -NEAR) & (margin <= 1 + NEAR))
    active = margin < 1
    if not len(unsure):
        return guess
    leverage, reach = reaches(a, margin, np.linalg.inv(np.eye(len(w)) + 2 * c * a[active].T @ a[active]), c)
    radius = spread * reach[unsure].max()
    near = np.abs(1 - margin) <= leverage * radius + NEAR
    fixed = active & ~near
    solved = Solved(w, np.eye(len(w)) + 2 * c * a[fixed].T @ a[fixed], 2 * c * a[fixed].T @ signs[fixed], a[near], signs[near], radius, c)
    places = np.where(near, np.cumsum(near) - 1, -1)
    for i in unsure[~solved.stays(a[unsure], signs[unsure], places[unsure])]:  # those that stay keep their guess
        v, settled = solved.without(a[i], signs[i], int(places[i]))
        if not settled:
            v = support_vector(np.delete(x, i, 0), np.delete(signs, i), c)
        guess[i] = int(a[i] @ v > 0)
    return guess


def balanced_rate(predicted: np.ndarray, label: np.ndarray) -> float:
    """Mean over predicted classes of the share that is of that class."""
    return float(np.mean([(label[predicted == k] == k).mean() for k in np.unique(predicted)]))
