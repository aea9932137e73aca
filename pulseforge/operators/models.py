"""Leave-one-person-out models: ridge and logistic regression by sums, the networks' numerics, mutual information.

Scaler, threshold and ranking are fitted on a fold's training rows only. networks.py fits the networks of all folds together.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseforge.functions.steps import cut


def scaler(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and population deviations; a deviation of 0 counts as 1."""
    s = x.std(0)
    return x.mean(0), np.where(s > 0, s, 1.0)


def descend(w: np.ndarray, steps: int = 200, memory: int = 10, tol: float = 1e-7, ftol: float = 0.0):
    """L-BFGS with backtracking as a generator: yields points, is sent (value, gradient) there, and returns (point, steps, converged).

    It has converged once no component of the gradient exceeds tol, or a step gains no more than ftol of the value (of 1,
    if that is more). Whoever drives it may evaluate the points of many searches in one pass over the rows.
    """
    value, grad = yield w
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for done in range(steps):
        if np.abs(grad).max() < tol:
            return w, done, True
        q, alphas = grad.copy(), []
        for s, y in reversed(past):
            a = s @ q / (s @ y)
            alphas.append(a)
            q -= a * y
        if past:
            s, y = past[-1]
            q *= s @ y / (y @ y)
        for (s, y), a in zip(past, reversed(alphas), strict=True):
            q += (a - y @ q / (s @ y)) * s
        step, slope = 1.0 if past else min(1.0, 1 / np.abs(grad).sum()), grad @ q
        if slope <= 0:
            past.clear()
            q, slope = grad, grad @ grad
        while step > 1e-12:
            new = w - step * q
            value2, grad2 = yield new
            if value2 <= value - 1e-4 * step * slope:
                break
            step /= 2
        else:
            return w, done, False
        s, y = new - w, grad2 - grad
        if s @ y > 1e-12:
            past = [*past, (s, y)][-memory:]
        gain = value - value2
        w, value, grad = new, value2, grad2
        if gain <= ftol * max(abs(value), abs(value + gain), 1.0):
            return w, done + 1, True
    return w, steps, bool(np.abs(grad).max() < tol)


def descended(f, walk) -> tuple[np.ndarray, int, bool]:
    """What the search `walk` returns when f answers it."""
    point = next(walk)
    while True:
        try:
            point = walk.send(f(point))
        except StopIteration as end:
            return end.value


def minimise(f, w: np.ndarray, steps: int = 200, memory: int = 10, tol: float = 1e-7, ftol: float = 0.0) -> np.ndarray:
    """The point that descend() finds; f gives value and gradient."""
    return descended(f, descend(w, steps, memory, tol, ftol))[0]


def fit_logistic(x: np.ndarray, y: np.ndarray, c: float = 1.0, steps: int = 2000) -> np.ndarray:
    """Balanced L2-penalised weights, the intercept last and without penalty."""
    n, pos = len(y), max(1.0, y.sum())
    weight = np.where(y == 1, n / (2 * pos), n / (2 * max(1.0, n - pos)))
    wide = np.column_stack([x, np.ones(n)])

    def loss(w):
        z = wide @ w
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        value = c * (weight * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * w[:-1] @ w[:-1]
        return value, c * wide.T @ (weight * (p - y)) + np.append(w[:-1], 0)

    return minimise(loss, np.zeros(x.shape[1] + 1), steps)


#: Least gain of a step, as a share of the value, with which a network's fit goes on.
FTOL = 2.220446049250313e-09

#: Rows whose values and gradients are computed at once: they stay in a core's cache, and products stay too small for BLAS to start threads beside the other tasks'.
CHUNK = 4096


def logistic(v: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-v)), in one array."""
    h = np.clip(v, -500, 500)
    np.negative(h, out=h)
    np.exp(h, out=h)
    h += 1
    return np.reciprocal(h, out=h)


ACTIVATIONS = {
    # value, and slope by that value
    "logistic": (logistic, lambda h: h * (1 - h)),
    "tanh": (np.tanh, lambda h: 1 - h * h),
    "relu": (lambda v: np.maximum(v, 0), lambda h: (h > 0).astype(float)),
    "identity": (lambda v: v, np.ones_like),
}


def architectures(spec: str) -> list[tuple[int, ...]]:
    """Hidden layers that a text names: commas part architectures, 10x2 stands for two layers of ten."""
    found = []
    for part in filter(None, (p.strip().lower() for p in str(spec).split(","))):
        width, _, depth = part.partition("x")
        found.append((int(width),) * int(depth or 1))
    if not found:
        raise ValueError(f"no architecture in {spec!r}")
    return found


class Network:
    """Hidden layers of one kind of units, and linear outputs (task regression) or one logistic output (task classes)."""

    def __init__(self, inputs: int, hidden: int | tuple[int, ...], outputs: int, alpha: float = 0.01, seed: int = 0, activation: str = "logistic", task: str = "regression", solver: str = "lbfgs", rate: float = 1e-3, early_stopping: bool = False, tol: float = 1e-4):
        rng = np.random.default_rng(seed)
        sizes = [inputs, *((hidden,) if isinstance(hidden, int) else hidden), outputs]
        self.shapes = [s for a, b in zip(sizes, sizes[1:], strict=False) for s in ((a, b), (b,))]
        self.settings = {"hidden": hidden, "alpha": alpha, "seed": seed, "activation": activation, "task": task, "solver": solver, "rate": rate, "early_stopping": early_stopping, "tol": tol}
        self.tol = tol
        self.alpha, self.activation, self.task, self.solver, self.rate, self.early_stopping, self.seed = alpha, activation, task, solver, rate, early_stopping and solver != "lbfgs", seed
        gain = 2 if activation == "logistic" else 6
        bounds = [np.sqrt(gain / (a + b)) for a, b in zip(sizes, sizes[1:], strict=False) for _ in range(2)]
        self.w = np.concatenate([rng.uniform(-b, b, int(np.prod(s))) for s, b in zip(self.shapes, bounds, strict=True)])

    def parts(self, w: np.ndarray) -> list[np.ndarray]:
        cuts = np.cumsum([int(np.prod(s)) for s in self.shapes])[:-1]
        return [v.reshape(s) for v, s in zip(np.split(w, cuts), self.shapes, strict=True)]

    def layers(self, x: np.ndarray, w: np.ndarray) -> list[np.ndarray]:
        """The inputs and the values of all hidden layers, a row for each unit, so that numpy's inner loops are long."""
        parts, out = self.parts(w), [np.ascontiguousarray(x.T)]
        for a, b in zip(parts[:-2:2], parts[1:-2:2], strict=True):
            z = a.T @ out[-1]
            z += b[:, None]
            out.append(ACTIVATIONS[self.activation][0](z))
        return out

    def hidden(self, x: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
        """Values of the last hidden layer."""
        return self.layers(x, self.w if w is None else w)[-1].T

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Outputs; probabilities for classes."""
        c, d = self.parts(self.w)[-2:]
        out = np.empty((len(x), len(d)))
        for lo in range(0, len(x), CHUNK):
            out[lo : lo + CHUNK] = self.hidden(x[lo : lo + CHUNK]) @ c + d
        return logistic(out) if self.task == "classes" else out

    def sums(self, w: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        """Half the squared errors (log-losses for classes) of all rows, and the gradient of that sum."""
        parts, value, total = self.parts(w), 0.0, np.zeros(len(w))
        layers, slope = len(parts) // 2, ACTIVATIONS[self.activation][1]
        grads = self.parts(total)  # views of the total
        for lo in range(0, len(x), CHUNK):
            values, target = self.layers(x[lo : lo + CHUNK], w), y[lo : lo + CHUNK].T
            back = parts[-2].T @ values[-1]
            back += parts[-1][:, None]
            if self.task == "classes":
                value += float((np.maximum(back, 0) + np.log1p(np.exp(-np.abs(back))) - target * back).sum())
                back = logistic(back)
                back -= target
            else:
                back -= target
                value += float(np.vdot(back, back)) / 2
            for k in range(layers - 1, -1, -1):
                grads[2 * k] += values[k] @ back.T
                grads[2 * k + 1] += back.sum(1)
                if k:
                    back = parts[2 * k] @ back
                    back *= slope(values[k])
        return value, total

    def penalised(self, w: np.ndarray, value: float, grad: np.ndarray, n: int) -> tuple[float, np.ndarray]:
        """Mean and gradient from the sums over n rows, with the L2 penalty of all weights but the intercepts."""
        matrices = np.concatenate([np.full(int(np.prod(s)), len(s) == 2) for s in self.shapes])
        held = np.where(matrices, w, 0.0)
        return (value + self.alpha * float(held @ held) / 2) / n, (grad + self.alpha * held) / n

    def loss(self, w: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        """Half the mean squared error (mean log-loss for classes) with the L2 penalty, and its gradient."""
        return self.penalised(w, *self.sums(w, x, y), len(x))

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 1000) -> Network:
        """lbfgs over all rows, or adam or sgd over batches of 200; early stopping (adam, sgd) holds out a tenth of the rows and ends ten epochs after the best."""
        if self.solver == "lbfgs":
            self.w = minimise(lambda w: self.loss(w, x, y), self.w, steps, tol=self.tol, ftol=FTOL)
            return self
        rng = np.random.default_rng(self.seed)
        order = rng.permutation(len(x))
        held, own = (order[: max(1, len(x) // 10)], order[max(1, len(x) // 10) :]) if self.early_stopping else (order[:0], order)
        m, v, best, kept, calm, t = np.zeros_like(self.w), np.zeros_like(self.w), np.inf, self.w.copy(), 0, 0
        for _ in range(steps):
            rng.shuffle(own)
            seen = 0.0
            for lo in range(0, len(own), 200):
                at = own[lo : lo + 200]
                value, g = self.loss(self.w, x[at], y[at])
                seen += value * len(at) / len(own)
                t += 1
                if self.solver == "adam":
                    m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                    self.w = self.w - self.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
                else:
                    m = 0.9 * m - self.rate * g
                    self.w = self.w + 0.9 * m - self.rate * g
            now = self.loss(self.w, x[held], y[held])[0] if len(held) else seen
            if now < best - 1e-4:
                best, kept, calm = now, self.w.copy(), 0
            else:
                calm += 1
                if calm > 10:
                    break
        if len(held):
            self.w = kept
        return self


def tune_head(net: Network, x: np.ndarray, y: np.ndarray, xv: np.ndarray, yv: np.ndarray, rate: float = 0.01, steps: int = 500, l2: float = 1e-3, patience: int = 50, bias_only: bool = False) -> tuple[Network, int]:
    """Full-batch Adam on the last layer with the hidden layer frozen; keeps the weights of the best validation error and its epoch."""
    h, hv = net.hidden(x), net.hidden(xv)
    c, d = (p.copy() for p in net.parts(net.w)[-2:])
    m, v = [np.zeros_like(c), np.zeros_like(d)], [np.zeros_like(c), np.zeros_like(d)]
    best, at, kept = np.inf, 0, (c.copy(), d.copy())
    for k in range(1, steps + 1):
        e = h @ c + d - y
        grads = [np.zeros_like(c) if bias_only else 2 * h.T @ e / len(x) + 2 * l2 * c, 2 * e.mean(0)]
        for i, (p, g) in enumerate(zip((c, d), grads, strict=True)):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            p -= rate * (m[i] / (1 - 0.9**k)) / (np.sqrt(v[i] / (1 - 0.999**k)) + 1e-8)
        err = np.abs(hv @ c + d - yv).mean(0).sum()
        if err < best - 1e-3:
            best, at, kept = err, k, (c.copy(), d.copy())
        elif k - at > patience:
            break
    tuned = Network(net.shapes[0][0], net.settings["hidden"], net.shapes[-1][0], net.alpha, activation=net.activation)
    tuned.w = np.concatenate([net.w[: len(net.w) - kept[0].size - kept[1].size], kept[0].ravel(), kept[1].ravel()])
    return tuned, at


def neighbour_distances(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """Exact distance (the greater of those in x and y) of each of at least k + 1 points to its k-th neighbour.

    Points lie in strips of about equal size by x, sorted by y inside. The nearest in y of the own strip bound the distance;
    then strips are visited outwards for as long as they come within the bound, and in each the points of that range of y.
    """
    n = len(x)
    width = min(n, max(k + 1, int(np.sqrt(n * k))))
    strips = n // width
    strip = np.empty(n, np.int64)
    strip[np.argsort(x, kind="stable")] = np.minimum(np.arange(n) // width, strips - 1)
    order = np.lexsort((y, strip))
    x, y, strip = x[order], y[order], strip[order]
    start = np.searchsorted(strip, np.arange(strips + 1))
    least, most = np.minimum.reduceat(x, start[:-1]), np.maximum.reduceat(x, start[:-1])
    ys = np.sort(y)
    place = strip * (n + 1) + np.searchsorted(ys, y)  # ascending
    near = np.clip(np.arange(n) - k // 2, start[strip], start[strip + 1] - k - 1)[:, None] + np.arange(k + 1)
    bound = np.maximum(np.abs(x[near] - x[:, None]), np.abs(y[near] - y[:, None])).max(1)
    best = np.full((n, k + 1), np.inf)

    def visit(at, other):
        wide = bound[at] * (1 + 1e-9) + 1e-300
        lo = np.searchsorted(place, other * (n + 1) + np.searchsorted(ys, y[at] - wide, "left"))
        hi = np.searchsorted(place, other * (n + 1) + np.searchsorted(ys, y[at] + wide, "right"))
        some = hi > lo
        at, lo, size = at[some], lo[some], (hi - lo)[some]
        by = np.argsort(size)
        at, lo, size = at[by], lo[by], size[by]
        i = 0
        while i < len(at):
            j = min(len(at), i + 4096)
            while j > i + 1 and (j - i) * size[j - 1] > 1 << 20:
                j = i + (j - i + 1) // 2
            mine, many = at[i:j], np.arange(size[j - 1])
            those = np.minimum(lo[i:j, None] + many, n - 1)
            away = np.maximum(np.abs(x[those] - x[mine, None]), np.abs(y[those] - y[mine, None]))
            away[many >= size[i:j, None]] = np.inf
            best[mine] = np.partition(np.hstack([best[mine], away]), k, 1)[:, : k + 1]
            bound[mine] = np.minimum(bound[mine], best[mine].max(1))
            i = j

    visit(np.arange(n), strip)
    for way in (1, -1):
        at, step = np.arange(n), 0
        while len(at):
            step += way
            at = at[(strip[at] + step >= 0) & (strip[at] + step < strips)]
            other = strip[at] + step
            gap = least[other] - x[at] if way > 0 else x[at] - most[other]
            at = at[gap <= bound[at]]
            visit(at, strip[at] + step)
    told = np.empty(n)
    told[order] = best.max(1)
    return told


def neighbours(x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each of at least k + 1 points k of its nearest others' places, and a distance (the greater of those in x and y) within which no further one lies.

    Points lie in strips of about equal size by x, sorted by y inside. The nearest in y of the own strip bound the distance;
    then strips are visited outwards for as long as they come within the bound, and in each the points of that range of y.
    """
    n = len(x)
    width = min(n, max(k + 1, int(np.sqrt(n * k))))
    strips = n // width
    strip = np.empty(n, np.int64)
    strip[np.argsort(x, kind="stable")] = np.minimum(np.arange(n) // width, strips - 1)
    order = np.lexsort((y, strip))
    x, y, strip = x[order], y[order], strip[order]
    start = np.searchsorted(strip, np.arange(strips + 1))
    least, most = np.minimum.reduceat(x, start[:-1]), np.maximum.reduceat(x, start[:-1])
    ys = np.sort(y)
    place = strip * (n + 1) + np.searchsorted(ys, y)  # ascending
    near = np.clip(np.arange(n) - k // 2, start[strip], start[strip + 1] - k - 1)[:, None] + np.arange(k + 1)
    bound = np.maximum(np.abs(x[near] - x[:, None]), np.abs(y[near] - y[:, None])).max(1)
    best, who = np.full((n, k + 1), np.inf), np.zeros((n, k + 1), np.int64)

    def visit(at, other):
        wide = bound[at] * (1 + 1e-9) + 1e-300
        lo = np.searchsorted(place, other * (n + 1) + np.searchsorted(ys, y[at] - wide, "left"))
        hi = np.searchsorted(place, other * (n + 1) + np.searchsorted(ys, y[at] + wide, "right"))
        some = hi > lo
        at, lo, size = at[some], lo[some], (hi - lo)[some]
        by = np.argsort(size)
        at, lo, size = at[by], lo[by], size[by]
        i = 0
        while i < len(at):
            j = min(len(at), i + 4096)
            while j > i + 1 and (j - i) * size[j - 1] > 1 << 18:
                j = i + (j - i + 1) // 2
            mine, many = at[i:j], np.arange(size[j - 1])
            those = np.minimum(lo[i:j, None] + many, n - 1)
            away = np.maximum(np.abs(x[those] - x[mine, None]), np.abs(y[those] - y[mine, None]))
            away[those == mine[:, None]] = -1.0  # the point itself stays the first
            away[many >= size[i:j, None]] = np.inf
            away, those = np.hstack([best[mine], away]), np.hstack([who[mine], those])
            pick = np.argpartition(away, k, 1)[:, : k + 1]
            best[mine], who[mine] = np.take_along_axis(away, pick, 1), np.take_along_axis(those, pick, 1)
            bound[mine] = np.minimum(bound[mine], best[mine].max(1))
            i = j

    visit(np.arange(n), strip)
    for way in (1, -1):
        at, step = np.arange(n), 0
        while len(at):
            step += way
            at = at[(strip[at] + step >= 0) & (strip[at] + step < strips)]
            other = strip[at] + step
            gap = least[other] - x[at] if way > 0 else x[at] - most[other]
            at = at[gap <= bound[at]]
            visit(at, strip[at] + step)
    first = np.argmin(best, 1)  # the point itself
    reach = best.max(1)
    who[np.arange(n), first], first[:] = who[:, 0], 0
    told, far = np.empty((n, k), np.int64), np.empty(n)
    told[order], far[order] = order[who[:, 1:]], reach
    return told, far


def digamma(v: np.ndarray | float) -> np.ndarray:
    """Derivative of the logarithm of the gamma function for numbers of at least 1: six steps up, then the asymptotic series."""
    v = np.asarray(v, float)
    w = v + 6
    series = np.log(w) - 1 / (2 * w) - 1 / (12 * w**2) + 1 / (120 * w**4) - 1 / (252 * w**6)
    return series - sum(1 / (v + i) for i in range(6))


#: Of a neighbour's distance, what counts as nearer: the neighbour itself never does, however its distance was rounded.
NEARER = 1 - 1e-9


def mutual_information(x: np.ndarray, y: np.ndarray, k: int = 3, ties: tuple[np.ndarray, np.ndarray] | None = None) -> float:
    """Nearest-neighbour estimate of the mutual information of two columns in nats, at least 0.

    Values are standardised; 1e-10 of the tie-breakers (numbers from 0 to 1; by default the ranks) is added to them.
    """
    n = len(x)
    if n <= k + 1:
        return 0.0
    u, v = ties if ties else (np.argsort(np.argsort(w, kind="stable")) for w in (x, y))
    x, y = ((w - w.mean()) / (w.std() or 1.0) + 1e-10 * t for w, t in ((x.astype(float), u), (y.astype(float), v)))
    total = 0.0
    r = neighbour_distances(x, y, k) * NEARER
    for v in (x, y):
        own = np.sort(v)
        count = np.searchsorted(own, v + r, "left") - np.searchsorted(own, v - r, "right")
        total -= digamma(np.maximum(count, 1)).sum()
    return max(0.0, float(digamma(n) + digamma(k) + total / n))


def loso(df: DataFrame, cols: list[str], y: str, person: str, keys: list[str], model: str = "logistic", hidden: int | tuple[int, ...] = 10, alpha: float = 0.01, fpr: float = 0.05, rest: str | None = None) -> DataFrame:
    """Out-of-fold predictions: keys, person, y, p, thr (threshold at the training rows' false-positive rate; null for regression).

    model: logistic, classifier (a network with log-loss) or network (regression). The threshold comes from training rows
    of label 0, of those only the ones where the column `rest` is true if it is given. A person without others has nulls.
    """
    from pulseforge.operators import networks

    if model == "logistic":
        return loso_logistic(df, cols, y, person, keys, fpr, rest)
    return networks.loso(df, cols, y, person, keys, model, hidden, alpha, fpr, rest)


def person_moments(df: DataFrame, columns: list[str], person: str) -> DataFrame:
    """person, n and moments: sums of the products of (1, columns), row by row of that square matrix.

    Each batch adds up its rows by person in numpy, and a person's few partial sums are added in Spark; no row is shuffled.
    """
    kind, size = dict(df.dtypes)[person], len(columns) + 1

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            who = pc.dictionary_encode(b.column(0))
            codes, people = who.indices.to_numpy(zero_copy_only=False), who.dictionary
            x = np.column_stack([np.ones(b.num_rows), *[b.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(columns))]])
            sums = [(x[codes == k].T @ x[codes == k]).ravel().tolist() for k in range(len(people))]
            yield pa.RecordBatch.from_arrays([people, pa.array(sums, pa.list_(pa.float64()))], names=[person, "part"])

    whole = df.where(F.col(person).isNotNull() & F.forall(F.array(*[F.col(c).cast("double") for c in columns]), lambda v: v.isNotNull() & ~F.isnan(v)))
    parts = whole.select(person, *[F.col(c).cast("double").alias(c) for c in columns]).mapInArrow(run, f"{person} {kind}, part array<double>")
    sums = parts.select(person, F.posexplode("part").alias("i", "v")).groupBy(person, "i").agg(F.sum("v").alias("v"))
    rows = sums.groupBy(person).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("moments"))  # size**2 numbers
    return rows.select(person, F.col("moments")[0].alias("n"), "moments").where(F.size("moments") == size * size)


def loso_ridge(df: DataFrame, cols: list[str], targets: list[str], person: str, alpha: float = 10.0) -> DataFrame:
    """df with <target>_pred: ridge on columns that are standardised on the other persons, penalty alpha, intercept free.

    The moments of all persons less those of the held-out one give each fold's normal equations, so rows are read once,
    whatever the number of folds. A person without others has null predictions. Also <target>_base, the others' mean.
    """
    d, t = len(cols), len(targets)
    size = d + t + 1
    own = person_moments(df, [*cols, *targets], person)
    total = own.select(F.posexplode("moments").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("all"))  # one row
    kind = dict(df.dtypes)[person]

    def solve(frames):
        import pandas as pd

        for f in frames:
            out = []
            for who, mine, all_ in zip(f[person], f["moments"], f["all"], strict=True):
                m = (np.array(all_) - np.array(mine)).reshape(size, size)
                n = m[0, 0]
                if n < 1:
                    out.append((who, None, None, None))
                    continue
                mean = m[0] / n
                c = m[1:, 1:] - n * np.outer(mean[1:], mean[1:])
                spread = np.maximum(np.diag(c)[:d] / n, 0)
                spread = np.where(spread > 1e-24, spread, 1.0)
                w = np.linalg.lstsq(c[:d, :d] + alpha * np.diag(spread), c[:d, d:], rcond=None)[0]
                out.append((who, w.T.ravel().tolist(), (mean[d + 1 :] - mean[1 : d + 1] @ w).tolist(), mean[d + 1 :].tolist()))
            yield pd.DataFrame(out, columns=[person, "__w", "__b", "__m"])

    fits = own.join(F.broadcast(total)).mapInPandas(solve, f"{person} {kind}, __w array<double>, __b array<double>, __m array<double>")
    rows = df.join(fits, person, "left")
    x = F.array(*[F.col(c).cast("double") for c in cols])
    dot = lambda j: F.aggregate(F.zip_with(x, F.slice("__w", j * d + 1, d), lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    new = {f"{c}_pred": dot(j) + F.col("__b")[j] for j, c in enumerate(targets)} | {f"{c}_base": F.col("__m")[j] for j, c in enumerate(targets)}
    return rows.withColumns(new).drop("__w", "__b", "__m")


def newton_logistic(df: DataFrame, cols: list[str], y: str, person: str, c: float = 1.0, steps: int = 30, tol: float = 1e-8) -> tuple[list, np.ndarray]:
    """Persons, and for each the weights (intercept last, in raw units) of a balanced L2 logistic regression on all others.

    All folds take their Newton steps together: one pass over the rows adds up gradient and Hessian of every fold, so no
    row is copied and no fold meets in one task. What comes to the driver is folds x columns**2 numbers a pass.
    """
    d = len(cols)
    told = person_moments(df, [*cols, y], person).collect()  # a row of (d + 2)**2 numbers for each person
    if not told:
        return [], np.zeros((0, d + 1))
    people = sorted(r[person] for r in told)
    by = {r[person]: np.array(r["moments"]).reshape(d + 2, d + 2) for r in told}
    total = sum(by.values())

    def spread(m):
        n = max(m[0, 0], 1)
        mean = m[0, 1 : d + 1] / n
        dev = np.sqrt(np.maximum(np.diag(m)[1 : d + 1] / n - mean * mean, 0))
        return mean, np.where(dev > 1e-12, dev, 1.0)

    fits, scale, weights, turns = np.zeros((len(people), d + 1)), [], [], []
    middle, unit = spread(total)
    for p in people:
        m = total - by[p]
        n, pos = m[0, 0], m[0, d + 1]
        mean, dev = spread(m)
        scale.append((mean, dev))
        weights.append((n / (2 * max(pos, 1.0)), n / (2 * max(n - pos, 1.0))))
        # rows are scaled once for all folds; this takes them to the fold's own scale
        turn = np.diag(np.append(unit / dev, 1.0))
        turn[:-1, -1] = (middle - mean) / dev
        turns.append(turn)
    turns, (down, up) = np.array(turns), np.array(weights)[:, ::-1].T
    rows = df.select(person, F.col(y).cast("double"), *[F.col(x).cast("double") for x in cols]).where(F.forall(F.array(y, *cols), lambda v: v.isNotNull() & ~F.isnan(v)))

    def sums(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        grad, hess = np.zeros((len(people), d + 1)), np.zeros((len(people), d + 1, d + 1))
        slopes = np.einsum("kij,ki->jk", turns, fits)
        for b in batches:
            who = pc.index_in(b.column(0), value_set=pa.array(people, b.column(0).type)).fill_null(-1).to_numpy(zero_copy_only=False)
            target = b.column(1).to_numpy(zero_copy_only=False)
            x = np.column_stack([*[(b.column(i + 2).to_numpy(zero_copy_only=False) - middle[i]) / unit[i] for i in range(d)], np.ones(b.num_rows)])
            q = 1 / (1 + np.exp(-np.clip(x @ slopes, -500, 500)))
            weight = np.where((target == 1)[:, None], up, down)
            own = np.flatnonzero(who >= 0)
            weight[own, who[own]] = 0.0  # held out
            grad += (weight * (q - target[:, None])).T @ x
            weight *= q * (1 - q)
            for k in range(len(people)):
                hess[k] += (x * weight[:, k : k + 1]).T @ x
        yield pa.RecordBatch.from_arrays([pa.array([v.ravel().tolist()], pa.list_(pa.float64())) for v in (grad, hess)], names=["g", "h"])

    free = np.append(np.ones(d), 0.0) / c  # the intercept isn't penalised
    for _ in range(steps):
        parts = rows.mapInArrow(sums, "g array<double>, h array<double>").collect()  # a row for each partition
        grad = np.einsum("kij,kj->ki", turns, sum(np.array(r.g) for r in parts).reshape(fits.shape))
        hess = turns @ sum(np.array(r.h) for r in parts).reshape(len(people), d + 1, d + 1) @ turns.transpose(0, 2, 1)
        step = np.array([np.linalg.lstsq(hess[k] + np.diag(free + 1e-12), grad[k] + free * fits[k], rcond=None)[0] for k in range(len(people))])
        fits = fits - step * np.minimum(1.0, 5.0 / np.maximum(np.abs(step).max(1, keepdims=True), 1e-300))
        if np.abs(step).max(initial=0) < tol:
            break
    raw = np.array([np.append(w[:-1] / s[1], w[-1] - (w[:-1] / s[1]) @ s[0]) for w, s in zip(fits, scale, strict=True)])
    return people, raw


def loso_logistic(df: DataFrame, cols: list[str], y: str, person: str, keys: list[str], fpr: float | None = 0.05, rest: str | None = None) -> DataFrame:
    """Out-of-fold probabilities and thresholds like loso(model="logistic"), without a fold meeting in one task: keys, person, y, p, thr.

    The rows are written once, as each Newton step is a pass over them. fpr=None leaves the thresholds null, where only probabilities are wanted.
    """
    from pulseforge.operators import networks

    df = cut(df.select(*dict.fromkeys([*keys, person, y, *cols, *([rest] if rest else [])])), "logistic")
    people, raw = newton_logistic(df, cols, y, person)
    spark, kind = df.sparkSession, dict(df.dtypes)[person]
    thr = np.full(len(people), np.nan)
    if fpr is not None:
        quiet = df.where((F.col(y) == 0) & (F.col(rest) if rest else F.lit(True)))
        packed = networks.pack(quiet, cols, [], person, people)
        thr = networks.fold_quantiles(packed, len(people), lambda k, x: 1 / (1 + np.exp(-np.clip(x @ raw[k][:-1] + raw[k][-1], -500, 500))), 1 - fpr)
        packed.unpersist()
    none = len(people) < 2
    fits = spark.createDataFrame([(p, None if none else w.tolist(), None if np.isnan(t) else float(t)) for p, w, t in zip(people, raw, thr, strict=True)], f"{person} {kind}, __w array<double>, thr double")
    x = F.array(*[F.col(c).cast("double") for c in cols], F.lit(1.0))
    chance = 1 / (1 + F.exp(-F.aggregate(F.zip_with(x, "__w", lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)))
    return df.join(F.broadcast(fits), person).select(*keys, person, y, chance.alias("p"), "thr")  # a row for each person


def ablation(df: DataFrame, sets: dict[str, list[str]], y: str, person: str, keys: list[str], models: tuple[str, ...] = ("ridge",), norm: str = "none") -> DataFrame:
    """Errors (or AUC) of each feature set and model with persons held out: norm, feature_set, model, n_features, mae, me, sde, auc; with the training mean as baseline."""
    from functools import reduce

    from pulseforge.operators import scoring as sc

    out = []
    for name, cols in sets.items():
        for model in models:
            if model == "ridge":
                rows = loso_ridge(df.select(*dict.fromkeys([*keys, person, y, *cols])), cols, [y], person).select(F.col(y).cast("double").alias("y"), F.col(f"{y}_pred").alias("p"))
            elif model == "logistic":
                rows = loso_logistic(df, cols, y, person, keys, fpr=None).select(F.col(y).cast("double").alias("y"), "p")
            else:
                rows = loso(df, cols, y, person, keys, model).select(F.col(y).cast("double").alias("y"), "p")
            score = sc.regression_score(rows, "y", "p") if model in ("ridge", "network") else sc.roc_auc(rows.withColumn("y", F.col("y").cast("long"))).select("auc")
            for c, kind in (("n", "long"), ("mae", "double"), ("me", "double"), ("sde", "double"), ("auc", "double")):
                if c not in score.columns:
                    score = score.withColumn(c, F.lit(None).cast(kind))
            out.append(score.select(F.lit(norm).alias("norm"), F.lit(name).alias("feature_set"), F.lit(model).alias("model"), F.lit(len(cols)).alias("n_features"), "mae", "me", "sde", "auc"))
    base = sc.loso_baselines(df.select(person, F.col(y).cast("double").alias("y")), "y", person)
    out.append(sc.regression_score(base, "y", "train_mean").select(F.lit(norm).alias("norm"), F.lit("-").alias("feature_set"), F.lit("train mean").alias("model"), F.lit(0).alias("n_features"), "mae", "me", "sde", F.lit(None).cast("double").alias("auc")))
    return reduce(DataFrame.unionByName, out)


def save_model(spark, path: str, net: Network, names: list[str], mean: np.ndarray, dev: np.ndarray, settings: dict | None = None) -> None:
    """A network with its scaler and feature names as one row of JSON."""
    import json

    body = {"weights": net.w.tolist(), "inputs": net.shapes[0][0], "outputs": net.shapes[-1][0], "network": net.settings, "features": names, "mean": np.asarray(mean).tolist(), "dev": np.asarray(dev).tolist(), "settings": settings or {}}
    spark.createDataFrame([(json.dumps(body),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_model(spark, path: str) -> tuple[Network, dict]:
    """The network that save_model() wrote, and the rest of its row."""
    import json

    body = json.loads(spark.read.text(path).first()[0])
    own = body["network"]
    hidden = own.pop("hidden")
    net = Network(body["inputs"], hidden if isinstance(hidden, int) else tuple(hidden), body["outputs"], **own)
    net.w = np.array(body["weights"])
    return net, body
