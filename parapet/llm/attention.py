"""A small causal self-attention language model over subword ids, in numpy.

One block: embeddings of id and place, one masked attention head, a two-layer
network, both with residuals. The output is a tree: an id has four digits of base
16, each predicted from the block's output and the digits before it. So one id
costs four distributions over 16 values instead of one over 50,000.

The tree's own bias holds the logarithm of how often a digit follows the digits
before it in the counts of the whole training corpus; with a context of no use
the model is the unigram distribution of these counts. The other weights are
trained with Adam: first on windows of a bounded sample in one place (``train``),
then on windows of all other documents, every partition from the same weights
(``Refiner``); what the partitions changed is averaged.

Texts longer than a window are read in overlapping windows. Each id is scored
once, in the first window for the leading ids and else where it has at least
``OVERLAP`` ids before it in the window.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

WINDOW = 32
OVERLAP = 8
STRIDE = WINDOW - OVERLAP
DIM = 24
HIDDEN = 32
BASE, DIGITS = 16, 4
#: Smoothing of the tree's counts.
ALPHA = 0.3
#: Windows in a training step; the rate at which partitions refine the weights, and the steps over which it rises.
BATCH = 192
REFINE_RATE = 3e-3
WARM = 20


@dataclass
class Weights:
    """All arrays of a model, float32. ``code`` gives the tree code of an id."""

    arrays: dict[str, np.ndarray]
    code: np.ndarray
    _projections: tuple[np.ndarray, np.ndarray] | None = None

    def __getitem__(self, name: str) -> np.ndarray:
        return self.arrays[name]

    def projections(self) -> tuple[np.ndarray, np.ndarray]:
        """Scaled query, key and output-projected value of every id and of every place; made once, and anew after training."""
        if self._projections is None:
            qkv = self["qkv"]
            to = np.concatenate((qkv[:, :DIM] * np.float32(DIM**-0.5), qkv[:, DIM : 2 * DIM], qkv[:, 2 * DIM :] @ self["out"]), axis=1)
            self._projections = self["embed"] @ to, self["place"] @ to
        return self._projections


# -- windows -------------------------------------------------------------------


def windows(streams: list[np.ndarray], start_id: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, targets and which targets are scored here, one row a window.

    Row by row and place by place, the scored targets are the ids of all streams
    in order. The input at a place is the id before the target; before the first
    stands ``start_id``.
    """
    sizes = np.array([len(s) for s in streams], dtype=np.int64)
    n_windows = np.where(sizes > 0, 1 + np.maximum(0, -(-(sizes - WINDOW) // STRIDE)), 0)
    flat = np.concatenate([*streams, np.zeros(WINDOW, np.int64)]).astype(np.int64) if len(streams) else np.zeros(WINDOW, np.int64)
    first = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(streams) else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(streams)), n_windows)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    place = nth[:, None] * STRIDE + np.arange(WINDOW)[None, :]
    inside = place < sizes[doc][:, None]
    at = np.where(inside, first[doc][:, None] + place, 0)
    targets = flat[at]
    inputs = np.where(place == 0, start_id, flat[np.maximum(at - 1, 0)])
    scored = inside & ((nth[:, None] == 0) | (np.arange(WINDOW)[None, :] >= OVERLAP))
    return inputs, targets, scored


# -- forward -------------------------------------------------------------------

_MASK = np.triu(np.full((WINDOW, WINDOW), -1e9, dtype=np.float32), 1)


def _block(w: Weights, inputs: np.ndarray, keep: bool = False):
    """Hidden vectors (windows, places, DIM) for rows of inputs; with ``keep`` also what training needs."""
    x = w["embed"][inputs] + w["place"]
    qkv = x.reshape(-1, DIM) @ w["qkv"]
    qkv = qkv.reshape(len(inputs), WINDOW, 3 * DIM)
    q, k, v = qkv[..., :DIM], qkv[..., DIM : 2 * DIM], qkv[..., 2 * DIM :]
    a = np.matmul(q, k.transpose(0, 2, 1))
    a *= np.float32(DIM**-0.5)
    a += _MASK
    a -= a.max(axis=2, keepdims=True)
    np.exp(a, out=a)
    a /= a.sum(axis=2, keepdims=True)
    mixed = np.matmul(a, v).reshape(-1, DIM)
    h = mixed @ w["out"]
    h += x.reshape(-1, DIM)
    up = h @ w["up"]
    up += w["up_bias"]
    np.maximum(up, 0, out=up)
    y = up @ w["down"]
    y += h
    return (y, (x, qkv, a, mixed, h, up)) if keep else y


def _digits(code: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(prefix, digit) of codes at each level."""
    out = []
    for k in range(DIGITS):
        shift = 4 * (DIGITS - 1 - k)
        out.append((code >> (shift + 4), (code >> shift) & (BASE - 1)))
    return out


def _heads(w: Weights, y: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Natural log-probability of each code given its hidden vector."""
    total = np.zeros(len(y), dtype=np.float32)
    rows = np.arange(len(y))
    for k, (prefix, digit) in enumerate(_digits(code)):
        g = y * w[f"gate{k}"][prefix] if k else y
        z = g @ w[f"head{k}"]
        z += w[f"bias{k}"][prefix]
        z -= z.max(axis=1, keepdims=True)
        total += z[rows, digit]
        np.exp(z, out=z)
        total -= np.log(z.sum(axis=1))
    return total


def _fast(w: Weights, inputs: np.ndarray, mask: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The same as ``_heads`` after ``_block``, with fewer passes over memory.

    Queries, keys and values come from tables by id and by place. Exponentials are
    not shifted by their largest value first, and sums come out of the matrix
    products. Where that overflows, the slower way takes over.
    """
    of_id, of_place = w.projections()
    y = of_id.take(inputs, axis=0)
    y += of_place
    v = np.ones((len(inputs), WINDOW, DIM + 1), dtype=np.float32)
    v[..., :DIM] = y[..., 2 * DIM :]
    mixed = np.empty_like(v)
    for windows_, queries, keys in _parts(mask.reshape(inputs.shape)):
        a = np.matmul(y[windows_, queries, :DIM], y[windows_, keys, DIM : 2 * DIM].transpose(0, 2, 1))
        np.exp(a, out=a)
        a *= _CAUSAL[queries, keys]
        mixed[windows_, queries] = np.matmul(a, v[windows_, keys])
    mixed = mixed.reshape(-1, DIM + 1)[mask]
    h = mixed[:, :DIM] / mixed[:, DIM:]
    h += w["embed"].take(inputs.reshape(-1)[mask], axis=0)
    h += w["place"].take(np.flatnonzero(mask) % WINDOW, axis=0)
    up = h @ w["up"]
    up += w["up_bias"]
    np.maximum(up, 0, out=up)
    h += up @ w["down"]
    total = np.zeros(len(h), dtype=np.float32)
    sums = np.ones(len(h), dtype=np.float32)
    rows = np.arange(len(h)) * BASE
    for k, (prefix, digit) in enumerate(_digits(code)):
        g = w[f"gate{k}"].take(prefix, axis=0) if k else h
        if k:
            g *= h
        z = g @ w[f"head{k}"]
        z += w[f"bias{k}"].take(prefix, axis=0) if k else w["bias0"]
        total += z.reshape(-1).take(rows + digit)
        np.exp(z, out=z)
        sums *= z @ _ONES
    return total - np.log(sums)


def _parts(scored: np.ndarray) -> list[tuple[slice | np.ndarray, slice, slice]]:
    """Windows, queries and keys of the attention that scored places need: in all windows those past the overlap, and the overlap itself where it is scored."""
    lead = np.flatnonzero(scored[:, :OVERLAP].any(axis=1))
    past = (slice(None), slice(OVERLAP, None), slice(None))
    return [past, (lead, slice(None, OVERLAP), slice(None, OVERLAP))] if len(lead) else [past]


_CAUSAL = np.tril(np.ones((WINDOW, WINDOW), dtype=np.float32))
_ONES = np.ones(BASE, dtype=np.float32)


def log_probabilities(w: Weights, streams: list[np.ndarray], start_id: int, rows: int = 64) -> np.ndarray:
    """Natural log-probability of every id of all streams, in order; each id once."""
    inputs, targets, scored = windows(streams, start_id)
    out = []
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        for at in range(0, len(inputs), rows):
            mask = scored[at : at + rows]
            flat = mask.reshape(-1)
            code = w.code[targets[at : at + rows][mask]]
            found = _fast(w, inputs[at : at + rows], flat, code)
            if not np.isfinite(found).all():
                found = _heads(w, _block(w, inputs[at : at + rows])[flat], code)
            out.append(found)
    return np.concatenate(out) if out else np.zeros(0, dtype=np.float32)


# -- the tree ------------------------------------------------------------------


def tree_codes(counts: np.ndarray, streams: list[np.ndarray], seed: int = 7) -> np.ndarray:
    """A 16-bit code for each id, so that ids used alike share leading bits.

    Ids are described by the average of random vectors of the ids before them in
    the sample, and split in two equal halves along their main direction, again
    and again. Ids that the sample lacks come by their order.
    """
    n, dim = len(counts), 12
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, dim)).astype(np.float32)
    feature = np.zeros((n, dim), dtype=np.float64)
    seen = np.zeros(n)
    if streams:
        before = np.concatenate([s[:-1] for s in streams]).astype(np.int64)
        after = np.concatenate([s[1:] for s in streams]).astype(np.int64)
        for j in range(dim):
            feature[:, j] = np.bincount(after, weights=base[before, j], minlength=n)
        seen = np.bincount(after, minlength=n).astype(float)
    feature /= (seen + 2.0)[:, None]
    code = np.zeros(n, dtype=np.int64)
    stack = [(np.arange(n), 0, 1 << 15)]
    while stack:
        ids, prefix, bit = stack.pop()
        if len(ids) <= 1 or bit == 0:
            code[ids] = prefix + np.arange(len(ids))
            continue
        weight = seen[ids]
        if bit >= 8 and weight.sum() > 0:
            x = feature[ids]
            mean = (x * weight[:, None]).sum(0) / weight.sum()
            centred = (x - mean) * np.sqrt(weight)[:, None]
            direction = np.linalg.eigh(centred.T @ centred)[1][:, -1]
            order = np.lexsort((ids, np.where(weight > 0, (x - mean) @ direction, 0.0)))
        else:
            order = np.lexsort((ids, -counts[ids]))
        half = max(len(ids) - bit, min(bit, (len(ids) + 1) // 2))
        stack.append((ids[order[:half]], prefix, bit >> 1))
        stack.append((ids[order[half:]], prefix | bit, bit >> 1))
    return code


def tree_bias(counts: np.ndarray, code: np.ndarray) -> list[np.ndarray]:
    """Per level: log-share of each digit after each prefix, from the counts of all ids."""
    size = BASE**DIGITS
    weight = np.zeros(size)
    np.add.at(weight, code, counts + ALPHA)
    used = np.zeros(size)
    used[code] = 1
    out = []
    for k in range(DIGITS):
        level = weight.reshape(BASE**k, BASE, -1).sum(axis=2)
        whole = level.sum(axis=1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            share = np.where(whole > 0, level / np.where(whole > 0, whole, 1), 1 / BASE)
            out.append(np.maximum(np.log(share), -30.0).astype(np.float32))
    return out


# -- training ------------------------------------------------------------------


def initial(vocabulary: int, counts: np.ndarray, streams: list[np.ndarray], seed: int = 7) -> Weights:
    rng = np.random.default_rng(seed)
    normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    code = tree_codes(counts, streams, seed)
    arrays = {
        "embed": normal(vocabulary, DIM, scale=0.3),
        "place": normal(WINDOW, DIM, scale=0.05),
        "qkv": normal(DIM, 3 * DIM, scale=DIM**-0.5),
        "out": normal(DIM, DIM, scale=0.5 * DIM**-0.5),
        "up": normal(DIM, HIDDEN, scale=DIM**-0.5),
        "up_bias": np.zeros(HIDDEN, np.float32),
        "down": normal(HIDDEN, DIM, scale=0.5 * HIDDEN**-0.5),
    }
    for k, bias in enumerate(tree_bias(counts, code)):
        arrays[f"head{k}"] = normal(DIM, BASE, scale=0.02)
        arrays[f"bias{k}"] = bias
        if k:
            arrays[f"gate{k}"] = 1 + normal(BASE**k, DIM, scale=0.5)
    return Weights(arrays, code)


def gradients(w: Weights, inputs: np.ndarray, targets: np.ndarray, scored: np.ndarray) -> tuple[float, dict[str, np.ndarray | tuple]]:
    """Mean negative log-probability of the scored targets, and its gradients.

    Tables looked up by row (embeddings, gates) have (rows, gradients) instead of
    a full array. Scored places are taken in the order of their codes, so rows of
    equal prefix stand together at every level of the tree. Exponentials are shifted
    only where they have to be, and sums come out of the matrix products.
    """
    kind = w["embed"].dtype
    scale = kind.type(DIM**-0.5)
    to = np.concatenate((w["qkv"][:, :DIM] * scale, w["qkv"][:, DIM:]), axis=1)
    at = np.flatnonzero(scored)
    code = w.code[targets.reshape(-1)[at]]
    order = np.argsort(code.astype(np.uint16), kind="stable")
    at, code = at[order], code[order]
    n = max(1, len(at))
    x = w["embed"].take(inputs, axis=0)
    x += w["place"]
    flat = x.reshape(-1, DIM)
    qkv = (flat @ to).reshape(len(inputs), WINDOW, 3 * DIM)
    v = np.ones((len(inputs), WINDOW, DIM + 1), dtype=kind)
    v[..., :DIM] = qkv[..., 2 * DIM :]
    mixed, held = np.empty_like(v), []
    for windows_, queries, keys in _parts(scored):
        q, k_ = qkv[windows_, queries, :DIM], qkv[windows_, keys, DIM : 2 * DIM]
        a = np.matmul(q, k_.transpose(0, 2, 1))
        if _is_wide(a):
            a += _MASK[queries, keys]
            a -= a.max(axis=2, keepdims=True)
        np.exp(a, out=a)
        a *= _CAUSAL[queries, keys]
        mixed[windows_, queries] = np.matmul(a, v[windows_, keys])
        held.append((windows_, queries, keys, q, k_, a))
    mixed = mixed.reshape(-1, DIM + 1).take(at, axis=0)
    share = 1 / mixed[:, DIM:]
    mixed = mixed[:, :DIM] * share
    h = mixed @ w["out"]
    h += flat.take(at, axis=0)
    up = h @ w["up"]
    up += w["up_bias"]
    np.maximum(up, 0, out=up)
    y = up @ w["down"]
    y += h
    grads: dict = {}
    loss, dy, rows, ones = 0.0, np.zeros_like(y), np.arange(len(y)) * BASE, np.ones((BASE, 1), dtype=kind)
    for k, (prefix, digit) in enumerate(_digits(code)):
        gate = w[f"gate{k}"].take(prefix, axis=0) if k else None
        g = y * gate if k else y
        z = g @ w[f"head{k}"]
        z += w[f"bias{k}"].take(prefix, axis=0) if k else w["bias0"]
        if _is_wide(z):
            z -= z.max(axis=1, keepdims=True)
        loss -= float(z.reshape(-1).take(rows + digit).sum())
        np.exp(z, out=z)
        total = z @ ones
        loss += float(np.log(total).sum())
        total *= kind.type(n)
        z /= total
        z.reshape(-1)[rows + digit] -= kind.type(1 / n)
        grads[f"head{k}"] = g.T @ z
        dg = z @ w[f"head{k}"].T
        if k:
            dy += dg * gate
            dg *= y
            grads[f"gate{k}"] = _sums(prefix, dg)
        else:
            dy += dg
    grads["down"] = up.T @ dy
    dup = dy @ w["down"].T
    dup *= up > 0
    grads["up"], grads["up_bias"] = h.T @ dup, np.ones(len(dup), dtype=kind) @ dup
    dy += dup @ w["up"].T  # from here the gradient of what goes into the network
    grads["out"] = mixed.T @ dy
    dmixed = dy @ w["out"].T
    dmixed *= share
    # The column beside the values brings each row's mean off the gradient of the attention.
    d = np.zeros((inputs.size, DIM + 1), dtype=kind)
    d[at] = np.concatenate((dmixed, -np.einsum("ij,ij->i", dmixed, mixed)[:, None]), axis=1)
    d = d.reshape(len(inputs), WINDOW, DIM + 1)
    dqkv = np.empty((len(inputs), WINDOW, 3 * DIM), dtype=kind)
    dqkv[:, :OVERLAP, :DIM] = 0
    for windows_, queries, keys, q, k_, a in held:
        dm = d[windows_, queries]
        ds = np.matmul(dm, v[windows_, keys].transpose(0, 2, 1))
        ds *= a
        products = (ds, k_, queries), (ds.transpose(0, 2, 1), q, keys), (a.transpose(0, 2, 1), dm[..., :DIM], keys)
        for i, (left, right, places) in enumerate(products):
            columns = slice(i * DIM, (i + 1) * DIM)
            if isinstance(windows_, slice):  # all windows, which come first
                np.matmul(left, right, out=dqkv[:, places, columns])
            else:
                dqkv[windows_, places, columns] += np.matmul(left, right)
    dqkv = dqkv.reshape(-1, 3 * DIM)
    grads["qkv"] = flat.T @ dqkv
    grads["qkv"][:, :DIM] *= scale
    dx = dqkv @ to.T
    dx[at] += dy
    grads["place"] = dx.reshape(len(inputs), WINDOW, DIM).sum(axis=0)
    of = inputs.reshape(-1)
    order = np.argsort(of.astype(np.uint16) if len(w["embed"]) <= 1 << 16 else of, kind="stable")  # 16 bits are ordered by counting
    grads["embed"] = _sums(of[order], dx.take(order, axis=0))
    return loss / n, grads


def _is_wide(z: np.ndarray) -> bool:
    """Whether exponentials of ``z`` may overflow, or a sum of some of them vanish."""
    return z.size > 0 and not (z.max() < 60 and z.min() > -60)


def _sums(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct of ordered ``rows``, and the sum of the values of each."""
    if not len(rows):
        return rows, values
    first = np.concatenate(([0], np.flatnonzero(rows[1:] != rows[:-1]) + 1))
    return rows[first], np.add.reduceat(values, first, axis=0)


class _Adam:
    def __init__(self, w: Weights):
        self.w, self.t = w, 0
        self.mean = {k: np.zeros_like(v) for k, v in w.arrays.items() if not k.startswith("bias")}
        self.square = {k: np.zeros_like(v) for k, v in w.arrays.items() if not k.startswith("bias")}

    def step(self, inputs: np.ndarray, targets: np.ndarray, scored: np.ndarray, rate: float) -> float:
        self.t += 1
        self.w._projections = None
        loss, grads = gradients(self.w, inputs, targets, scored)
        fix = np.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t)
        for name, g in grads.items():
            rows, g = g if isinstance(g, tuple) else (slice(None), g)
            m, s = self.mean[name][rows], self.square[name][rows]
            m *= 0.9
            m += 0.1 * g
            s *= 0.99
            g = g * g
            g *= 0.01
            s += g
            self.mean[name][rows], self.square[name][rows] = m, s
            np.sqrt(s, out=g)
            g += 1e-8
            np.divide(m, g, out=g)
            g *= rate * fix
            self.w.arrays[name][rows] -= g
        return loss


def train(w: Weights, streams: list[np.ndarray], start_id: int, *, steps: int, batch: int = BATCH, rate: float = 1e-2, seed: int = 7) -> list[float]:
    """Adam on random windows of the streams; changes ``w``, returns the loss of each step."""
    inputs, targets, scored = windows(streams, start_id)
    rng = np.random.default_rng(seed)
    adam = _Adam(w)
    losses = []
    for t in range(1, steps + 1):
        pick = rng.integers(0, len(inputs), batch)
        lr = rate * min(1.0, t / 50) * (0.1 + 0.9 * 0.5 * (1 + np.cos(np.pi * t / steps)))
        losses.append(adam.step(inputs[pick], targets[pick], scored[pick], lr))
    return losses


class Refiner:
    """Trains a copy of the weights on the windows that one partition feeds it, each window once."""

    def __init__(self, w: Weights, start_id: int, rate: float = REFINE_RATE):
        self.w = Weights({k: v.copy() for k, v in w.arrays.items()}, w.code)
        self.adam, self.start_id, self.rate = _Adam(self.w), start_id, rate
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n_held = self.windows = 0
        self.uses = {k: np.zeros(len(v)) for k, v in w.arrays.items() if k == "embed" or k.startswith("gate")}

    def feed(self, streams: list[np.ndarray]) -> None:
        self.held.append(windows(streams, self.start_id))
        self.n_held += len(self.held[-1][0])
        if self.n_held >= BATCH:
            self._train(whole=False)

    def _train(self, whole: bool) -> None:
        inputs, targets, scored = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.random.default_rng(self.windows + len(inputs)).permutation(len(inputs))
        until = len(order) if whole else len(order) // BATCH * BATCH
        for at in range(0, until, BATCH):
            pick = order[at : min(at + BATCH, until)]
            self.adam.step(inputs[pick], targets[pick], scored[pick], self.rate * min(1.0, (self.adam.t + 1) / WARM))
        done = order[:until]
        self.uses["embed"] += np.bincount(inputs[done].reshape(-1), minlength=len(self.uses["embed"]))
        for k, (prefix, _) in enumerate(_digits(self.w.code[targets[done][scored[done]]])):
            if k:
                self.uses[f"gate{k}"] += np.bincount(prefix, minlength=len(self.uses[f"gate{k}"]))
        self.windows += until
        rest = order[until:]
        self.held, self.n_held = [(inputs[rest], targets[rest], scored[rest])], len(rest)

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """The trained weights as rows of ``DIM`` numbers, and how much each row was used."""
        if self.n_held:
            self._train(whole=True)
        n = np.concatenate([np.repeat(self.uses[k], -(-v[0].size // DIM)) if k in self.uses else np.full(-(-v.size // DIM), self.windows) for k, v in _learned(self.w)])
        return as_rows(self.w), n


def _learned(w: Weights) -> list[tuple[str, np.ndarray]]:
    return [(k, w.arrays[k]) for k in sorted(w.arrays) if not k.startswith("bias")]


def as_rows(w: Weights) -> np.ndarray:
    """All learned arrays, one after the other, as rows of ``DIM`` numbers; the last row of an array is filled with zeros."""
    return np.concatenate([np.pad(v.reshape(-1), (0, -v.size % DIM)).reshape(-1, DIM) for _, v in _learned(w)])


def from_rows(w: Weights, rows: np.ndarray) -> Weights:
    """The weights whose learned arrays are these rows."""
    arrays, at = dict(w.arrays), 0
    for k, v in _learned(w):
        n = -(-v.size // DIM)
        arrays[k] = rows[at : at + n].reshape(-1)[: v.size].reshape(v.shape).astype(np.float32)
        at += n
    return Weights(arrays, w.code)
