"""A bidirectional LSTM over character classes with a CRF over its tags, in numpy: training by back-propagation and decoding of many windows at once.

Arrays are time by channel by window, so that every operation runs over the windows. One matrix holds what a step takes from the character's class and from the state before. The cells squash
by softsign, x / (1 + |x|), in place of tanh, and their gates are half of it and a half: three plain operations where a tanh costs most of a step.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Tags; no span is beside one of its own kind, so a tag a kind is enough.
KINDS = ("email", "ip", "card", "phone")
TAGS = len(KINDS) + 1
#: Classes of characters: each string is one, in this order; then other small letters, other capitals, other white space, other ASCII, all else.
CLASSES = ("a", "t", "d", "o", "c", "m", "n", "e", "l", "p", "bf", "ABCDEF", "0", "12", "3456789", "@", ".", "-", "_", "+", "(", ")", "[", "]", "{}<>", ":", "/", ",", "\n", " ", "%$#&=?")
N_CLASSES = len(CLASSES) + 5


def _table() -> np.ndarray:
    table = np.full(129, N_CLASSES - 2, np.uint8)
    table[[ord(c) for c in "abcdefghijklmnopqrstuvwxyz"]] = N_CLASSES - 5
    table[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = N_CLASSES - 4
    table[[9, 11, 12, 13]] = N_CLASSES - 3
    for k, chars in enumerate(CLASSES):
        table[[ord(c) for c in chars]] = k
    table[128] = N_CLASSES - 1
    return table


TABLE = _table()
PIECE = 1 << 20


def classes(text: str) -> np.ndarray:
    """One class a code point; a piece at a time, so a long text needs a byte a character."""
    if text.isascii():
        return TABLE[np.frombuffer(text.encode(), np.uint8)]
    found = np.empty(len(text), np.uint8)
    for at in range(0, len(text), PIECE):
        points = np.frombuffer(text[at : at + PIECE].encode("utf-32-le", "surrogatepass"), "<u4")
        found[at : at + len(points)] = TABLE[np.minimum(points, 128)]
    return found


def chars_in(chars: str) -> np.ndarray:
    """Of each class, whether it has any of these ASCII characters."""
    found = np.zeros(N_CLASSES, bool)
    found[TABLE[[ord(c) for c in chars]]] = True
    return found


def _sum_exp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


@dataclass
class Net:
    """Weights: of each direction one matrix (input, forget and output gates, then the candidate; by class, then by state), of the tags, of the transitions."""

    ahead: np.ndarray
    back: np.ndarray
    tags: np.ndarray
    bias: np.ndarray
    moves: np.ndarray
    ends: np.ndarray

    @staticmethod
    def fresh(hidden: int, rng: np.random.Generator) -> Net:
        def one() -> np.ndarray:
            w = (rng.standard_normal((4 * hidden, N_CLASSES + hidden)) * 0.3).astype(np.float32)
            w[hidden : 2 * hidden, :N_CLASSES] += 1  # gates that remember at first
            return w

        return Net(one(), one(), (rng.standard_normal((TAGS, 2 * hidden)) * 0.3).astype(np.float32), np.zeros(TAGS, np.float32), np.zeros((TAGS, TAGS), np.float32), np.zeros((2, TAGS), np.float32))

    @property
    def hidden(self) -> int:
        return len(self.ahead) // 4

    def all(self) -> list[np.ndarray]:
        return [self.ahead, self.back, self.tags, self.bias, self.moves, self.ends]


def _squash(x: np.ndarray, spare: np.ndarray) -> None:
    np.abs(x, out=spare)
    spare += 1
    np.divide(x, spare, out=x)


def states(w: np.ndarray, seen: np.ndarray, lengths: np.ndarray | None, backwards: bool, trace: dict | None = None) -> np.ndarray:
    """The states after each step, ``time, hidden, window``. Steps beyond a window's length leave no state."""
    time, n, hidden = *seen.shape, len(w) // 4
    of_class, of_state = np.ascontiguousarray(w[:, :N_CLASSES]), np.ascontiguousarray(w[:, N_CLASSES:])
    cell, z, own, spare = np.zeros((hidden, n), np.float32), np.empty((4 * hidden, n), np.float32), np.empty((4 * hidden, n), np.float32), np.empty((4 * hidden, n), np.float32)
    out, last = np.empty((time, hidden, n), np.float32), np.zeros((hidden, n), np.float32)
    full = time if lengths is None else int(lengths.min())
    for t in range(time - 1, -1, -1) if backwards else range(time):
        np.take(of_class, seen[t].astype(np.intp), axis=1, out=z, mode="clip")
        z += np.matmul(of_state, last, out=own)
        _squash(z, spare)
        gates = z[: 3 * hidden]
        gates *= 0.5
        gates += 0.5
        if trace is not None:
            trace["cell", t] = cell.copy()
        cell *= gates[hidden : 2 * hidden]
        cell += np.multiply(gates[:hidden], z[3 * hidden :], out=spare[:hidden])
        if t >= full:
            cell *= lengths > t
        last = out[t]
        last[:] = cell
        _squash(last, spare[:hidden])
        if trace is not None:
            trace["gates", t], trace["squashed", t] = z.copy(), last.copy()
        last *= gates[2 * hidden :]
    return out


def scores(net: Net, seen: np.ndarray, lengths: np.ndarray | None = None) -> np.ndarray:
    """What each tag gets at each step, ``time, tag, window``."""
    h = net.hidden
    found = np.matmul(net.tags[:, :h], states(net.ahead, seen, lengths, False))
    found += np.matmul(net.tags[:, h:], states(net.back, seen, lengths, True))
    found += net.bias[:, None]
    return found


def decode(net: Net, found: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best tags ``time, window`` of given scores, and what each step of the best path has over no tag there.

    Windows that can't have a tag are not decoded: no run of tags, with what its steps gain at their best and the best transitions into, within and out of runs, gains anything over no tag.
    """
    time, _, n = found.shape
    best, gain = np.zeros((time, n), np.uint8), np.zeros((time, n), np.float32)
    over = found[:, 1:].max(axis=1) - found[:, 0]
    still = net.moves[0, 0]
    enter, stay, leave = (float(part.max() - still) for part in (net.moves[0, 1:], net.moves[1:, 1:], net.moves[1:, 0]))
    first, last = (float(end[1:].max() - end[0]) for end in net.ends)
    sums = np.cumsum(over + stay, axis=0, dtype=np.float64)
    gained = np.empty_like(sums)  # of the run of tags that begins best, once it has reached a step
    gained[0], gained[1:] = first, enter - sums[:-1]
    np.maximum.accumulate(gained, axis=0, out=gained)
    gained += sums
    gained += leave - stay
    gained[lengths - 1, np.arange(n)] += last - leave
    gained[np.arange(time)[:, None] >= lengths] = -1e9
    may = np.flatnonzero(gained.max(axis=0) > -1e-2)  # a hair for rounding
    if not len(may):
        return best, gain
    some, lens = found[:, :, may], lengths[may]
    v = some[0] + net.ends[0][:, None]
    came = np.zeros((time, TAGS, len(may)), np.uint8)
    came[:] = np.arange(TAGS, dtype=np.uint8)[:, None]
    for t in range(1, time):
        from_ = v[:, None, :] + net.moves[:, :, None]
        on = lens > t
        came[t][:, on] = from_.argmax(axis=0)[:, on]
        v = np.where(on, from_.max(axis=0) + some[t], v)
    v = v + net.ends[1][:, None]
    tag, lanes = v.argmax(axis=0), np.arange(len(may))
    for t in range(time - 1, -1, -1):
        on = lens > t
        best[t, may] = np.where(on, tag, 0)
        gain[t, may] = np.where(on, some[t, tag, lanes] - some[t, 0], 0)
        tag = came[t, tag, lanes]
    return best, gain


def loss(net: Net, seen: np.ndarray, truth: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean negative log probability a window of the true tags, and its gradient for each weight."""
    (time, n), h = seen.shape, net.hidden
    traces: tuple[dict, dict] = ({}, {})
    outs = [states(net.ahead, seen, None, False, traces[0]), states(net.back, seen, None, True, traces[1])]
    e = np.matmul(net.tags[:, :h], outs[0]) + np.matmul(net.tags[:, h:], outs[1]) + net.bias[:, None]
    lanes = np.arange(n)
    fore, rear = np.empty_like(e), np.empty_like(e)
    fore[0], rear[-1] = e[0] + net.ends[0][:, None], np.broadcast_to(net.ends[1][:, None], (TAGS, n))
    for t in range(1, time):
        fore[t] = _sum_exp(fore[t - 1][:, None] + net.moves[:, :, None], 0) + e[t]
        rear[time - 1 - t] = _sum_exp(net.moves[:, :, None] + (e[time - t] + rear[time - t])[None], 1)
    total = _sum_exp(fore[-1] + net.ends[1][:, None], 0)
    true = e[np.arange(time)[:, None], truth, lanes].sum(axis=0) + net.moves[truth[:-1], truth[1:]].sum(axis=0) + net.ends[0][truth[0]] + net.ends[1][truth[-1]]
    marginal = np.exp(fore + rear - total)
    hot = np.zeros_like(e)
    hot[np.arange(time)[:, None], truth, lanes] = 1
    de = (marginal - hot) / n
    d_moves = np.zeros_like(net.moves)
    for t in range(1, time):
        d_moves += np.exp(fore[t - 1][:, None] + net.moves[:, :, None] + (e[t] + rear[t])[None] - total).sum(axis=2)
    np.subtract.at(d_moves, (truth[:-1].ravel(), truth[1:].ravel()), 1)
    d_ends = np.stack([(marginal[0] - hot[0]).sum(axis=1), (marginal[-1] - hot[-1]).sum(axis=1)])
    d_tags = np.concatenate([np.tensordot(de, out, ([0, 2], [0, 2])) for out in outs], axis=1)
    grads = [_through(w, seen, out, trace, np.matmul(net.tags[:, side].T, de), back) for w, out, trace, side, back in zip((net.ahead, net.back), outs, traces, (slice(0, h), slice(h, 2 * h)), (False, True), strict=True)]
    return float((total - true).mean()), [*grads, d_tags, de.sum(axis=(0, 2)), d_moves / n, d_ends / n]


def _through(w: np.ndarray, seen: np.ndarray, out: np.ndarray, trace: dict, d_out: np.ndarray, backwards: bool) -> np.ndarray:
    """The gradient of one direction's matrix."""
    time, n, h = *seen.shape, len(w) // 4
    dz = np.empty((time, 4 * h, n), np.float32)
    before = np.zeros_like(out)
    if backwards:
        before[:-1] = out[1:]
    else:
        before[1:] = out[:-1]
    d_h, d_cell, own = np.zeros((h, n), np.float32), np.zeros((h, n), np.float32), w[:, N_CLASSES:].T.copy()
    for t in range(time) if backwards else range(time - 1, -1, -1):
        z, squashed, cell = trace["gates", t], trace["squashed", t], trace["cell", t]
        i, f, o, g = z[:h], z[h : 2 * h], z[2 * h : 3 * h], z[3 * h :]
        d_h += d_out[t]
        d_cell += d_h * o * (1 - np.abs(squashed)) ** 2
        d = dz[t]
        d[:h], d[h : 2 * h], d[2 * h : 3 * h], d[3 * h :] = d_cell * g, d_cell * cell, d_h * squashed, d_cell * i * (1 - np.abs(g)) ** 2
        d[: 3 * h] *= 0.5 * (1 - np.abs(2 * z[: 3 * h] - 1)) ** 2
        d_cell *= f
        d_h = own @ d
    hot = np.zeros((time, N_CLASSES, n), np.float32)
    hot[np.arange(time)[:, None], seen, np.arange(n)] = 1
    return np.concatenate([np.tensordot(dz, hot, ([0, 2], [0, 2])), np.tensordot(dz, before, ([0, 2], [0, 2]))], axis=1)


def trained(batches, hidden: int, steps: int, seed: int, rate: float = 0.02) -> Net:
    """A net after ``steps`` of Adam over ``batches(rng) -> seen, truth``; the rate falls to a twentieth."""
    rng = np.random.default_rng(seed)
    net = Net.fresh(hidden, rng)
    first, second = [np.zeros_like(p) for p in net.all()], [np.zeros_like(p) for p in net.all()]
    for step in range(1, steps + 1):
        _, grads = loss(net, *batches(rng))
        size = float(np.sqrt(sum((g * g).sum() for g in grads)))
        now = rate * (0.05 + 0.95 * 0.5 * (1 + np.cos(np.pi * step / steps)))
        for p, g, m, v in zip(net.all(), grads, first, second, strict=True):
            g = g * min(1.0, 5.0 / (size + 1e-9))
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= (now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net
