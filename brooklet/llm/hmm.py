"""Hidden Markov model over numbered symbols: exact likelihoods and Baum-Welch counts for many sequences at once.

The first HEAD symbols of every sequence start from a known state and are worked
on side by side, a row of states each.  What is left of longer sequences is cut
into segments: the product of a segment's steps, diag(emission) x transition,
is formed as a matrix, and chaining the matrices of a sequence gives the state
before and the likelihood after every segment, exactly as one long recursion
would.  Tokens are laid out step by step, so that each step reads and writes one
stretch of memory.  Values are scaled to sum to 1 every few steps, and the
logarithms of the scales add up.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

HEAD = 2048
SEGMENT = 128
RESCALE = 8  # steps between two scalings
TOKENS = 1 << 18  # tokens worked on at once


@dataclass(frozen=True)
class Hmm:
    start: np.ndarray  # state
    move: np.ndarray  # state x next state
    emit: np.ndarray  # symbol x state


@dataclass
class Counts:
    """Expected counts of a Baum-Welch round."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray
    log_likelihood: float = 0.0

    @classmethod
    def none(cls, symbols: int, states: int) -> Counts:
        return cls(np.zeros(states), np.zeros((states, states)), np.zeros((symbols, states)))


class _Group:
    """Segments worked on side by side, longest first; the token of segment i at step t lies at ``steps[t] + i``."""

    def __init__(self, model: Hmm, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
        self.order = np.argsort(-size, kind="stable")
        self.size, begin = size[self.order], begin[self.order]
        longest = int(self.size[0]) if len(size) else 0
        self.active = np.searchsorted(-self.size, -np.arange(longest), side="left")  # segments that have step t
        self.steps = np.concatenate([[0], np.cumsum(self.active)])
        step = np.repeat(np.arange(longest), self.active)
        self.tokens = begin[np.arange(len(step)) - self.steps[step]] + step
        self.model, self.emitted = model, model.emit[data[self.tokens]]
        self.log_scale = np.zeros(len(size))

    def stretch(self, step: int) -> slice:
        return slice(self.steps[step], self.steps[step + 1])

    def forward(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From the states expected before the segments: those after each token (scaled), and after each segment (summing to 1)."""
        ahead, after = self.emitted.copy(), np.empty_like(start)
        value, left = start, len(start)
        for step, active in enumerate(self.active):
            after[active:left] = value[active:left] @ self.model.move  # segments that have ended
            here = ahead[self.stretch(step)]
            here *= value[:active] @ self.model.move if step else value[:active]
            if step % RESCALE == RESCALE - 1:
                total = _sums(here)
                here /= total[:, None]
                self.log_scale[:active] += np.log(total)
            value, left = here, active
        if len(start):
            after[:left] = value @ self.model.move
            total = after.sum(axis=1)
            after /= total[:, None]
            self.log_scale += np.log(total)
        return ahead, after

    def products(self) -> np.ndarray:
        """The segments' matrices (state before, state after), scaled to sum to 1."""
        states = len(self.model.start)
        product = np.tile(np.eye(states), (len(self.size), 1, 1))
        for step, active in enumerate(self.active):
            moved = (product[:active] * self.emitted[self.stretch(step), None, :]).reshape(-1, states) @ self.model.move
            product[:active] = moved.reshape(-1, states, states)
            if step % RESCALE == RESCALE - 1:
                self._rescale(product, active)
        self._rescale(product, len(product))
        return product

    def _rescale(self, product: np.ndarray, active: int) -> None:
        total = product[:active].sum(axis=(1, 2))
        product[:active] /= total[:, None, None]
        self.log_scale[:active] += np.log(total)

    def backward(self, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Up to a factor per token: the likelihood of what follows a token, by the state of the next one, and by its own state."""
        then, back = np.empty_like(self.emitted), np.empty_like(self.emitted)
        follow, turned = after.copy(), np.ascontiguousarray(self.model.move.T)
        for step in range(len(self.active) - 1, -1, -1):
            at, here = self.stretch(step), follow[: self.active[step]]
            then[at] = here
            np.matmul(here, turned, out=back[at])
            np.multiply(self.emitted[at], back[at], out=here)
            if step % RESCALE == 0:
                here /= _sums(here)[:, None]
        return then, back


def _sums(rows: np.ndarray) -> np.ndarray:
    """Of each row; a product is quicker than a sum over a few columns."""
    return rows @ np.ones(rows.shape[1])


class _Sequences:
    """Some sequences as heads and later segments; ``data[begins[i]:begins[i + 1]]`` is sequence i, none is empty."""

    def __init__(self, model: Hmm, data: np.ndarray, begins: np.ndarray) -> None:
        sizes = np.diff(begins)
        self.model, self.data = model, data
        self.heads = _Group(model, data, begins[:-1], np.minimum(sizes, HEAD))
        more = -(-np.maximum(sizes - HEAD, 0) // SEGMENT)  # later segments of each sequence
        self.more, self.first = more, np.cumsum(more) - more
        owner = np.repeat(np.arange(len(sizes)), more)
        begin = begins[owner] + HEAD + (np.arange(len(owner)) - self.first[owner]) * SEGMENT
        self.rest = _Group(model, data, begin, np.minimum(SEGMENT, begins[owner + 1] - begin))
        self.place = np.argsort(self.rest.order)  # of a later segment in its group
        states = len(model.start)
        self.ahead, ended = self.heads.forward(np.tile(model.start, (len(sizes), 1)))
        self.matrices = self.rest.products()
        # Chain the segments: the state before each, and the logarithm of each sequence's probability.
        state, self.log = np.empty((len(sizes), states)), np.empty(len(sizes))
        state[self.heads.order], self.log[self.heads.order] = ended, self.heads.log_scale
        self.before = np.empty((len(owner), states))
        for number in range(int(more.max(initial=0))):
            have = np.flatnonzero(more > number)
            at = self.place[self.first[have] + number]
            self.before[at] = state[have]
            after = np.matmul(state[have][:, None, :], self.matrices[at])[:, 0, :]
            total = after.sum(axis=1)
            state[have] = after / total[:, None]
            self.log[have] += np.log(total) + self.rest.log_scale[at]

    def _follow(self) -> tuple[np.ndarray, np.ndarray]:
        """What follows the heads and the later segments, by the state expected there; 1 behind a sequence's end."""
        states = len(self.model.start)
        value, after = np.ones((len(self.more), states)), np.ones((len(self.before), states))
        for number in range(int(self.more.max(initial=0)) - 1, -1, -1):
            have = np.flatnonzero(self.more > number)
            at = self.place[self.first[have] + number]
            after[at] = value[have]
            now = np.matmul(self.matrices[at], value[have][:, :, None])[:, :, 0]
            value[have] = now / now.sum(axis=1, keepdims=True)
        return value[self.heads.order], after

    def count(self, counts: Counts) -> None:
        head_after, rest_after = self._follow()
        ended = self.more[self.heads.order] == 0
        first = self._count(self.heads, self.ahead, head_after, ended, counts)
        counts.start += first[: len(self.more)].sum(axis=0)
        if len(self.before):
            last = np.zeros(len(self.before), dtype=bool)
            last[self.place[(self.first + self.more - 1)[self.more > 0]]] = True
            self._count(self.rest, self.rest.forward(self.before)[0], rest_after, last, counts)
        counts.log_likelihood += float(self.log.sum())

    def _count(self, group: _Group, ahead: np.ndarray, after: np.ndarray, last: np.ndarray, counts: Counts) -> np.ndarray:
        """Adds the counts of a group's tokens; returns the share of each state in each token."""
        then, back = group.backward(after)
        from_here = ahead / np.einsum("ij,ij->i", ahead, back)[:, None]
        share = np.multiply(from_here, back, out=back)
        ends = np.flatnonzero(last)
        from_here[group.steps[group.size[ends] - 1] + ends] = 0  # nothing follows the last token of a sequence
        counts.move += (from_here.T @ then) * self.model.move
        symbols = self.data[group.tokens]
        for state in range(share.shape[1]):
            counts.emit[:, state] += np.bincount(symbols, weights=share[:, state], minlength=len(counts.emit))
        return share


def _parts(begins: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of sequences with about TOKENS tokens each; a longer sequence is a stretch of its own."""
    parts, at = [], 0
    while at < len(begins) - 1:
        end = max(at + 1, int(np.searchsorted(begins, begins[at] + TOKENS, side="right")) - 1)
        parts.append((at, end))
        at = end
    return parts


def log_likelihoods(model: Hmm, data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Natural logarithm of each sequence's probability."""
    found = [_Sequences(model, data[begins[at] : begins[end]], begins[at : end + 1] - begins[at]).log for at, end in _parts(begins)]
    return np.concatenate(found) if found else np.zeros(0)


def expect(model: Hmm, data: np.ndarray, begins: np.ndarray, counts: Counts) -> None:
    """Add the expected counts of the sequences to ``counts``."""
    for at, end in _parts(begins):
        _Sequences(model, data[begins[at] : begins[end]], begins[at : end + 1] - begins[at]).count(counts)


def maximise(counts: Counts, usual: np.ndarray, weight: float) -> Hmm:
    """The model for expected counts; ``usual`` (a share per symbol) counts as ``weight`` more tokens of every state."""
    emit = counts.emit + weight * usual[:, None]
    move, start = counts.move + 1.0, counts.start + 1.0
    return Hmm(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0, keepdims=True))


def beginning(usual: np.ndarray, states: int, seed: int) -> Hmm:
    """States that last, each with its own random deviation from the usual shares."""
    noise = np.random.default_rng(seed).gamma(1.0, 1.0, (len(usual), states)) + 0.2
    emit = usual[:, None] * noise
    move = np.full((states, states), 0.1 / max(1, states - 1)) if states > 1 else np.ones((1, 1))
    if states > 1:
        np.fill_diagonal(move, 0.9)
    return Hmm(np.full(states, 1 / states), move, emit / emit.sum(axis=0, keepdims=True))
