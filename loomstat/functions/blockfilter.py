"""A digital filter as matrices over short blocks of samples.

With the filter in state-space form, a block's output is one matrix product with its input
plus one with the state at its start, and the state at its end follows the same way.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SHORT = 128


@dataclass(frozen=True)
class BlockFilter:
    through: np.ndarray  # output from input
    observe: np.ndarray  # output from starting state
    load: np.ndarray  # ending state from input
    step: np.ndarray  # ending state from starting state

    @property
    def order(self) -> int:
        return self.step.shape[0]

    def power(self, samples: int) -> np.ndarray:
        """State transition over a multiple of the short block length without input."""
        return np.linalg.matrix_power(self.step, samples // SHORT)

    def run(self, x: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Output and ending state; the latter counts for whole short blocks only.

        Outputs before the first NaN or infinite sample do not depend on it; from there on they are NaN.
        """
        count = -(-len(x) // SHORT)
        blocks = np.zeros((count, SHORT))
        blocks.reshape(-1)[: len(x)] = x
        loads = blocks @ self.load.T
        states = np.zeros((count + 1, self.order))
        if start is not None:
            states[0] = start
        # infinite samples make NaN here, which is what the filter gives
        with np.errstate(invalid="ignore"):
            for i in range(count):
                states[i + 1] = self.step @ states[i] + loads[i]
            out = blocks @ self.through.T + states[:-1] @ self.observe.T
        # a sample that is not finite must not reach back through the zeros of the product
        for i in np.flatnonzero(~np.isfinite(blocks).all(axis=1)):
            direct = [self.through[k, : k + 1] @ blocks[i, : k + 1] for k in range(SHORT)]
            out[i] = np.array(direct) + self.observe @ states[i]
        return out.reshape(-1)[: len(x)], states[-1]


def block_filter(b: list[float], a: list[float]) -> BlockFilter:
    """Matrices of the filter with numerator ``b`` and denominator ``a``."""
    if not a or a[0] == 0:
        raise ValueError("the first denominator coefficient must not be zero")
    size = max(len(a), len(b))
    num, den = np.zeros(size), np.zeros(size)
    num[: len(b)], den[: len(a)] = np.array(b) / a[0], np.array(a) / a[0]
    p = size - 1
    move = np.eye(p, k=1)
    if p:
        move[:, 0] -= den[1:]
    enter = num[1:] - den[1:] * num[0]
    seen = np.zeros(p)
    seen[:1] = 1.0
    powers = [np.eye(p)]
    for _ in range(SHORT):
        powers.append(move @ powers[-1])
    observe = np.array([seen @ powers[k] for k in range(SHORT)]).reshape(SHORT, p)
    answer = np.array([num[0], *(observe[:-1] @ enter)])
    lag = np.subtract.outer(np.arange(SHORT), np.arange(SHORT))
    through = np.where(lag >= 0, answer[np.maximum(lag, 0)], 0.0)
    load = np.array([powers[SHORT - 1 - k] @ enter for k in range(SHORT)]).reshape(SHORT, p).T
    return BlockFilter(through, observe, load, powers[SHORT])
