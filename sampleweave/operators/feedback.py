"""Feedback without cycles in the plan: loops of linear blocks, closed through a delay of one sample, as recursions.

A linear block is a transfer, a ratio of polynomials in the delay of one sample. Blocks in series multiply, parallel ones
add, and a loop divides: what goes round once as Q comes to 1 / (1 - Q) in the end. So a loop becomes the difference
equation that it stands for, which operators.recursive runs in parallel over the blocks of a long stream.
"""

from __future__ import annotations

from collections.abc import Hashable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from sampleweave.operators import elementwise, recursive, window


def trimmed(c: np.ndarray) -> tuple[float, ...]:
    used = np.flatnonzero(c)
    return tuple(float(x) for x in c[: used[-1] + 1]) if len(used) else (0.0,)


def total(c: Sequence[float], d: Sequence[float]) -> np.ndarray:
    out = np.zeros(max(len(c), len(d)))
    out[: len(c)] += c
    out[: len(d)] += d
    return out


@dataclass(frozen=True)
class Transfer:
    """Taps b over taps a, from the present sample on; the first of a is 1."""

    b: tuple[float, ...] = (1.0,)
    a: tuple[float, ...] = (1.0,)

    @staticmethod
    def of(b: Sequence[float], a: Sequence[float] = (1.0,)) -> Transfer:
        b, a = np.asarray(b, float), np.asarray(a, float)
        return Transfer(trimmed(b / a[0]), trimmed(a / a[0]))

    @staticmethod
    def delay(n: int) -> Transfer:
        return Transfer((*[0.0] * n, 1.0))

    def then(self, other: Transfer) -> Transfer:
        """In series. A factor that one divides by and the other multiplies with is left out where it is seen."""
        if self.a == other.b:
            return Transfer(self.b, other.a)
        if other.a == self.b:
            return Transfer(other.b, self.a)
        return Transfer(trimmed(np.convolve(self.b, other.b)), trimmed(np.convolve(self.a, other.a)))

    def __add__(self, other: Transfer) -> Transfer:
        if self.a == other.a:
            return Transfer(trimmed(total(self.b, other.b)), self.a)
        return Transfer(trimmed(total(np.convolve(self.b, other.a), np.convolve(other.b, self.a))), trimmed(np.convolve(self.a, other.a)))

    def closed(self) -> Transfer:
        """1 / (1 - self): everything that goes round a loop."""
        if self.b[0]:
            raise ValueError("a loop needs a delay")
        return Transfer(self.a, trimmed(total(self.a, [-x for x in self.b])))

    def applied(self, samples: DataFrame) -> DataFrame:
        if len(self.a) > 1:
            return recursive.iir(samples, self.b, self.a)
        return window.fir(samples, list(self.b)) if len(self.b) > 1 else elementwise.with_constant(samples, "multiply", self.b[0])


#: A signal as a sum of others, each through a transfer.
Sum = dict[Hashable, Transfer]


def added(sums: Sequence[Sum]) -> Sum:
    out: Sum = {}
    for s in sums:
        for k, t in s.items():
            out[k] = out[k] + t if k in out else t
    return out


def through(s: Sum, t: Transfer) -> Sum:
    return {k: x.then(t) for k, x in s.items()}


def solved(loops: dict[Hashable, Sum], outputs: dict[Hashable, Sum]) -> dict[Hashable, Sum]:
    """The outputs without the signals that loops name: each of those is a sum of inputs and of one another."""
    open_loops = {k: dict(v) for k, v in loops.items()}
    for k in loops:
        s = open_loops.pop(k)
        own = s.pop(k, None)
        if own is not None:
            s = through(s, own.closed())

        def without(into: Sum, k: Hashable = k, s: Sum = s) -> Sum:
            t = into.get(k)
            return into if t is None else added([{n: x for n, x in into.items() if n != k}, through(s, t)])

        open_loops = {n: without(v) for n, v in open_loops.items()}
        outputs = {n: without(v) for n, v in outputs.items()}
    return outputs


def summed(frames: dict[Hashable, DataFrame], s: Sum) -> DataFrame:
    """A sum over frames as far as the shortest goes. Inputs with one denominator share its recursion."""
    if not s:
        raise ValueError("a loop has no input")
    kept = {k: t for k, t in s.items() if t.b != (0.0,)} or s
    shared = {t.a for t in kept.values()}
    if len(kept) > 1 and len(shared) == 1:
        return Transfer((1.0,), shared.pop()).applied(elementwise.fold([Transfer(t.b).applied(frames[k]) for k, t in kept.items()], "add"))
    parts = [t.applied(frames[k]) for k, t in kept.items()]
    return parts[0] if len(parts) == 1 else elementwise.fold(parts, "add")


def feedback_merge(inputs: Sequence[DataFrame], feedback: Transfer, forward: Sequence[Transfer] | None = None, back: Transfer | None = None, tap: bool = False) -> DataFrame | tuple[DataFrame, DataFrame]:
    """A block whose output returns to one of its own inputs through a feedback block and a delay of one sample.

    forward: what the block does to each of its other inputs (1 by default, a sum); back: to what returns (1). With a
    tap the feedback block's output of the present sample comes beside it.
    """
    forward = forward or [Transfer()] * len(inputs)
    frames = dict(enumerate(inputs))
    loop = feedback.then(back or Transfer()).then(Transfer.delay(1)).closed()
    out = {k: t.then(loop) for k, t in enumerate(forward)}
    made = summed(frames, out)
    return (made, summed(frames, through(out, feedback))) if tap else made
