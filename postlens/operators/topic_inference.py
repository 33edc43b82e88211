"""The variational step of a topic model for a few posts, in numpy."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from postlens.functions.special import digamma

#: Largest number of (entry, topic) pairs of a stack, and about so many move on together.
_PAIRS = 1 << 17
_TOGETHER = 1 << 19
_TINY = 1e-100
#: Posts that have come to rest are taken out of a stack when fewer than this share still move.
_COMPACT = 0.75


@dataclass
class Inferred:
    """Per post the topic weights, per entry (a word of a post) the weights of its topics."""

    gamma: np.ndarray
    shares: np.ndarray
    log_theta: np.ndarray


def log_mean(weights: np.ndarray) -> np.ndarray:
    """Expected logarithms under Dirichlet rows."""
    total = weights.sum(axis=-1, keepdims=True)
    both = digamma(np.concatenate([weights, total], axis=-1))
    return both[..., :-1] - both[..., -1:]


def infer(
    sizes: np.ndarray,
    words: np.ndarray,
    counts: np.ndarray,
    beta: np.ndarray,
    alpha: np.ndarray,
    max_steps: int,
    tolerance: float,
    take: Callable[[np.ndarray, np.ndarray], None] | None = None,
) -> Inferred:
    """Fixed-point steps for each post until its weights move less than ``tolerance``.

    Post ``i`` has ``sizes[i]`` entries, in order; ``words`` are rows of ``beta``, the exponential
    of the expected log weight of each topic. Every post is worked out on its own, so its result
    does not depend on the posts beside it. A post without entries keeps the prior. ``take`` is
    handed the shares part by part, with the numbers of their entries; they are not kept then.
    """
    k = len(alpha)
    out = Inferred(
        np.tile(alpha, (len(sizes), 1)),
        np.zeros((0 if take else len(words), k)),
        np.zeros((len(sizes), k)),
    )
    take = take or out.shares.__setitem__
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    lengths = _padded(sizes)
    order = np.argsort(lengths, kind="stable")
    order = order[sizes[order] > 0]
    ordered = lengths[order]
    first = 0
    while first < len(order):
        stacks, ends, pairs = [], [first], 0
        while ends[-1] < len(order) and pairs < _TOGETHER:
            n = int(ordered[ends[-1]])
            last = int(np.searchsorted(ordered, n, side="right"))
            last = min(last, ends[-1] + max(1, _PAIRS // (n * k)))
            posts = order[ends[-1] : last]
            real = np.arange(n) < sizes[posts, None]
            at = np.where(real, begins[posts, None] + np.arange(n), 0)
            own = beta[words[at]]
            stacks.append((_steps(own, np.where(real, counts[at], 0.0)), own, at, real))
            ends.append(last)
            pairs += own.size
        bounds = np.array(ends) - first
        gamma, theta = _rest([s[0] for s in stacks], bounds, alpha, max_steps, tolerance)
        out.gamma[order[first : ends[-1]]] = gamma
        for (_, own, at, real), begin, end in zip(stacks, bounds, bounds[1:], strict=False):
            shares = own * theta[begin:end, None, :]
            shares /= shares.sum(axis=2, keepdims=True) + _TINY
            take(at[real], shares[real])
        first = ends[-1]
    out.log_theta = log_mean(out.gamma)
    return out


def _padded(sizes: np.ndarray) -> np.ndarray:
    """Lengths rounded up by an eighth at most, and to 8: posts of one length are stacked.

    The length of a post depends on its own size alone, and so do its sums.
    """
    unit = np.left_shift(1, np.maximum(np.log2(np.maximum(sizes, 1)).astype(np.int64) - 3, 3))
    return (sizes + unit - 1) // unit * unit


def _steps(beta: np.ndarray, counts: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """What the entries of stacked posts give to each topic in a step, for the posts that still move.

    ``beta[post, entry, topic]``; entries with a count of 0 fill up short posts. A step needs two
    products per post: the weight of each entry over the topics, and of each topic over the entries.
    """
    held = np.arange(len(counts))
    beta = np.ascontiguousarray(beta.transpose(0, 2, 1))
    weight = np.empty((len(counts), 1, counts.shape[1]))

    def given(moving: np.ndarray, theta: np.ndarray) -> np.ndarray:
        nonlocal held, beta, counts, weight
        own = None
        if len(moving) < len(held):
            own = np.searchsorted(held, moving)
            if len(moving) < _COMPACT * len(held):
                held, beta, counts, weight, own = moving, beta[own], counts[own], weight[own], None
        now = theta
        if own is not None:
            now = np.ones((len(held), theta.shape[1]))
            now[own] = theta
        np.matmul(now[:, None, :], beta, out=weight)
        weight += _TINY
        np.divide(counts[:, None, :], weight, out=weight)
        sums = np.matmul(beta, weight.transpose(0, 2, 1))[:, :, 0]
        return sums if own is None else sums[own]

    return given


def _rest(stacks, bounds, alpha, max_steps, tolerance) -> tuple[np.ndarray, np.ndarray]:
    """Topic weights of the posts of several stacks, and the ones their last step began from.

    Stack ``i`` has the posts from ``bounds[i]`` on. The stacks step together, because what
    a step needs besides their products costs much the same for few posts as for many.
    """
    gamma = np.ones((bounds[-1], len(alpha)))
    theta = np.ones_like(gamma)
    moving = np.arange(len(gamma))
    for _ in range(max_steps):
        if not len(moving):
            break
        old = gamma[moving]
        now = np.exp(log_mean(old))
        fresh = np.empty_like(now)
        cuts = np.searchsorted(moving, bounds)
        for given, begin, a, b in zip(stacks, bounds, cuts, cuts[1:], strict=False):
            if a < b:
                fresh[a:b] = given(moving[a:b] - begin, now[a:b])
        fresh *= now
        fresh += alpha
        moved = np.abs(fresh - old).mean(axis=1)
        gamma[moving], theta[moving] = fresh, now
        moving = moving[moved > tolerance]
    return gamma, theta
