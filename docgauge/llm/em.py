"""Expectation-maximization over a histogram of vote patterns."""

from __future__ import annotations

import numpy as np


def dawid_skene(votes: np.ndarray, counts: np.ndarray, lean: np.ndarray, rounds: int = 60, prior: float = 0.2):
    """Learn each labelling function's confusion table from agreements alone.

    ``votes`` is (patterns, functions) of outcome numbers, ``counts`` the documents with each pattern,
    ``lean`` (functions, outcomes, classes) the starting belief P(outcome | class) up to a factor.
    Returns (posterior of each pattern, accuracy tables, class shares). An empty histogram gives empty results.
    """
    n_pat, n_fun = votes.shape
    n_cls = lean.shape[2]
    tables = lean / lean.sum(axis=1, keepdims=True)
    share = np.full(n_cls, 1.0 / n_cls)
    post = np.zeros((n_pat, n_cls))
    for _ in range(rounds):
        logp = np.tile(np.log(share), (n_pat, 1))
        for f in range(n_fun):
            logp += np.log(tables[f, votes[:, f]])
        logp -= logp.max(axis=1, keepdims=True)
        new = np.exp(logp)
        new /= new.sum(axis=1, keepdims=True)
        moved = np.abs(new - post).max() if n_pat else 0.0
        post = new
        weight = post * counts[:, None]
        share = (weight.sum(axis=0) + 1.0) / (weight.sum() + n_cls)
        # The starting belief stays as a pseudo-count, so that a class with few documents keeps its meaning.
        tables = lean / lean.sum(axis=1, keepdims=True) * prior * max(counts.sum(), 1) ** 0.5
        for f in range(n_fun):
            np.add.at(tables[f], votes[:, f], weight)
        tables = tables + 1e-6
        tables /= tables.sum(axis=1, keepdims=True)
        if moved < 1e-6:
            break
    return post, tables, share
