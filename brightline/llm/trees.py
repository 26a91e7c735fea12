"""Fitted trees of Spark ML as plain data, so that tasks can apply them to rows they have at hand."""

from __future__ import annotations

import re

import numpy as np

#: A leaf is its class; an inner node is (feature, threshold, at or below, above).
Tree = float | tuple

_LINE = re.compile(r"\s*(?:(If|Else) \(feature (\d+) (?:<=|>) ([-\d.E]+)\)|Predict: ([-\d.E]+))")


def parsed(debug_string: str) -> list[Tree]:
    """The trees in a model's toDebugString: one for a decision tree, all for a forest."""
    parts = re.split(r"^\s*Tree \d+.*$", debug_string, flags=re.M)
    found = []
    for part in parts[1:] or parts:
        lines = [m for m in map(_LINE.match, part.splitlines()) if m]
        found.append(_node(iter(lines)))
    return found


def _node(lines) -> Tree:
    line = next(lines)
    if line[4] is not None:
        return float(line[4])
    below = _node(lines)
    next(lines)  # Else
    return int(line[2]), float(line[3]), below, _node(lines)


def votes(trees: list[Tree], rows: np.ndarray) -> np.ndarray:
    """Mean class over the trees of each row of features."""
    out = np.zeros(len(rows))
    for tree in trees:
        _walk(tree, rows, np.arange(len(rows)), out)
    return out / max(1, len(trees))


def _walk(tree: Tree, rows: np.ndarray, at: np.ndarray, out: np.ndarray) -> None:
    if not len(at):
        return
    if not isinstance(tree, tuple):
        out[at] += tree
        return
    feature, threshold, below, above = tree
    low = rows[at, feature] <= threshold
    _walk(below, rows, at[low], out)
    _walk(above, rows, at[~low], out)
