"""Defaults that the estimator's operators take where nothing is said."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Options:
    #: relative tolerance of the level-space solver
    eps: float = 1e-11
    #: pairs of levels up to which the driver solves, and levels up to which it does so densely
    edges: int = 3_000_000
    dense: int = 1500
    #: counted levels up to which a level table is broadcast
    broadcast: int = 200_000
    #: levels up to which traces, inverses and ranks are exact
    exact: int = 5000


DEFAULTS = Options()
