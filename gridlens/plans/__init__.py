"""Registered queries over the given tables, each beside its SQL."""

from __future__ import annotations

from . import files, graph, labels, networks, quality, rules

PLANS = {**labels.PLANS, **graph.PLANS, **quality.PLANS, **rules.PLANS, **files.PLANS, **networks.PLANS}
