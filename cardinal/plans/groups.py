"""Node and column groups in card configs.

A card field may hold placeholders instead of column names:

* ``{"cols": [...]}``   the columns themselves;
* ``{"groups": [...]}`` the columns of named groups (``groups = {name: {"cols": [...]}}``);
* ``{"nodes": [...]}``  the output columns of the named nodes;
* ``"through": [...]``  (with any of the above) appends the suffix of each named
  node in turn, e.g. ``PRES`` through a rescale node -> ``PRES_rescaled``.

A list of placeholders concatenates.  Nodes are resolved in dependency order
(a node can only name nodes already resolved); single-column fields take the
one resulting column.
"""

from __future__ import annotations

from collections.abc import Mapping

from cardinal.functions.columns import join_names
from cardinal.plans.card import card_from_dict
from cardinal.plans.flow import Node

SINGLE_FIELDS = {"partition", "input", "output", "target", "weights", "group"}
_KEYS = {"cols", "groups", "nodes"}


def _is_placeholder(x) -> bool:
    return isinstance(x, Mapping) and bool(_KEYS & set(x)) and set(x) <= _KEYS | {"through"}


def _deps(x) -> set:
    if _is_placeholder(x):
        return set(x.get("nodes", [])) | set(x.get("through", []))
    if isinstance(x, Mapping):
        return set().union(*[_deps(v) for v in x.values()]) if x else set()
    if isinstance(x, list):
        return set().union(*[_deps(v) for v in x]) if x else set()
    return set()


def _expand(ph: Mapping, groups: Mapping, done: Mapping[str, Node]) -> list[str]:
    cols: list[str] = list(ph.get("cols", []))
    for g in ph.get("groups", []):
        cols += _expand(groups[g], groups, done)
    for n in ph.get("nodes", []):
        cols += done[n].outputs()
    for t in ph.get("through", []):
        suffix = getattr(done[t].card, "suffix", None)
        if not suffix:
            raise ValueError(f"node {t!r} has no suffix to pass columns through")
        cols = [join_names(c, suffix) for c in cols]
    return cols


def _resolve_field(name: str, value, groups, done):
    if _is_placeholder(value):
        cols = _expand(value, groups, done)
    elif isinstance(value, list) and value and all(_is_placeholder(v) or isinstance(v, str) for v in value) \
            and any(_is_placeholder(v) for v in value):
        cols = []
        for v in value:
            cols += _expand(v, groups, done) if _is_placeholder(v) else [v]
    else:
        return value
    if name in SINGLE_FIELDS:
        if len(cols) != 1:
            raise ValueError(f"{name} takes exactly one column, got {cols}")
        return cols[0]
    return cols


def resolve_nodes(spec: Mapping) -> list[Node]:
    """Build nodes from ``{"nodes": [{"label", "card"}...], "groups": {...}}``."""
    groups = spec.get("groups", {})
    entries = list(spec["nodes"])
    labels = [e.get("label") or f"node_{i + 1}" for i, e in enumerate(entries)]
    done: dict[str, Node] = {}
    pending = list(range(len(entries)))
    while pending:
        progressed = False
        for i in list(pending):
            card_cfg = entries[i]["card"]
            if not _deps(card_cfg) <= set(done):
                continue
            resolved = {k: _resolve_field(k, v, groups, done) for k, v in card_cfg.items()}
            done[labels[i]] = Node(card_from_dict(resolved), label=labels[i])
            pending.remove(i)
            progressed = True
        if not progressed:
            raise ValueError(f"unresolvable node references among {[labels[i] for i in pending]}")
    return [done[lb] for lb in labels]
