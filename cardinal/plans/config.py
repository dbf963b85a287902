"""Parametric card configs (L2, N20): placeholders filled from parameters.

A dict with a placeholder's mark as its only key stands for values:

* ``{"-v": name}``      the parameter ``name``
* ``{"-s": name}``      the elements of the parameter ``name``, one by one
* ``{"-r": n}``         the list 1..n
* ``{"-j": [a, b]}``    every combination of its parts joined with ``_``, one by
  one (lists vary, the last one fastest; single values repeat)

Inside a list, one-by-one values take the placeholder's place; as the value of
a key they become a list.  Arguments may hold placeholders.  What a placeholder
gives is taken as it is, unless ``recursive`` allows it to be filled in turn,
that many levels deep.  Plain Python on small config dicts.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from itertools import product
from typing import Any


@dataclass(frozen=True)
class Placeholder:
    """What a mark stands for: ``values(argument, params)``, to be spread in a list or not."""

    values: Callable[[Any, Mapping], list]
    spread: bool


def _combinations(parts: Any, _params: Mapping) -> list:
    axes = [part if isinstance(part, (list, tuple)) else (part,) for part in parts]
    return ["_".join(map(str, row)) for row in product(*axes)]


# The marks.
PLACEHOLDERS = {
    "-v": Placeholder(lambda name, params: [params[name]], spread=False),
    "-s": Placeholder(lambda name, params: list(params[name]), spread=True),
    "-r": Placeholder(lambda n, params: [[k + 1 for k in range(int(n))]], spread=False),
    "-j": Placeholder(_combinations, spread=True),
}


class Filler:
    """Walks a config; every element of it answers with the values it stands for."""

    def __init__(self, params: Mapping):
        self.params = params

    def fill(self, element: Any, depth: int) -> tuple[list, bool]:
        """(values, whether a list should take them one by one)."""
        if isinstance(element, Mapping):
            filled = {key: self.value(inner, depth) for key, inner in element.items()}
            mark = next(iter(filled)) if len(filled) == 1 else None
            if mark in PLACEHOLDERS:
                return self.replace(PLACEHOLDERS[mark], filled[mark], depth)
            return [filled], False
        if isinstance(element, list):
            return [[v for inner in element for v in self.fill(inner, depth)[0]]], False
        return [element], False

    def replace(self, placeholder: Placeholder, argument: Any, depth: int) -> tuple[list, bool]:
        given = placeholder.values(argument, self.params)
        if depth == 0:
            return given, placeholder.spread
        again = [self.fill(v, depth - 1) for v in given]
        return [v for values, _ in again for v in values], placeholder.spread or any(s for _, s in again)

    def value(self, element: Any, depth: int) -> Any:
        values, spread = self.fill(element, depth)
        return values if spread else values[0]


def apply_helpers(config: Mapping, params: Mapping, recursive: int = 0) -> dict:
    """``config`` with all placeholders filled."""
    filler = Filler(params)
    return {key: filler.value(element, recursive) for key, element in config.items()}
