"""Nodes and card graphs.

A ``Node`` wraps a card with its flags and fitted state.  A ``CardGraph``
orders nodes by the columns they read and write and runs them layer by
layer.  Everything here only composes lazy DataFrames: each fit is a Spark
job on the table as it stands after the previous layers, and each
transform adds columns (per-row cards fuse into the plan with
``withColumn``; keyed cards are update-joined by the id column).
"""

from __future__ import annotations

import copy
import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from cardinal.plans.card import Card, CardState, card_from_dict


@dataclass
class Node:
    card: Card
    update: bool = True
    train: bool = True
    inverted: bool = False
    label: str | None = None
    state: CardState = field(default_factory=CardState)

    @classmethod
    def from_dict(cls, d: Mapping) -> "Node":
        d = dict(d)
        if "card" in d:
            card = d["card"] if isinstance(d["card"], Card) else card_from_dict(d["card"])
            st = d.get("state") or {}
            return cls(card, update=d.get("update", True), train=d.get("train", True), label=d.get("label"),
                       state=CardState(content=st.get("content", {}), metadata=st.get("metadata", {})))
        label = d.pop("label", None)
        return cls(card_from_dict(d), label=label)

    # -- variables by mode (L4, L5) -------------------------------------------
    def inputs(self, mode: str = "train") -> list[str]:
        sv = self.card.source_variables()
        if mode == "train":
            return sv.all()
        if mode == "eval":
            return list(dict.fromkeys(sv.order_by + sv.group_by + sv.helpers + sv.inputs))
        if mode == "inverse":
            return list(sv.inverse_inputs)
        raise ValueError(mode)

    def outputs(self, mode: str = "eval") -> list[str]:
        ov = self.card.output_variables()
        return list(ov.inverse_outputs if mode == "inverse" else ov.outputs)

    # -- train / evaluate (L6, L7) ---------------------------------------------
    def fit(self, df: DataFrame, id_var: str | None = None) -> "Node":
        if self.train and not self.inverted:
            self.state = self.card.fit(df, id_var)
        return self

    def evaluate(self, df: DataFrame, id_var: str | None = None) -> DataFrame:
        if self.inverted:
            return self.card.inverse_transform(df, self.state, id_var)
        return self.card.transform(df, self.state, id_var)

    def invert(self) -> "Node":
        """Inverted copy (L15): only invertible cards; training is disabled."""
        if not self.card.invertible:
            raise ValueError(f"card {self.card.type!r} is not invertible")
        if self.inverted:
            raise ValueError("node is already inverted")
        return Node(self.card, update=self.update, train=False, inverted=True, label=self.label, state=self.state)

    def unlink(self) -> "Node":
        """Copy with independent state."""
        return Node(self.card, self.update, self.train, self.inverted, self.label, copy.deepcopy(self.state))

    def report(self) -> dict:
        return self.card.report(self.state)

    # -- persistence (L16) -----------------------------------------------------
    def save(self, path: str) -> None:
        """Card config + JSON state; keyed state tables as parquet beside it.

        Everything goes to a new folder below ``path``, and the pointer
        ``path/current`` is written last: a node may be saved over the place
        its own tables are read from.
        """
        root = path.rstrip("/")
        version = f"v-{uuid.uuid4().hex}"
        for name, t in self.state.tables.items():
            t.write.parquet(f"{root}/{version}/{name}.parquet")
        doc = {"card": self.card.to_dict(), "train": self.train, "update": self.update, "label": self.label,
               "state": {"content": self.state.content, "metadata": self.state.metadata, "tables": list(self.state.tables)}}
        text = json.dumps(doc, default=_json_default)
        spark = SparkSession.getActiveSession()
        spark.createDataFrame([(text,)], "doc string").coalesce(1).write.text(f"{root}/{version}/node.json")
        spark.createDataFrame([(version,)], "v string").coalesce(1).write.mode("overwrite").text(f"{root}/current")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Node":
        root = path.rstrip("/")
        folder = f"{root}/{spark.read.text(f'{root}/current').first()[0]}"
        doc = json.loads(spark.read.text(f"{folder}/node.json").first()[0])
        st = doc["state"]
        tables = {k: spark.read.parquet(f"{folder}/{k}.parquet") for k in st.get("tables", [])}
        return cls(card_from_dict(doc["card"]), update=doc.get("update", True), train=doc.get("train", True),
                   label=doc.get("label"),
                   state=CardState(content=_restore(st["content"]), metadata=st.get("metadata", {}), tables=tables))


def _json_default(o):
    """Arrays, numpy scalars and dates have a JSON form; any other object cannot be saved."""
    import datetime
    import decimal

    import numpy as np

    if isinstance(o, np.ndarray):
        return {"__ndarray__": o.tolist()}
    if isinstance(o, np.generic):
        return o.item()
    if isinstance(o, (datetime.date, datetime.datetime)):
        return {"__date__" if type(o) is datetime.date else "__datetime__": o.isoformat()}
    if isinstance(o, decimal.Decimal):
        return {"__decimal__": str(o)}
    raise TypeError(f"{type(o).__name__} cannot be saved as JSON")


def _restore(o):
    if isinstance(o, dict):
        if set(o) == {"__ndarray__"}:
            import numpy as np

            return np.asarray(o["__ndarray__"])
        if set(o) <= {"__date__", "__datetime__", "__decimal__"} and len(o) == 1:
            import datetime
            import decimal

            (kind, text), = o.items()
            return {"__date__": datetime.date.fromisoformat, "__datetime__": datetime.datetime.fromisoformat,
                    "__decimal__": decimal.Decimal}[kind](text)
        return {k: _restore(v) for k, v in o.items()}
    if isinstance(o, list):
        return [_restore(v) for v in o]
    return o


class CardGraph:
    """Dependency graph of nodes over variables."""

    def __init__(self, nodes: Sequence[Node | Card | Mapping]):
        self.nodes = [n if isinstance(n, Node) else Node(n) if isinstance(n, Card) else Node.from_dict(n) for n in nodes]
        self.producer: dict[str, int] = {}
        for i, n in enumerate(self.nodes):
            for c in n.outputs("inverse" if n.inverted else "eval"):
                if c in self.producer:
                    raise ValueError(f"column {c!r} is written by two nodes")
                self.producer[c] = i
        self.parents = []
        for i, n in enumerate(self.nodes):
            ins = n.inputs("inverse" if n.inverted else "train")
            self.parents.append(sorted({self.producer[c] for c in ins if c in self.producer and self.producer[c] != i}))
        self._heights = self._compute_heights()

    def _compute_heights(self) -> list[int]:
        h: dict[int, int] = {}
        visiting: set[int] = set()

        def height(i: int) -> int:
            if i in h:
                return h[i]
            if i in visiting:
                raise ValueError("cycle in card graph")
            visiting.add(i)
            h[i] = 1 + max((height(p) for p in self.parents[i]), default=-1)
            visiting.discard(i)
            return h[i]

        return [height(i) for i in range(len(self.nodes))]

    def source_variables(self) -> list[str]:
        """Inputs that no node outputs (must exist in the table)."""
        out = []
        for n in self.nodes:
            for c in n.inputs("inverse" if n.inverted else "train"):
                if c not in self.producer and c not in out:
                    out.append(c)
        return out

    def output_variables(self) -> list[str]:
        return list(self.producer)

    def update_heights(self) -> list[int]:
        """Layer of each node, or -1 when neither it nor anything upstream must be recomputed."""
        need: dict[int, bool] = {}

        def needs(i: int) -> bool:
            if i not in need:
                need[i] = self.nodes[i].update or any(needs(p) for p in self.parents[i])
            return need[i]

        return [self._update_height(i, needs) for i in range(len(self.nodes))]

    def _update_height(self, i, needs) -> int:
        if not needs(i):
            return -1
        return 1 + max((self._update_height(p, needs) for p in self.parents[i] if needs(p)), default=-1)

    def layers(self, heights: Sequence[int] | None = None) -> list[list[int]]:
        heights = list(heights if heights is not None else self._heights)
        top = max(heights, default=-1)
        return [[i for i, h in enumerate(heights) if h == k] for k in range(top + 1)]

    # -- execution (L8-L11) ----------------------------------------------------
    def evaljoin(self, df: DataFrame, id_var: str | None = None, *, incremental: bool = False,
                 callback: Callable[[Node], None] | None = None) -> DataFrame:
        heights = self.update_heights() if incremental else None
        self._check_sources(df)
        for layer in self.layers(heights):
            for i in layer:
                df = self.nodes[i].evaluate(df, id_var)
                if callback:
                    callback(self.nodes[i])
        return df

    def train_evaljoin(self, df: DataFrame, id_var: str | None = None, *, incremental: bool = False,
                       callback: Callable[[Node], None] | None = None,
                       after_fit: Callable[[Node], None] | None = None) -> DataFrame:
        heights = self.update_heights() if incremental else None
        self._check_sources(df)
        for layer in self.layers(heights):
            # All fits of a layer read the same table; then all evaluations.
            for i in layer:
                self.nodes[i].fit(df, id_var)
                if after_fit:
                    after_fit(self.nodes[i])
            for i in layer:
                df = self.nodes[i].evaluate(df, id_var)
                if callback:
                    callback(self.nodes[i])
        return df

    def _check_sources(self, df: DataFrame) -> None:
        missing = [c for c in self.source_variables() if c not in df.columns]
        if missing:
            raise ValueError(f"missing input columns: {missing}")

    def report(self) -> list[dict]:
        return [n.report() for n in self.nodes]

    # -- lineage (L19) ---------------------------------------------------------
    def lineage(self) -> list[tuple[str, str, str]]:
        rows = []
        for i, n in enumerate(self.nodes):
            name = n.label or f"{n.card.type}_{i + 1}"
            for c in n.inputs("inverse" if n.inverted else "train"):
                rows.append((name, c, "input"))
            for c in n.outputs("inverse" if n.inverted else "eval"):
                rows.append((name, c, "output"))
        return rows

    def to_dot(self) -> str:
        lines = ["digraph {"]
        for node, col, role in self.lineage():
            a, b = (col, node) if role == "input" else (node, col)
            lines.append(f'    "{a}" -> "{b}";')
        lines.append("}")
        return "\n".join(lines) + "\n"


def train_evaljoin(nodes: Sequence[Node | Card | Mapping], df: DataFrame, id_var: str | None = None) -> DataFrame:
    return CardGraph(nodes).train_evaljoin(df, id_var)


def evaljoin(nodes: Sequence[Node | Card | Mapping], df: DataFrame, id_var: str | None = None) -> DataFrame:
    return CardGraph(nodes).evaljoin(df, id_var)
