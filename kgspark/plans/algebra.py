"""The logical algebra: five operators and three kinds of expression, with explanations as text and JSON."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence
from dataclasses import InitVar, dataclass, field
from typing import Any

from kgspark.functions.registry import FunctionRegistry

QUAD = ("subject", "predicate", "object", "graph")


class Expression:
    def references(self) -> set[str]:
        return set()


@dataclass(frozen=True)
class Constant(Expression):
    value: Any

    def __str__(self) -> str:
        return f"Const({self.value!r})"

    def as_json(self) -> dict:
        return {"type": "Constant", "value": str(self.value)}


@dataclass(frozen=True)
class Reference(Expression):
    name: str

    def __str__(self) -> str:
        return f"Ref({self.name})"

    def references(self) -> set[str]:
        return {self.name}

    def as_json(self) -> dict:
        return {"type": "Reference", "attribute": self.name}


@dataclass(frozen=True)
class FunctionCall(Expression):
    """function: a URI of the registry."""

    function: str
    args: tuple[Expression, ...] = ()

    def __str__(self) -> str:
        return f"{self.function}({', '.join(map(str, self.args))})"

    def references(self) -> set[str]:
        return set().union(*(a.references() for a in self.args)) if self.args else set()

    def as_json(self) -> dict:
        return {"type": "FunctionCall", "function": self.function, "arguments": [a.as_json() for a in self.args]}


class Operator:
    """Operators are values; execute() gives a Relation over a DataFrame."""

    def attributes(self) -> list[str]:
        raise NotImplementedError

    def extend(self, name: str, expression: Expression) -> Extend:
        return Extend(self, name, expression)

    def project(self, *names: str) -> Project:
        return Project(self, tuple(names))

    def union(self, *others: Operator, distinct: bool = False) -> Union:
        return Union((self, *others), distinct)

    def join(self, other: Operator, left: list[str], right: list[str]) -> EquiJoin:
        return EquiJoin(self, other, tuple(left), tuple(right))

    def execute(self, spark, strict: bool | None = None):
        """strict: a reference without any value is an error; by default if KGSPARK_STRICT_REFERENCES is 1."""
        from kgspark.operators.lower import lower

        return lower(self, spark, os.environ.get("KGSPARK_STRICT_REFERENCES") == "1" if strict is None else strict)

    def children(self) -> list[tuple[str, Operator]]:
        return []

    def facts(self) -> list[tuple[str, Any]]:
        return []

    def explain(self, depth: int = 0, prefix: str = "") -> str:
        pad = "  " * depth
        lines = [f"{pad}{prefix}{type(self).__name__}("] + [f"{pad}  {k}: {v}" for k, v in self.facts()]
        below = self.children()
        for i, (label, child) in enumerate(below):
            last = i == len(below) - 1
            lines.append(f"{pad}  {label}:")
            lines.append(child.explain(depth + 2, "\\-- " if last else "|-- "))
        return "\n".join([*lines, f"{pad})"])

    def as_json(self) -> dict:
        out: dict = {"type": type(self).__name__, "parameters": {k: v if isinstance(v, (int, bool, list, dict, type(None))) else str(v) for k, v in self.json_facts()}}
        below = self.children()
        if isinstance(self, Union):
            out["children"] = [c.as_json() for _, c in below]
        else:
            out |= {label: c.as_json() for label, c in below}
        return out

    def json_facts(self) -> list[tuple[str, Any]]:
        return self.facts()

    def explain_json(self, indent: int = 2) -> str:
        return json.dumps(self.as_json(), indent=indent, ensure_ascii=False)

    def save_explanation(self, path: str, as_json: bool = False) -> None:
        with open(path, "w", encoding="utf-8") as f:
            f.write(self.explain_json() if as_json else self.explain())


@dataclass(frozen=True)
class Source(Operator):
    """reader: a source of kgspark.sources; mappings: attribute to query."""

    reader: Any
    iterator: str
    mappings: tuple[tuple[str, str], ...]

    def attributes(self) -> list[str]:
        return [a for a, _ in self.mappings]

    def facts(self):
        return [("source", type(self.reader).__name__), ("iterator", self.iterator), ("mappings", [a for a, _ in self.mappings])]

    def json_facts(self):
        return [("source_type", type(self.reader).__name__), ("iterator", self.iterator), ("attribute_mappings", dict(self.mappings)), *self.reader.facts()]


@dataclass(frozen=True)
class Extend(Operator):
    parent: Operator
    attribute: str
    expression: Expression

    def attributes(self) -> list[str]:
        return [*(a for a in self.parent.attributes() if a != self.attribute), self.attribute]

    def facts(self):
        return [("attribute", self.attribute), ("expression", str(self.expression))]

    def json_facts(self):
        return [("new_attribute", self.attribute), ("expression", self.expression.as_json())]

    def children(self):
        return [("parent", self.parent)]


@dataclass(frozen=True)
class Project(Operator):
    parent: Operator
    names: tuple[str, ...]

    def __post_init__(self):
        missing = set(self.names) - set(self.parent.attributes())
        if missing:
            raise KeyError(f"no such attributes: {sorted(missing)}")

    def attributes(self) -> list[str]:
        return list(self.names)

    def facts(self):
        return [("attributes", sorted(self.names))]

    def children(self):
        return [("parent", self.parent)]


@dataclass(frozen=True)
class Union(Operator):
    parts: tuple[Operator, ...]
    distinct: bool = False

    def __post_init__(self):
        if not self.parts:
            raise ValueError("a union needs an operator")
        object.__setattr__(self, "parts", tuple(self.parts))

    def attributes(self) -> list[str]:
        return list(dict.fromkeys(a for p in self.parts for a in p.attributes()))

    def facts(self):
        return [("operators", len(self.parts)), ("distinct", self.distinct)]

    def children(self):
        return [(f"[{i}]", p) for i, p in enumerate(self.parts)]


@dataclass(frozen=True)
class EquiJoin(Operator):
    """Inner join on lexical forms; epsilon meets epsilon. Without conditions: all pairs."""

    left: Operator
    right: Operator
    left_attributes: tuple[str, ...] = ()
    right_attributes: tuple[str, ...] = ()
    names: tuple[str, ...] = field(default=(), compare=False)
    A: InitVar[Sequence[str] | None] = None  # older names of the two lists
    B: InitVar[Sequence[str] | None] = None

    def __post_init__(self, A, B):
        for attr, older in (("left_attributes", A), ("right_attributes", B)):
            if older is not None and not getattr(self, attr):
                object.__setattr__(self, attr, tuple(older))
        if len(self.left_attributes) != len(self.right_attributes):
            raise ValueError("a join needs as many left as right attributes")
        pairs = ((self.left, "left_attributes"), (self.right, "right_attributes"))
        for side, attr in pairs:
            object.__setattr__(self, attr, tuple(_named(side, a) for a in getattr(self, attr)))
        both = set(self.left.attributes()) & set(self.right.attributes()) - {a for a, b in self.conditions() if a == b}
        if both:
            raise ValueError(f"attributes of both sides, rename them: {sorted(both)}")

    def conditions(self) -> list[tuple[str, str]]:
        return list(zip(self.left_attributes, self.right_attributes, strict=True))

    def attributes(self) -> list[str]:
        return list(dict.fromkeys([*self.left.attributes(), *self.right.attributes()]))

    def facts(self):
        return [("conditions", "[" + ", ".join(f"{a} = {b}" for a, b in self.conditions()) + "]")]

    def json_facts(self):
        return [("join_conditions", [{"left": a, "right": b} for a, b in self.conditions()]), ("left_attributes", list(self.left_attributes)), ("right_attributes", list(self.right_attributes))]

    def children(self):
        return [("left", self.left), ("right", self.right)]


def _named(side: Operator, name: str) -> str:
    """An attribute by its name, by the name with or without 'parent_', or by its name in another case."""
    have = side.attributes()
    for candidate in (name, name.removeprefix("parent_"), f"parent_{name}"):
        if candidate in have:
            return candidate
    for a in have:
        if a.lower() == name.lower():
            return a
    raise KeyError(f"no attribute {name!r} among {have}")


def known_function(uri: str) -> bool:
    return FunctionRegistry.get(uri) is not None
