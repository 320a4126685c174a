"""What a parsed query consists of."""

from __future__ import annotations

from dataclasses import dataclass, field

UNBOUND = None


@dataclass(frozen=True)
class Range:
    """Distances from ``low`` to ``high``; no ``high``: without bound."""

    low: int = 1
    high: int | None = 1


ANY_DISTANCE = Range(1, UNBOUND)


@dataclass(frozen=True)
class Search:
    """A node search. ``kind``: value (an annotation, any or with a value), token (a token's text), any_token, any_node."""

    kind: str
    ns: str | None = None
    name: str | None = None
    value: str | None = None
    regex: bool = False
    negated: bool = False
    leafs_only: bool = False
    meta: bool = False


@dataclass(frozen=True)
class EdgeSearch:
    """A condition on an edge's annotation."""

    ns: str | None
    name: str
    value: str
    regex: bool = False
    negated: bool = False


@dataclass(frozen=True)
class Operator:
    """A binary operator. ``kind``: dominance, pointing, precedence, near, overlap, inclusion, ident_cov, left, right, ident_node, part_of, equal, not_equal."""

    kind: str
    name: str = ""
    dist: Range = Range()
    edge: EdgeSearch | None = None

    @property
    def reflexive(self) -> bool:
        return self.kind not in ("overlap", "inclusion", "ident_cov", "left", "right", "part_of")

    @property
    def binding(self) -> bool:
        return self.kind not in ("equal", "not_equal")


@dataclass(frozen=True)
class Ref:
    name: str


@dataclass(frozen=True)
class NodeLiteral:
    search: Search
    start: int
    end: int
    variable: str | None = None
    optional: bool = False


@dataclass(frozen=True)
class BinaryLiteral:
    left: Ref | NodeLiteral
    op: Operator
    right: Ref | NodeLiteral
    negated: bool
    start: int
    end: int


@dataclass(frozen=True)
class UnaryLiteral:
    ref: Ref
    arity: Range
    start: int
    end: int


@dataclass(frozen=True)
class MetaLiteral:
    search: Search
    start: int
    end: int


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass
class QueryNode:
    """A node of a conjunction; ``variable`` is its number among all alternatives, or its name."""

    search: Search
    variable: str
    number: int
    optional: bool = False
    in_output: bool = True
    start: int | None = None
    end: int | None = None


@dataclass
class Join:
    """``left`` op ``right``, as indices of the conjunction's nodes."""

    op: Operator
    left: int
    right: int
    negated: bool = False
    global_reflexivity: bool = True


@dataclass
class Absent:
    """Keep a row only if nothing that satisfies ``target`` is in relation to ``node``."""

    op: Operator
    node: int
    target: Search
    target_left: bool


@dataclass
class Conjunction:
    nodes: list[QueryNode] = field(default_factory=list)
    joins: list[Join] = field(default_factory=list)
    arity: list[tuple[int, Range]] = field(default_factory=list)
    absent: list[Absent] = field(default_factory=list)

    def output(self) -> list[int]:
        return [i for i, n in enumerate(self.nodes) if n.in_output and not n.optional]


@dataclass
class Query:
    alternatives: list[Conjunction]
    text: str = ""
