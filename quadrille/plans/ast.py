"""What the parser makes of a query's text."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Const:
    value: str
    kind: str = "iri"  # iri, literal, number or blank


@dataclass(frozen=True)
class Quoted:
    s: object
    p: object
    o: object


Term = Var | Const | Quoted


@dataclass(frozen=True)
class Triple:
    s: Term
    p: Term
    o: Term


# expressions of filters
@dataclass(frozen=True)
class Compare:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Arith:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Logic:
    op: str  # and, or, not
    args: tuple


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


# elements of groups
@dataclass
class Triples:
    triples: list[Triple]


@dataclass
class Filter:
    expr: object


@dataclass
class Bind:
    call: Call
    var: str


@dataclass
class Values:
    vars: list[str]
    rows: list[list[Const | None]]


@dataclass
class Graph:
    name: Term
    group: Group


@dataclass
class Union:
    branches: list[Group]


@dataclass
class Window:
    name: str
    triples: list[Triple]


@dataclass
class Not:
    triples: list[Triple]


@dataclass
class Group:
    elements: list = field(default_factory=list)

    def all(self, kind):
        return [e for e in self.elements if isinstance(e, kind)]


@dataclass
class Item:
    """A column of SELECT: a variable, or an aggregate of one."""

    var: str | None
    fn: str | None = None
    alias: str | None = None

    @property
    def name(self) -> str:
        return self.alias or (self.var if self.fn is None else f"{self.fn.lower()}_{self.var or 'all'}")


@dataclass
class Select:
    items: list[Item] | None  # None: *
    where: Group
    distinct: bool = False
    froms: list[str] = field(default_factory=list)
    named: list[str] = field(default_factory=list)
    group_by: list[str] = field(default_factory=list)
    order_by: list[tuple[str, bool]] = field(default_factory=list)
    limit: int | None = None


@dataclass
class Template:
    """Quads of an Update: (graph term or None, triple)."""

    quads: list[tuple[Term | None, Triple]]

    def variables(self) -> set[str]:
        out: set[str] = set()
        for g, t in self.quads:
            for x in (g, t.s, t.p, t.o):
                out |= variables(x)
        return out


@dataclass
class Update:
    delete: Template | None
    insert: Template | None
    where: Group | None


@dataclass
class WindowSpec:
    name: str
    stream: Term
    kind: str
    width: int
    step: int | None
    report: list[tuple[str, int | None]]
    tick: str
    policy: tuple | None = None


@dataclass
class Register:
    operator: str
    output: str
    select: Select
    windows: list[WindowSpec]


@dataclass
class MLPredict:
    model: str
    input: Select
    output: str


@dataclass
class RuleDecl:
    name: str
    head: list[Triple]
    body: Group
    prob: dict | None = None
    operator: str | None = None
    windows: list[WindowSpec] = field(default_factory=list)
    predict: MLPredict | None = None


@dataclass
class ModelDecl:
    name: str
    hidden: list[int]
    kind: str  # exclusive or binary
    labels: list[str]


@dataclass
class NeuralDecl:
    predicate: str
    model: str
    input: Group
    features: list[str]
    anchor: str


@dataclass
class TrainDecl:
    predicate: str
    data: Group | Select
    label: str
    target: Triple | None
    loss: str
    optimizer: str
    rate: float
    epochs: int
    batch: int
    save_to: str | None


@dataclass
class Retrieve:
    mode: str
    state: str
    var: str
    stream: str
    triples: list[Triple]


@dataclass
class Request:
    """Everything one text may hold."""

    prefixes: dict[str, str] = field(default_factory=dict)
    retrieve: Retrieve | None = None
    register: Register | None = None
    models: list[ModelDecl] = field(default_factory=list)
    neural: list[NeuralDecl] = field(default_factory=list)
    training: list[TrainDecl] = field(default_factory=list)
    rules: list[RuleDecl] = field(default_factory=list)
    predict: MLPredict | None = None
    select: Select | None = None
    update: Update | None = None


def variables(x) -> set[str]:
    """Names of the variables in a term, triple, expression or group (subqueries by what they give)."""
    if isinstance(x, Var):
        return {x.name}
    if isinstance(x, (Quoted, Triple)):
        return variables(x.s) | variables(x.p) | variables(x.o)
    if isinstance(x, (Compare, Arith)):
        return variables(x.left) | variables(x.right)
    if isinstance(x, (Logic, Call)):
        return set().union(*[variables(a) for a in x.args]) if x.args else set()
    if isinstance(x, (Triples, Window, Not)):
        return set().union(*[variables(t) for t in x.triples]) if x.triples else set()
    if isinstance(x, Filter):
        return variables(x.expr)
    if isinstance(x, Bind):
        return variables(x.call) | {x.var}
    if isinstance(x, Values):
        return set(x.vars)
    if isinstance(x, Graph):
        return variables(x.name) | variables(x.group)
    if isinstance(x, Union):
        return set().union(*[variables(b) for b in x.branches])
    if isinstance(x, Group):
        return set().union(set(), *[variables(e) for e in x.elements])
    if isinstance(x, Select):
        return variables(x.where) if x.items is None else {i.name for i in x.items}
    return set()
