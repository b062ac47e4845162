"""Rules over triples, and the notations they come in."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from ..plans import ast as A
from ..plans.parser import Parser, ParseError, parse


@dataclass(frozen=True)
class Rule:
    """premise (and not negative, if filters) gives conclusion."""

    premise: tuple[A.Triple, ...]
    conclusion: tuple[A.Triple, ...]
    negative: tuple[A.Triple, ...] = ()
    filters: tuple = ()
    name: str = ""

    def check(self) -> Rule:
        """Every variable of NOT, of a filter and of the conclusion has to be bound by the premise."""
        bound = set().union(*[A.variables(t) for t in self.premise]) if self.premise else set()
        for what, parts in (("NOT", self.negative), ("conclusion", self.conclusion)):
            for t in parts:
                if loose := A.variables(t) - bound:
                    raise ValueError(f"rule {self.name}: {what} has unbound variables {sorted(loose)}")
        return self

    def predicates(self, parts) -> set[str | None]:
        """Predicates of some triples; None stands for any."""
        return {t.p.value if isinstance(t.p, A.Const) else None for t in parts}


def triple(s: str, p: str, o: str) -> A.Triple:
    """From strings; those with a question mark are variables."""
    one = lambda x: A.Var(x[1:]) if x[:1] == "?" else A.Const(x)
    return A.Triple(one(s), one(p), one(o))


def rule(premise, conclusion, negative=(), filters=(), name="") -> Rule:
    """From lists of string triples; filters are texts like "?x > 5"."""
    parsed = tuple(Parser(f).expression() if isinstance(f, str) else f for f in filters)
    return Rule(tuple(triple(*t) for t in premise), tuple(triple(*t) for t in conclusion), tuple(triple(*t) for t in negative), parsed, name).check()


def from_declaration(d: A.RuleDecl) -> Rule:
    body = d.body
    premise, inner = [], []

    def walk(g: A.Group):
        for e in g.elements:
            if isinstance(e, A.Triples):
                premise.extend(e.triples)
            elif isinstance(e, A.Window):
                premise.extend(e.triples)
            elif isinstance(e, A.Group):
                walk(e)
            elif isinstance(e, (A.Bind, A.Values, A.Select, A.Union, A.Graph)):
                inner.append(e)

    walk(body)
    negative = [t for e in body.all(A.Not) for t in e.triples]
    filters = [e.expr for e in body.all(A.Filter)]
    r = Rule(tuple(premise), tuple(d.head), tuple(negative), tuple(filters), d.name)
    if inner:
        return replace(r, name=d.name)
    return r.check()


def parse_rules(text: str, prefixes: dict | None = None) -> list[tuple[Rule, A.RuleDecl]]:
    """RULE declarations, with what else they declare."""
    return [(from_declaration(d), d) for d in parse(text, prefixes).rules]


def parse_n3(text: str) -> list[Rule]:
    """`{ premise } => { conclusion } .` with @prefix lines."""
    prefixes = dict(re.findall(r"@?prefix\s+([\w-]*):\s*<([^>]*)>\s*\.?", text, re.I))
    body = re.sub(r"@?prefix\s+[\w-]*:\s*<[^>]*>\s*\.?", " ", text, flags=re.I)
    p, out = Parser(body, prefixes), []
    while p.kind() != "end":
        p.need("{")
        premise = p.triple_block()
        p.need("}")
        if not p.take("=>"):
            raise ParseError("expected =>")
        p.need("{")
        conclusion = p.triple_block()
        p.need("}")
        p.take(".")
        out.append(Rule(tuple(premise), tuple(conclusion), name=f"n3-{len(out)}").check())
    return out
