"""Text to syntax tree: queries, updates, rules, continuous queries and learned relations."""

from __future__ import annotations

import re

from ..terms import RDF_TYPE
from . import ast as A

_TOKENS = re.compile(
    r"""(?P<space>(?:\s+|\#[^\n]*)+)
    |(?P<iri><(?![<=\s])[^<>\s]*>)
    |(?P<quoted>"{3}(?:[^"\\]|\\.|"(?!""))*"{3}|'{3}(?:[^'\\]|\\.|'(?!''))*'{3}|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<var>[?$][\w-]+)
    |(?P<number>[+-]?(?:\d+\.\d+|\.\d+|\d+)(?:[eE][+-]?\d+)?(?![\w]))
    |(?P<blank>_:[\w-]+)
    |(?P<name>[A-Za-z_][\w-]*(?:\.[\w-]+)*(?::[\w.%-]*[\w%-]|:)?|:[\w.%-]*[\w%-]|:)
    |(?P<sign>:-|<<|>>|&&|\|\||!=|<=|>=|\^\^|@[A-Za-z-]+|=>|[{}()\[\].,;*=<>!+/|^-])""",
    re.X | re.S,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
AGGREGATES = ("COUNT", "SUM", "MIN", "MAX", "AVG")


class ParseError(ValueError):
    """The text is not a query; says where, and what was expected."""


def unescape(text: str) -> str:
    def one(m):
        x = m[1]
        if x[0] in "uU":
            return chr(int(x[1:], 16))
        return _ESCAPES.get(x, x)

    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", one, text, flags=re.S)


def literal(token: str) -> str:
    return unescape(token[3:-3] if token[:3] in ('"""', "'''") and len(token) >= 6 else token[1:-1])


class Parser:
    def __init__(self, text: str, prefixes: dict[str, str] | None = None):
        self.text, self.tokens, self.at = text, [], 0
        self.prefixes = dict(prefixes or {})
        pos = 0
        while pos < len(text):
            m = _TOKENS.match(text, pos)
            if not m:
                raise ParseError(f"unexpected {text[pos : pos + 20]!r} at {self._place(pos)}")
            if m.lastgroup != "space":
                self.tokens.append((m.lastgroup, m[0], pos))
            pos = m.end()
        self.tokens.append(("end", "", len(text)))

    # -- tokens -----------------------------------------------------------------
    def _place(self, pos: int) -> str:
        line = self.text.count("\n", 0, pos) + 1
        return f"line {line}, column {pos - self.text.rfind(chr(10), 0, pos)}"

    def fail(self, wanted: str):
        kind, value, pos = self.tokens[self.at]
        raise ParseError(f"expected {wanted}, found {value or 'the end'!r} at {self._place(pos)}")

    def peek(self, *values: str, ahead: int = 0) -> bool:
        kind, value, _ = self.tokens[min(self.at + ahead, len(self.tokens) - 1)]
        return kind in ("sign", "name") and (value in values or kind == "name" and value.upper() in values)

    def kind(self, ahead: int = 0) -> str:
        return self.tokens[min(self.at + ahead, len(self.tokens) - 1)][0]

    def take(self, *values: str) -> bool:
        if self.peek(*values):
            self.at += 1
            return True
        return False

    def need(self, *values: str) -> None:
        for v in values:
            if not self.take(v):
                self.fail(v)

    def pop(self, *kinds: str) -> str:
        kind, value, _ = self.tokens[self.at]
        if kind not in kinds:
            self.fail(" or ".join(kinds))
        self.at += 1
        return value

    # -- terms --------------------------------------------------------------------
    def resolve(self, name: str) -> str:
        prefix, colon, local = name.partition(":")
        if colon and prefix in self.prefixes:
            return self.prefixes[prefix] + local
        return name

    def iri(self) -> str:
        if self.kind() == "iri":
            return unescape(self.pop("iri")[1:-1])
        return self.resolve(self.pop("name"))

    def term(self, predicate: bool = False):
        kind, value, _ = self.tokens[self.at]
        if kind == "var":
            self.at += 1
            return A.Var(value[1:])
        if kind == "iri":
            return A.Const(self.iri())
        if kind == "quoted":
            self.at += 1
            out = literal(value)
            if self.tokens[self.at][1].startswith("@") and self.kind() == "sign":
                out += self.pop("sign")
            elif self.take("^^"):
                self.iri()
            return A.Const(out, "literal")
        if kind == "number":
            self.at += 1
            return A.Const(value, "number")
        if kind == "blank":
            self.at += 1
            return A.Const(value, "blank")
        if self.take("<<"):
            self.take("(")
            out = A.Quoted(self.term(), self.term(True), self.term())
            self.take(")")
            self.need(">>")
            return out
        if kind == "name":
            if predicate and value == "a":
                self.at += 1
                return A.Const(RDF_TYPE)
            if value in ("true", "false"):
                self.at += 1
                return A.Const(value, "literal")
            if ":" in value or value == "a":
                self.at += 1
                return A.Const(self.resolve(value))
        self.fail("a term")

    def triples(self) -> list[A.Triple]:
        out, s = [], self.term()
        while True:
            p = self.term(True)
            while True:
                out.append(A.Triple(s, p, self.term()))
                if not self.take(","):
                    break
            if not self.take(";"):
                return out
            if self.peek(".", "}"):
                return out

    def triple_block(self, stop=("}",)) -> list[A.Triple]:
        out = []
        while not self.peek(*stop):
            out += self.triples()
            if not self.take("."):
                break
        return out

    # -- expressions ------------------------------------------------------------------
    def expression(self):
        args = [self.conjunction()]
        while self.take("||"):
            args.append(self.conjunction())
        return args[0] if len(args) == 1 else A.Logic("or", tuple(args))

    def conjunction(self):
        args = [self.negation()]
        while self.take("&&"):
            args.append(self.negation())
        return args[0] if len(args) == 1 else A.Logic("and", tuple(args))

    def negation(self):
        if self.take("!"):
            return A.Logic("not", (self.negation(),))
        left = self.sum()
        for op in ("<=", ">=", "!=", "=", "<", ">"):
            if self.take(op):
                return A.Compare(op, left, self.sum())
        return left

    def sum(self):
        out = self.product()
        while self.peek("+", "-") or self.kind() == "number" and self.tokens[self.at][1][0] in "+-":
            if self.kind() == "number":  # 1 -2 without a blank
                _, value, pos = self.tokens[self.at]
                self.tokens[self.at : self.at + 1] = [("sign", value[0], pos), ("number", value[1:], pos + 1)]
            op = self.pop("sign")
            out = A.Arith(op, out, self.product())
        return out

    def product(self):
        out = self.atom()
        while self.peek("*", "/"):
            op = self.pop("sign")
            out = A.Arith(op, out, self.atom())
        return out

    def atom(self):
        if self.take("("):
            out = self.expression()
            self.need(")")
            return out
        if self.kind() == "name" and self.tokens[self.at + 1][1] == "(":
            return self.call()
        return self.term()

    def call(self) -> A.Call:
        name = self.pop("name", "iri")
        self.need("(")
        args = []
        while not self.take(")"):
            args.append(self.term())
            if not self.take(",") and not self.peek(")"):
                self.fail(", or )")
        return A.Call(name, tuple(args))

    # -- groups -------------------------------------------------------------------------
    def group(self, rule: bool = False) -> A.Group:
        self.need("{")
        out = A.Group()
        while not self.take("}"):
            if self.take("FILTER"):
                self.need("(")
                out.elements.append(A.Filter(self.expression()))
                self.need(")")
            elif self.take("BIND"):
                self.need("(")
                call = self.call()
                self.need("AS")
                out.elements.append(A.Bind(call, self.pop("var")[1:]))
                self.need(")")
            elif self.take("VALUES"):
                out.elements.append(self.values())
            elif self.take("NOT"):
                braced = self.take("{")
                out.elements.append(A.Not(self.triple_block() if braced else self.triples()))
                if braced:
                    self.need("}")
            elif self.take("WINDOW"):
                name = self.iri()
                self.need("{")
                out.elements.append(A.Window(name, self.triple_block()))
                self.need("}")
            else:
                first = self.primary()
                if self.peek("UNION"):
                    branches = [first]
                    while self.take("UNION"):
                        branches.append(self.primary())
                    if any(isinstance(b, A.Triples) for b in branches):
                        self.fail("{ around each side of UNION")
                    out.elements.append(A.Union([b if isinstance(b, A.Group) else A.Group([b]) for b in branches]))
                else:
                    out.elements.append(first)
            self.take(".")
        return out

    def primary(self):
        if self.take("GRAPH"):
            name = A.Var(self.pop("var")[1:]) if self.kind() == "var" else A.Const(self.iri())
            return A.Graph(name, self.group())
        if self.peek("{"):
            if self.peek("SELECT", ahead=1):
                self.need("{")
                out = self.select(datasets=False)
                self.need("}")
                return out
            return self.group()
        return A.Triples(self.triples())

    def values(self) -> A.Values:
        one = self.kind() == "var"
        names = []
        if one:
            names.append(self.pop("var")[1:])
        else:
            self.need("(")
            while not self.take(")"):
                names.append(self.pop("var")[1:])
        self.need("{")
        rows = []
        while not self.take("}"):
            if not one:
                self.need("(")
            row = []
            for _ in names:
                row.append(None if self.take("UNDEF") else self.term())
            if not one:
                self.need(")")
            rows.append(row)
        return A.Values(names, rows)

    # -- select and update ------------------------------------------------------------------
    def item(self) -> A.Item:
        if self.kind() == "var":
            return A.Item(self.pop("var")[1:])
        braced = self.take("(")
        fn = self.pop("name").upper()
        if fn not in AGGREGATES:
            self.at -= 1
            self.fail("an aggregate")
        self.need("(")
        var = None if fn == "COUNT" and self.take("*") else self.pop("var")[1:]
        self.need(")")
        alias = self.pop("var")[1:] if self.take("AS") else None
        if braced:
            self.need(")")
        return A.Item(var, fn, alias)

    def select(self, datasets: bool = True) -> A.Select:
        self.need("SELECT")
        distinct = self.take("DISTINCT")
        items = None
        if not self.take("*"):
            items = []
            while self.kind() == "var" or self.peek("(", *AGGREGATES):
                items.append(self.item())
            if not items:
                self.fail("a variable, an aggregate or *")
        out = A.Select(items, A.Group(), distinct)
        while datasets and self.peek("FROM") and not (self.peek("NAMED", ahead=1) and self.peek("WINDOW", ahead=2)):
            self.need("FROM")
            (out.named if self.take("NAMED") else out.froms).append(self.iri())
        self.windows: list[A.WindowSpec] = getattr(self, "windows", [])
        while self.peek("FROM") and self.peek("NAMED", ahead=1) and self.peek("WINDOW", ahead=2):
            self.windows.append(self.window())
        self.take("WHERE")
        out.where = self.group()
        if self.take("GROUP"):
            self.need("BY")
            while self.kind() == "var":
                out.group_by.append(self.pop("var")[1:])
            if not out.group_by:
                self.fail("a variable")
        elif self.take("GROUPBY"):
            while self.kind() == "var":
                out.group_by.append(self.pop("var")[1:])
        if self.take("ORDER"):
            self.need("BY")
            while self.kind() == "var" or self.peek("ASC", "DESC"):
                if self.kind() == "var":
                    out.order_by.append((self.pop("var")[1:], False))
                else:
                    desc = self.pop("name").upper() == "DESC"
                    self.need("(")
                    out.order_by.append((self.pop("var")[1:], desc))
                    self.need(")")
                self.take(",")
            if not out.order_by:
                self.fail("a variable, ASC or DESC")
        if self.take("LIMIT"):
            value = self.pop("number")
            if not value.isdigit():
                self.at -= 1
                self.fail("a whole number")
            out.limit = int(value)
        return out

    def template(self) -> A.Template:
        self.need("{")
        out = []
        while not self.take("}"):
            if self.take("GRAPH"):
                name = A.Var(self.pop("var")[1:]) if self.kind() == "var" else A.Const(self.iri())
                self.need("{")
                out += [(name, t) for t in self.triple_block()]
                self.need("}")
            else:
                out += [(None, t) for t in self.triples()]
            self.take(".")
        return A.Template(out)

    def update(self) -> A.Update:
        if self.take("INSERT"):
            if self.take("DATA"):
                t = self.template()
                if t.variables():
                    raise ParseError("INSERT DATA takes no variables")
                return A.Update(None, t, None)
            t = self.template()
            return A.Update(None, t, self.group() if self.take("WHERE") else A.Group())
        self.need("DELETE")
        if self.take("DATA"):
            t = self.template()
            if t.variables() or any(isinstance(x, A.Const) and x.kind == "blank" for _, q in t.quads for x in (q.s, q.p, q.o)):
                raise ParseError("DELETE DATA takes neither variables nor blank nodes")
            return A.Update(t, None, None)
        if self.take("WHERE"):
            t = self.template()
            return A.Update(t, None, A.Group([A.Triples([q]) if g is None else A.Graph(g, A.Group([A.Triples([q])])) for g, q in t.quads]))
        t = self.template()
        if any(isinstance(x, A.Const) and x.kind == "blank" for _, q in t.quads for x in (q.s, q.p, q.o)):
            raise ParseError("DELETE takes no blank nodes")
        insert = self.template() if self.take("INSERT") else None
        if insert is None and not self.peek("WHERE"):
            return A.Update(t, None, A.Group())
        self.need("WHERE")
        return A.Update(t, insert, self.group())

    # -- windows, rules, learned relations ---------------------------------------------------------
    def seconds(self) -> int:
        if self.kind() == "number":
            return int(self.pop("number"))
        value = self.pop("name").upper()
        m = re.fullmatch(r"PT(\d+)([SMH])", value)
        if not m:
            self.at -= 1
            self.fail("a duration like PT5S")
        return int(m[1]) * {"S": 1, "M": 60, "H": 3600}[m[2]]

    def window(self) -> A.WindowSpec:
        self.need("FROM", "NAMED", "WINDOW")
        name = self.iri()
        self.need("ON")
        if self.peek("STREAM"):
            self.need("STREAM")
        stream = A.Var(self.pop("var")[1:]) if self.kind() == "var" else A.Const(self.iri())
        self.need("[")
        kind = self.pop("name").upper()
        if kind not in ("RANGE", "TUMBLING", "SLIDING"):
            self.at -= 1
            self.fail("RANGE, TUMBLING or SLIDING")
        width = self.seconds()
        step = self.seconds() if self.take("STEP", "SLIDE") else None
        report, tick = [], "TIME_DRIVEN"
        while self.take("REPORT"):
            while True:
                r = self.pop("name").upper()
                if r not in ("ON_WINDOW_CLOSE", "NON_EMPTY_CONTENT", "ON_CONTENT_CHANGE", "PERIODIC"):
                    self.at -= 1
                    self.fail("a report strategy")
                period = None
                if r == "PERIODIC" and self.take("("):
                    period = self.seconds()
                    self.need(")")
                report.append((r, period))
                if not self.take(","):
                    break
        if self.take("TICK"):
            tick = self.pop("name").upper()
        self.need("]")
        policy = None
        if self.take("WITH"):
            self.need("POLICY")
            if self.take("("):
                opts = {}
                while not self.take(")"):
                    key = self.pop("name").lower()
                    self.need("=")
                    opts[key] = self.seconds() if key == "timeout" else self.pop("name").lower()
                    self.take(",")
                policy = ("timeout", opts.get("timeout", 0), opts.get("fallback", "steal"))
            else:
                policy = (self.pop("name").lower(),)
        return A.WindowSpec(name, stream, kind, width, step, report, tick, policy)

    def register(self) -> A.Register:
        self.need("REGISTER")
        op = self.pop("name").upper()
        out = self.iri()
        self.need("AS")
        self.windows = []
        sel = self.select()
        return A.Register(op if op in ("RSTREAM", "ISTREAM", "DSTREAM") else "RSTREAM", out, sel, self.windows)

    def predict(self) -> A.MLPredict:
        self.need("ML.PREDICT", "(", "MODEL")
        model = literal(self.pop("quoted"))
        self.need(",", "INPUT", "{")
        sel = self.select(datasets=False)
        self.need("}", ",", "OUTPUT")
        out = self.pop("var")[1:]
        self.need(")")
        return A.MLPredict(model, sel, out)

    def options(self) -> dict:
        out = {}
        while not self.take(")"):
            key = self.pop("name").lower()
            if key in out:
                raise ParseError(f"{key} is given twice")
            self.need("=")
            if self.kind() == "number":
                out[key] = float(self.pop("number"))
            elif self.kind() == "quoted":
                out[key] = literal(self.pop("quoted"))
            else:
                value = self.pop("name").lower()
                if self.take("("):
                    out[key] = (value, self.options())
                elif value.startswith("auto:"):
                    self.need("(")
                    out[key] = ("auto", self.options())
                else:
                    out[key] = value
            self.take(",")
        return out

    def rule(self) -> A.RuleDecl:
        self.need("RULE")
        name = self.iri()
        if self.take("("):
            while not self.take(")"):
                self.pop("var")
                self.take(",")
        prob = None
        if self.take("PROB"):
            prob = self.options() if self.take("(") else {}
        self.need(":-")
        op, windows = None, []
        if self.peek("RSTREAM", "ISTREAM", "DSTREAM"):
            op = self.pop("name").upper()
        while self.peek("FROM"):
            windows.append(self.window())
        self.need("CONSTRUCT", "{")
        head = self.triple_block()
        self.need("}")
        self.take("WHERE")
        body = self.group(rule=True)
        predict = None
        self.take(".")
        if self.peek("ML.PREDICT"):
            predict = self.predict()
            self.take(".")
        return A.RuleDecl(name, head, body, prob, op, windows, predict)

    def model(self) -> A.ModelDecl:
        self.need("MODEL")
        name = literal(self.pop("quoted"))
        self.need("{", "ARCH", "MLP", "{", "HIDDEN", "[")
        hidden = []
        while not self.take("]"):
            hidden.append(int(self.pop("number")))
            self.take(",")
        self.need("}", "OUTPUT")
        kind = self.pop("name").lower()
        labels = []
        if self.take("{"):
            while not self.take("}"):
                labels.append(self.term().value)
                self.take(",")
        self.need("}")
        return A.ModelDecl(name, hidden, kind, labels)

    def neural(self) -> A.NeuralDecl:
        self.need("NEURAL", "RELATION")
        predicate = self.iri()
        self.need("USING", "MODEL")
        model = literal(self.pop("quoted"))
        self.need("{", "INPUT")
        group = self.group()
        self.need("FEATURES", "{")
        features = []
        while not self.take("}"):
            features.append(self.pop("var")[1:])
            self.take(",")
        self.need("}")
        first = next(t for e in group.elements if isinstance(e, A.Triples) for t in e.triples)
        return A.NeuralDecl(predicate, model, group, features, first.s.name)

    def training(self) -> A.TrainDecl:
        self.need("TRAIN", "NEURAL", "RELATION")
        predicate = self.iri()
        self.need("{")
        o: dict = {"label": "label", "target": None, "loss": "cross_entropy", "optimizer": "adam", "rate": 0.01, "epochs": 50, "batch": 32, "save": None, "data": None}
        while not self.take("}"):
            key = self.pop("name").upper()
            if key in ("DATA", "QUERY"):
                if self.peek("{") and self.peek("SELECT", ahead=1):
                    self.need("{")
                    o["data"] = self.select(datasets=False)
                    self.need("}")
                else:
                    o["data"] = self.group()
            elif key == "LABEL":
                o["label"] = self.pop("var")[1:]
            elif key == "TARGET":
                self.need("{")
                o["target"] = self.triple_block()[0]
                self.need("}")
            elif key in ("LOSS", "OPTIMIZER"):
                o[key.lower()] = self.pop("name").lower()
            elif key == "LEARNING_RATE":
                o["rate"] = float(self.pop("number"))
            elif key in ("EPOCHS", "BATCH_SIZE"):
                o[{"EPOCHS": "epochs", "BATCH_SIZE": "batch"}[key]] = int(self.pop("number"))
            elif key == "SAVE_TO":
                o["save"] = literal(self.pop("quoted"))
            else:
                self.at -= 1
                self.fail("a training option")
            self.take(";", ",", ".")
        return A.TrainDecl(predicate, o["data"], o["label"], o["target"], o["loss"], o["optimizer"], o["rate"], o["epochs"], o["batch"], o["save"])

    def retrieve(self) -> A.Retrieve:
        self.need("RETRIEVE")
        mode, state = self.pop("name").upper(), self.pop("name").upper()
        self.need("STREAM")
        var = self.pop("var")[1:]
        self.need("FROM")
        stream = self.iri()
        self.need("WITH", "{")
        out = self.triple_block()
        self.need("}")
        return A.Retrieve(mode, state, var, stream, out)

    def request(self) -> A.Request:
        out = A.Request(self.prefixes)
        while self.take("PREFIX"):
            name = self.pop("name")
            if not name.endswith(":"):
                self.at -= 1
                self.fail("a prefix that ends in :")
            self.prefixes[name[:-1]] = unescape(self.pop("iri")[1:-1])
        while True:
            if self.peek("RETRIEVE"):
                out.retrieve = self.retrieve()
            elif self.peek("REGISTER"):
                out.register = self.register()
            elif self.peek("MODEL"):
                out.models.append(self.model())
            elif self.peek("NEURAL"):
                out.neural.append(self.neural())
            elif self.peek("TRAIN"):
                out.training.append(self.training())
            elif self.peek("RULE"):
                out.rules.append(self.rule())
            elif self.peek("ML.PREDICT"):
                out.predict = self.predict()
            else:
                break
            self.take(".")
        if self.peek("SELECT"):
            out.select = self.select()
        elif self.peek("INSERT", "DELETE"):
            out.update = self.update()
        if self.kind() != "end":
            self.fail("the end of the text")
        return out


def parse(text: str, prefixes: dict[str, str] | None = None) -> A.Request:
    return Parser(text, prefixes).request()
