"""Guard expressions: text to a three-valued Column. NULL stands for an undefined outcome.

    guard   = term {("&&" | "||") term}         one precedence, from the left
    term    = sum {("<" | "<=" | ">" | ">=" | "==" | "!=") sum}
    sum     = number | "string" | true | false | variable | "(" guard ")"
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

_ESCAPES = (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&#34;", '"'), ("&quot;", '"'))
_TOKEN = re.compile(r'\s*(?:(?P<op><=|>=|==|!=|&&|\|\||[<>()])|(?P<num>-?\d+(?:\.\d+)?)|"(?P<str>[^"]*)"|(?P<name>[A-Za-z_][A-Za-z0-9_:$.]*))')


class Guard:
    """A parsed guard. ``tree`` is nested tuples: ("num", x), ("str", s), ("bool", b), ("var", name) or (operator, left, right)."""

    def __init__(self, text: str = "true"):
        for a, b in _ESCAPES:
            text = text.replace(a, b)
        self.text = text.strip()
        self._tokens, at = [], 0
        while at < len(self.text):
            m = _TOKEN.match(self.text, at)
            if not m or m.end() == at:
                raise ValueError(f"can't read the guard at {self.text[at:]!r}")
            at = m.end()
            kind = m.lastgroup
            self._tokens.append((kind, m[kind]))
        self._at = 0
        self.tree = self._chain()
        if self._at != len(self._tokens):
            raise ValueError(f"can't read the guard after {self._tokens[: self._at]}")

    def _next(self, *ops: str) -> str | None:
        if self._at < len(self._tokens) and self._tokens[self._at][0] == "op" and self._tokens[self._at][1] in ops:
            self._at += 1
            return self._tokens[self._at - 1][1]
        return None

    def _chain(self):
        left = self._term()
        while op := self._next("&&", "||"):
            left = (op, left, self._term())
        return left

    def _term(self):
        left = self._value()
        while op := self._next("<", "<=", ">", ">=", "==", "!="):
            left = (op, left, self._value())
        return left

    def _value(self):
        if self._next("("):
            inner = self._chain()
            if not self._next(")"):
                raise ValueError("a parenthesis isn't closed")
            return inner
        if self._at >= len(self._tokens):
            raise ValueError("the guard breaks off")
        kind, x = self._tokens[self._at]
        self._at += 1
        if kind == "num":
            return ("num", float(x))
        if kind == "str":
            return ("str", x)
        if kind == "name":
            return ("bool", x == "true") if x in ("true", "false") else ("var", x)
        raise ValueError(f"{x!r} isn't a value")

    def variables(self) -> set[str]:
        def walk(t):
            return {t[1]} if t[0] == "var" else set() if t[0] in ("num", "str", "bool") else walk(t[1]) | walk(t[2])

        return walk(self.tree)

    def constant(self):
        """The outcome if no variable bears on it, else None."""
        return self.evaluate({}) if not self.variables() else None

    def trivial(self) -> bool:
        return self.constant() is True

    def evaluate(self, state: Mapping):
        """True, False or None on a mapping of values."""
        def value(t):
            if t[0] == "var":
                return state.get(t[1])
            if t[0] in ("num", "str", "bool"):
                return t[1]
            op, a, b = t[0], value(t[1]), value(t[2])
            if op in ("&&", "||"):
                a, b = [x if isinstance(x, bool) else None for x in (a, b)]
                if op == "&&":
                    return False if a is False or b is False else None if a is None or b is None else True
                return True if a is True or b is True else None if a is None or b is None else False
            if a is None or b is None or kind(a) != kind(b):
                return None
            if kind(a) == "bool" and op not in ("==", "!="):
                return None
            return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "==": a == b, "!=": a != b}[op]

        def kind(x):
            return "bool" if isinstance(x, bool) else "num" if isinstance(x, (int, float)) else "str"

        out = value(self.tree)
        return out if isinstance(out, bool) else None

    def column(self, of: Callable[[str], tuple[Column, str]]) -> Column:
        """The outcome as a boolean Column. of(name) gives a variable's Column and kind: num, str or bool; unknown names raise KeyError and count as null."""
        null = F.lit(None).cast("boolean")

        def value(t):
            if t[0] == "var":
                try:
                    return of(t[1])
                except KeyError:
                    return None, ""
            if t[0] in ("num", "str", "bool"):
                return F.lit(t[1]), t[0]
            (a, ka), (b, kb), op = value(t[1]), value(t[2]), t[0]
            if op in ("&&", "||"):
                a, b = a if ka == "bool" else null, b if kb == "bool" else null
                return (a & b if op == "&&" else a | b), "bool"
            if ka != kb or a is None or (ka == "bool" and op not in ("==", "!=")):
                return null, "bool"
            made = {"<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b, "==": lambda: a == b, "!=": lambda: a != b}[op]()
            return made, "bool"

        out, k = value(self.tree)
        return out if k == "bool" and out is not None else null

    def __eq__(self, other):
        return isinstance(other, Guard) and self.text == other.text

    def __hash__(self):
        return hash(self.text)

    def __repr__(self):
        return self.text


class GuardSet:
    """Guards taken together: a Merge is met if all are, a Join if any is. Members may be guards, merges and joins."""

    op = ""

    def __init__(self, *members):
        flat = []
        for m in members:
            flat += m.members if type(m) is type(self) else [m]
        self.members = tuple(sorted(set(flat), key=str))

    @property
    def text(self) -> str:
        return f" {self.op} ".join(f"({m})" for m in self.members) if len(self.members) != 1 else str(self.members[0])

    def guard(self) -> Guard:
        return Guard(self.text or "true")

    def check(self, state: Mapping):
        """True, False or None (undefined), as a single guard gives."""
        return self.guard().evaluate(state)

    def required(self) -> set[str]:
        """The names that bear on it."""
        return self.guard().variables()

    def enabling(self, states) -> list:
        """The states in which it is met."""
        return [s for s in states if self.check(s) is True]

    def contains(self, guard) -> bool:
        return any(m == guard or (isinstance(m, GuardSet) and m.contains(guard)) for m in self.members)

    def consists_of(self) -> set[Guard]:
        """The single guards in it."""
        return set().union(*({m} if isinstance(m, Guard) else m.consists_of() for m in self.members), set())

    def __eq__(self, other):
        return type(self) is type(other) and self.members == other.members

    def __hash__(self):
        return hash((self.op, self.members))

    def __repr__(self):
        return self.text


class Merge(GuardSet):
    op = "&&"


class Join(GuardSet):
    op = "||"


def column_kinds(df, prefix: str = "") -> Callable[[str], tuple[Column, str]]:
    """For Guard.column: variables are the columns of a DataFrame, prefixed."""
    kinds = dict(df.dtypes)

    def of(name: str) -> tuple[Column, str]:
        t = kinds[prefix + name]
        col = F.col(f"`{prefix + name}`")
        return (col, "str") if t == "string" else (col, "bool") if t == "boolean" else (col.cast("double"), "num")

    return of
