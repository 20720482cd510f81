"""Conditions over states, compiled to Spark columns (no Python at run time).

    condition = quantified | implied
    quantified = (``\\A`` | ``\\E``) name ``\\in`` sum ``:`` condition
    implied = disjunction [``=>`` condition]
    disjunction = conjunction {``\\/`` conjunction};  conjunction = negation {``/\\`` negation}
    negation = (``~`` | ``\\lnot``) negation | quantified | comparison
    comparison = sum [(``=`` | ``#`` | ``/=`` | ``<`` | ``<=`` | ``=<`` | ``>`` | ``>=`` | ``\\in`` | ``\\notin``) sum]
    sum = product {(``+`` | ``-``) product};  product = factor {(``*`` | ``%``) factor}
    factor = number | "text" | TRUE | FALSE | name | factor.name | factor[sum] | -factor | (condition)
           | {sum, ...} | <<sum, ...>> | {sum..sum} | Len(sum) | Cardinality(sum) | DOMAIN factor

A name is a variable of the state or of an enclosing quantifier.  Nulls follow SQL: what is
compared with an unknown value is unknown, and an unknown condition neither holds nor is violated.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r'\s*(?:(\d+(?:\.\d+)?(?!\w))|"([^"]*)"|(\\[A-Za-z]+|/\\|\\/|=>|<<|>>|<=|=<|>=|/=|\.\.|[-~=#<>+*%(){}\[\],:.])|([A-Za-z_]\w*))')


class ConditionError(ValueError):
    """A condition that does not follow the grammar."""


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ConditionError(f"cannot read {text[at:at + 20]!r}")
        kind = ("number", "text", "mark", "name")[m.lastindex - 1]
        out.append((kind, m[m.lastindex]))
        at = m.end()
    return [*out, ("end", "")]


class _Parser:
    """Recursive descent; every rule returns a Column."""

    COMPARED: dict[str, Callable] = {
        "=": lambda a, b: a == b, "#": lambda a, b: a != b, "/=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "=<": lambda a, b: a <= b,
        ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, r"\in": lambda a, b: F.array_contains(b, a), r"\notin": lambda a, b: ~F.array_contains(b, a),
    }

    def __init__(self, text: str, variables: dict[str, Column]):
        self.tokens, self.at, self.scope, self.used = _tokens(text), 0, dict(variables), set()

    def here(self) -> str:
        kind, value = self.tokens[self.at]
        return value if kind in ("mark", "name") else ""

    def take(self, *values: str) -> str:
        if self.here() not in values or not self.here():
            raise ConditionError(f"expected {' or '.join(values)}, not {self.tokens[self.at][1]!r}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def name(self) -> str:
        kind, value = self.tokens[self.at]
        if kind != "name":
            raise ConditionError(f"expected a name, not {value!r}")
        self.at += 1
        return value

    def whole(self) -> Column:
        found = self.condition()
        if self.tokens[self.at][0] != "end":
            raise ConditionError(f"cannot go on at {self.tokens[self.at][1]!r}")
        return found

    def condition(self) -> Column:
        left = self.disjunction()
        if self.here() == "=>":
            self.take("=>")
            left = ~left | self.condition()
        return left

    def quantified(self) -> Column:
        every = self.take(r"\A", r"\E") == r"\A"
        name = self.name()
        self.take(r"\in")
        over = self.sum()
        self.take(":")
        before, start = self.scope.get(name), self.at

        def inner(x: Column) -> Column:
            self.at, self.scope[name] = start, x
            return self.condition()

        found = (F.forall if every else F.exists)(over, inner)
        if before is None:
            del self.scope[name]
        else:
            self.scope[name] = before
        return found

    def disjunction(self) -> Column:
        left = self.conjunction()
        while self.here() == r"\/":
            self.take(r"\/")
            left = left | self.conjunction()
        return left

    def conjunction(self) -> Column:
        left = self.negation()
        while self.here() == "/\\":
            self.take("/\\")
            left = left & self.negation()
        return left

    def negation(self) -> Column:
        if self.here() in ("~", r"\lnot"):
            self.at += 1
            return ~self.negation()
        return self.quantified() if self.here() in (r"\A", r"\E") else self.comparison()

    def comparison(self) -> Column:
        left = self.sum()
        if self.here() in self.COMPARED:
            how = self.COMPARED[self.take(self.here())]
            left = how(left, self.sum())
        return left

    def sum(self) -> Column:
        left = self.product()
        while self.here() in ("+", "-"):
            left = left + self.product() if self.take("+", "-") == "+" else left - self.product()
        return left

    def product(self) -> Column:
        left = self.factor()
        while self.here() in ("*", "%"):
            left = left * self.factor() if self.take("*", "%") == "*" else left % self.factor()
        return left

    def items(self, close: str) -> Column:
        found = []
        if self.here() != close:
            found.append(self.sum())
            if self.here() == ".." and close == "}":
                self.take("..")
                last = self.sum()
                self.take(close)
                # an interval that ends before it begins is empty
                return F.when(found[0] <= last, F.sequence(found[0], last)).when(found[0] > last, F.array().cast("array<int>"))
            while self.here() == ",":
                self.take(",")
                found.append(self.sum())
        self.take(close)
        return F.array(*found)

    def factor(self) -> Column:
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "number":
            found = F.lit(float(value) if "." in value else int(value))
        elif kind == "text":
            found = F.lit(value)
        elif value == "-" and kind == "mark":
            found = -self.factor()
        elif value == "(" and kind == "mark":
            found = self.condition()
            self.take(")")
        elif value == "{" and kind == "mark":
            found = self.items("}")
        elif value == "<<" and kind == "mark":
            found = self.items(">>")
        elif kind == "name" and value in ("TRUE", "FALSE"):
            found = F.lit(value == "TRUE")
        elif kind == "name" and value in ("Len", "Cardinality"):
            self.take("(")
            inner = self.sum()
            # a set holds equal members once
            found = F.size(inner if value == "Len" else F.array_distinct(inner))
            self.take(")")
        elif kind == "name" and value == "DOMAIN":
            found = F.map_keys(self.factor())
        elif kind == "name":
            if value not in self.scope:
                raise ConditionError(f"no variable {value!r}")
            self.used.add(value)
            found = self.scope[value]
        else:
            raise ConditionError(f"cannot begin with {value!r}")
        while self.here() in (".", "["):
            if self.take(".", "[") == ".":
                found = found[self.name()]
            else:
                place = self.sum()
                self.take("]")
                found = found[place]
        return found


def compile_condition(text: str, variables: dict[str, Column]) -> tuple[Column, list[str]]:
    """(column, names of the variables it reads) of a condition; one that does not follow the grammar raises ConditionError."""
    parser = _Parser(text, variables)
    found = parser.whole()
    return found, sorted(parser.used & set(variables))


def check_conditions(states: DataFrame, conditions: dict[str, str], variables: list[str]) -> DataFrame:
    """``states`` with one boolean column per named condition: whether it holds in the state, null where that is unknown."""
    scope = {v: F.col(f"`{v}`") for v in variables}
    return states.select("*", *[compile_condition(text, scope)[0].alias(name) for name, text in conditions.items()])
