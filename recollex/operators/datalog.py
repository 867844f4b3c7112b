"""Datalog: positive rules over string tuples, to a fixpoint, one join plan a rule."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollex.storage import Scratch


@dataclass(frozen=True)
class Atom:
    """A predicate with terms; a term that starts with a capital letter or _ is a variable."""

    name: str
    terms: tuple[str, ...]


@dataclass(frozen=True)
class Rule:
    head: Atom
    body: tuple[Atom, ...]


_ATOM = re.compile(r"(\w+)\(([^()]*)\)")


def parse_rule(text: str) -> Rule:
    """``head(X, Z) :- a(X, Y), b(Y, Z).``"""
    atoms = [Atom(name, tuple(t.strip().strip('"') for t in terms.split(","))) for name, terms in _ATOM.findall(text)]
    if not atoms or ":-" not in text:
        raise ValueError(f"not a rule: {text}")
    rule = Rule(atoms[0], tuple(atoms[1:]))
    bound = {t for a in rule.body for t in a.terms}
    if loose := [t for t in rule.head.terms if is_variable(t) and t not in bound]:
        raise ValueError(f"head variables without a body: {loose}")
    return rule


def is_variable(term: str) -> bool:
    return term[:1].isupper() or term[:1] == "_"


class Program:
    """Facts by predicate (columns c0, c1, ...) and rules."""

    def __init__(self, spark: SparkSession):
        self.spark, self.facts, self.rules = spark, {}, []
        self.scratch = Scratch(spark, "datalog")

    def add_facts(self, name: str, rows: DataFrame) -> None:
        named = rows.toDF(*[f"c{i}" for i in range(len(rows.columns))])
        named = named.select(*[F.col(c).cast("string") for c in named.columns]).dropna().distinct()
        self.facts[name] = named if name not in self.facts else self.facts[name].unionByName(named).distinct()

    def add_rule(self, text: str) -> None:
        self.rules.append(parse_rule(text))

    def _join(self, rule: Rule, tables: list[DataFrame | None]) -> DataFrame | None:
        """Bindings of the body, an equi-join on shared variables; then the head."""
        out = None
        for atom, table in zip(rule.body, tables, strict=True):
            if table is None:
                return None
            rows, names = table, {}
            for i, term in enumerate(atom.terms):
                if not is_variable(term):
                    rows = rows.filter(F.col(f"c{i}") == term)
                elif term == "_":
                    continue
                elif term in names:
                    rows = rows.filter(F.col(f"c{i}") == F.col(names[term]))
                else:
                    names[term] = f"c{i}"
            rows = rows.select(*[F.col(c).alias(f"v_{v}") for v, c in names.items()])
            if out is None:
                out = rows
            elif shared := [c for c in rows.columns if c in out.columns]:
                out = out.join(rows, shared)
            else:
                out = out.crossJoin(rows)  # the rule itself asks for a product
        return out.select(*[(F.col(f"v_{t}") if is_variable(t) else F.lit(t)).alias(f"c{i}") for i, t in enumerate(rule.head.terms)]).distinct()

    def run(self, most_rounds: int = 200) -> None:
        """Semi-naive: in each round one body atom reads only what the last round brought."""
        delta = dict(self.facts)
        for number in range(most_rounds):
            fresh: dict[str, DataFrame] = {}
            for rule in self.rules:
                for place, atom in enumerate(rule.body):
                    if atom.name not in delta:
                        continue
                    found = self._join(rule, [delta[a.name] if i == place else self.facts.get(a.name) for i, a in enumerate(rule.body)])
                    if found is not None:
                        fresh[rule.head.name] = found if rule.head.name not in fresh else fresh[rule.head.name].unionByName(found)
            delta = {}
            for name, rows in fresh.items():
                new = rows.distinct()
                if name in self.facts:
                    new = new.join(self.facts[name], new.columns, "left_anti")
                new = self.scratch.write(new, f"{name}-{number}")
                if not new.isEmpty():
                    delta[name] = new
            if not delta:
                return
            for name, rows in delta.items():
                known = self.facts.get(name)
                self.facts[name] = rows if known is None else known.unionByName(rows)
        raise RuntimeError("no fixpoint within the rounds allowed")

    def query(self, name: str) -> DataFrame:
        return self.facts[name]

    def aggregate(self, name: str, group: int, value: int, op: str) -> DataFrame:
        """(key, value): count, sum, min or max of a column read as numbers (others count as 0)."""
        number = F.coalesce(F.expr(f"try_cast(c{value} as double)"), F.lit(0.0))
        agg = {"count": F.count(F.lit(1)).cast("double"), "sum": F.sum(number), "min": F.min(number), "max": F.max(number)}[op]
        return self.facts[name].distinct().groupBy(F.col(f"c{group}").alias("key")).agg(agg.alias("value")).orderBy("key")
