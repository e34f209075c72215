"""Datalog-style rules to a fixpoint, and plan terms that pick a closure strategy."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.reach import closure, travel, unique
from skein.plans.lineage import cut


@dataclass(frozen=True)
class Lit:
    """A constant in place of a variable."""

    value: object


Atom = tuple[str, tuple[str | Lit, ...]]


@dataclass(frozen=True)
class Rule:
    """head :- body, negated; each atom is (relation, variables and literals). Negated relations must be of an earlier stratum."""

    head: Atom
    body: tuple[Atom, ...]
    without: tuple[Atom, ...] = ()


def _variables(terms) -> list[str]:
    return list(dict.fromkeys(t for t in terms if not isinstance(t, Lit)))


def _rows(facts: DataFrame, terms) -> DataFrame:
    """The distinct bindings of an atom's variables: literals and repeated variables are filters."""
    facts = facts.toDF(*[f"_{i}" for i in range(len(terms))])
    at: dict[str, int] = {}
    for i, t in enumerate(terms):
        if isinstance(t, Lit):
            facts = facts.where(F.col(f"_{i}") == F.lit(t.value))
        elif t in at:
            facts = facts.where(F.col(f"_{i}") == F.col(f"_{at[t]}"))
        else:
            at[t] = i
    return facts.select(*[F.col(f"_{i}").alias(v) for v, i in at.items()])


def _derive(rule: Rule, known: dict[str, DataFrame], fresh: int | None = None, delta: DataFrame | None = None) -> DataFrame:
    """What a rule gives, with the atom at place `fresh` read from the last round's facts; atoms that share most variables with those before come first."""
    todo = list(range(len(rule.body)))
    here = fresh if fresh is not None else 0
    out, bound = None, set()
    while todo:
        name, terms = rule.body[here]
        atom = _rows(delta if here == fresh else known[name], terms)
        shared = sorted(bound & {*_variables(terms)})
        if out is not None and not shared:
            raise ValueError("a body's atoms must share variables")
        out = atom if out is None else out.join(atom, shared)
        bound |= {*_variables(terms)}
        todo.remove(here)
        if todo:
            here = max(todo, key=lambda i: (len(bound & {*_variables(rule.body[i][1])}), -i))
    for name, terms in rule.without:
        if name in known:
            out = out.join(_rows(known[name], terms), _variables(terms), "anti")
    return out.select(*[(F.lit(t.value) if isinstance(t, Lit) else F.col(t)).alias(f"c{i}") for i, t in enumerate(rule.head[1])]).distinct()


def _strata(rules: list[Rule]) -> list[list[Rule]]:
    level = {r.head[0]: 0 for r in rules}
    for _ in range(len(level) + 1):
        moved = False
        for r in rules:
            need = max([level.get(n, 0) for n, _ in r.body] + [level[n] + 1 for n, _ in r.without if n in level] + [0])
            if need > level[r.head[0]]:
                level[r.head[0]], moved = need, True
        if not moved:
            return [[r for r in rules if level[r.head[0]] == k] for k in sorted(set(level.values()))]
    raise ValueError("a relation depends on its own negation")


def _walk(stratum: list[Rule], known: dict[str, DataFrame]) -> DataFrame | None:
    """The facts of a stratum that only follows edges, p(x, y) :- e(x, y) and p(x, z) :- p(x, y), e(y, z) of a relation not given, else None."""
    if len(stratum) != 2 or any(r.without or any(isinstance(t, Lit) for _, ts in (r.head, *r.body) for t in ts) for r in stratum):
        return None
    base, more = sorted(stratum, key=lambda r: len(r.body))
    if len(base.body) != 1 or len(more.body) != 2 or base.head[0] != more.head[0] or base.head[0] in known:
        return None
    (e, ends), p = base.body[0], base.head[0]
    atoms = dict(more.body)
    if e not in known or {*atoms} != {p, e} or len(ends) != 2 or len({*ends}) != 2 or base.head[1] != ends:
        return None
    if len(more.head[1]) != 2 or len(atoms[p]) != 2 or len(atoms[e]) != 2:
        return None
    (x, y), (y2, z) = atoms[p], atoms[e]
    if y != y2 or len({x, y, z}) != 3 or more.head[1] != (x, z):
        return None
    edges = known[e].toDF("src", "dst").where("src is not null and dst is not null")
    moved, loose = travel(edges.select(F.col("src").alias("node"), F.col("src").alias("root")).distinct(), edges, counted=False)
    every = moved.select(F.col("root").alias("c0"), F.col("node").alias("c1")).union(unique(loose.select(F.col("root").alias("c0"), F.col("node").alias("c1"))))
    return every


def saturate(facts: dict[str, DataFrame], rules: list[Rule], cap: int = 10_000) -> dict[str, DataFrame]:
    """All facts that follow, by relation. Facts of a round join at its end; more than `cap` rounds raise. Columns are c0, c1, ...

    Semi-naive: after a stratum's first round, a rule is joined once for each of its atoms of the stratum, which is read from
    the facts that the last round brought, so old facts aren't derived again. A negated relation that isn't given is empty.
    """
    for r in rules:
        bound = {v for _, vs in r.body for v in _variables(vs)}
        if unsafe := ({*_variables(r.head[1])} | {v for _, vs in r.without for v in _variables(vs)}) - bound:
            raise ValueError(f"unbound in the body: {sorted(unsafe)}")
        if any(not _variables(vs) for _, vs in r.without):
            raise ValueError("a negated atom must hold a variable")
    known = dict(facts)
    for stratum in _strata(rules):
        heads = {r.head[0] for r in stratum}
        walk = _walk(stratum, known)
        if walk is not None:
            known[stratum[0].head[0]] = walk
            continue
        delta: dict[str, DataFrame] | None = None
        for round_ in range(cap + 1):
            found: dict[str, DataFrame] = {}
            for r in stratum:
                if delta is None:
                    new = [_derive(r, known)] if all(n in known for n, _ in r.body) else []
                else:
                    new = [_derive(r, known, i, delta[n]) for i, (n, _) in enumerate(r.body) if n in heads and n in delta and all(m in known for m, _ in r.body)]
                for rows in new:
                    found[r.head[0]] = found[r.head[0]].union(rows) if r.head[0] in found else rows
            fresh = {}
            for name, rows in found.items():
                rows = rows.distinct()
                rows = cut(rows.join(known[name], rows.columns, "anti") if name in known else rows)
                if not rows.isEmpty():
                    fresh[name] = rows
            for name, rows in fresh.items():
                known[name] = cut(known[name].union(rows)) if name in known and round_ % 3 == 2 else known[name].union(rows) if name in known else rows
            if not fresh:
                break
            if round_ == cap:
                raise RuntimeError(f"no fixpoint after {cap} rounds")
            delta = fresh
        # Heads that nothing was found for are relations without facts.
        for r in stratum:
            if r.head[0] not in known and all(n in known for n, _ in r.body):
                known[r.head[0]] = cut(_derive(r, known))
    return known


def plan_reach(edges: DataFrame, seeds: DataFrame, n_nodes: int, n_seeds: int) -> tuple[str, DataFrame]:
    """The strategy and its rows: many seeds share one condensed closure of pairs, few run one closure from each."""
    if n_seeds * 4 >= n_nodes:
        every = closure(edges, edges.select(F.col("src").alias("root")).distinct())
        return "shared", every.join(seeds, "root", "semi").union(seeds.join(edges.select(F.col("src").alias("root")).distinct(), "root", "anti").select("root", F.col("root"), F.lit(0)))
    return "per-seed", closure(edges, seeds)
