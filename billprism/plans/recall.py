"""Rules on documents of one form: what an expression came to is kept with the texts that it read, and told again where they are the same.

Trees of a form differ in their texts alone, and evaluation follows from these, so the places that it reads, one after the other, are a path: the first place is always
the same, the next one follows from the text found there. What is read anew most times (sums, amounts) is evaluated each time and not kept.
"""

from __future__ import annotations

import re

from ..sources.shred import Node, location
from .xpath import Focus, XPathError, keep

#: A unit is given up after so many texts that were new, if they were more than the others; paths that a unit, and all units of a task, keep.
TRIED, PATHS_MOST, KEPT_MOST = 16, 256, 40_000
_VARIABLE = re.compile(r"\$\s*([\w.:\-·]+)")


class Unit:
    """Something to evaluate on each document of a form. ``state`` is what it comes to, or [place, {text: state}]."""

    __slots__ = ("act", "born", "new", "off", "state")

    def __init__(self, act, born: int):
        self.act, self.born, self.new, self.off, self.state = act, born, 0, False, None


class Plan:
    """What a runner knows of a form. Units that need the rule set's variables hang on these variables' values, the others on the form."""

    def __init__(self, runner, doc: Node, variables: dict):
        self.runner, self.doc, self.docs, self.given = runner, doc, 0, variables
        self.at = doc.memo["places"]
        self.lets = Unit(self._lets, 0)
        self.free = Program(self, Focus(doc, 1, 1, dict(variables), {}, doc), runner.free)

    def _lets(self) -> Program:
        return Program(self, self.runner.base(self.doc, self.given), self.runner.bound)

    def tell(self, unit: Unit, texts: list[str]):
        state = unit.state
        while type(state) is list:
            state = state[1].get(texts[state[0]])
        return self.learn(unit, texts) if state is None else state

    def learn(self, unit: Unit, texts: list[str]):
        if unit.off:
            return unit.act()
        kind, reads = type(self.doc), []
        kind.log = reads
        try:
            found = unit.act()
        finally:
            kind.log = None
        unit.new += 1
        kept = self.runner.kept
        if unit.new > PATHS_MOST or kept[0] >= KEPT_MOST or (unit.new > TRIED and 2 * unit.new > self.docs - unit.born):
            kept[0] -= unit.new - 1
            unit.off, unit.state = True, None
            return found
        kept[0] += 1
        path = [unit.state]
        keep(path, dict.fromkeys(self.at[id(n)] for n in reads), texts.__getitem__, found)
        unit.state = path[0]
        return found

    def run(self, texts: list[str]) -> list[tuple]:
        self.docs += 1
        program = self.tell(self.lets, texts)
        out = [*self.free.run(texts), *program.run(texts)]
        if len(out) > 1:
            out.sort(key=lambda x: x[:3])
        return [(*x[:7], x[7].line, x[8]) for x in out]


class Program:
    """Patterns on a form under given variables: units that choose the nodes of contexts, and units of what is asserted of them."""

    def __init__(self, plan: Plan, base: Focus, groups: dict):
        self.plan, self.base, self.units, self.chosen = plan, base, {}, {}
        self.open = [Unit(lambda c=contexts, ps=ps: self._choose(c, ps), plan.docs) for contexts, ps in groups.items()]

    def _choose(self, contexts: tuple[str, ...], patterns: list[int]) -> tuple[Unit, ...]:
        """The units of what these patterns, which share their contexts, assert; a node belongs to the first context that selects it."""
        runner, owner = self.plan.runner, {}
        for k, context in enumerate(contexts):
            try:
                found = [n for b in runner.branches[context] for n in runner.eval(b, self.base)]
            except XPathError:
                found = []
            for n in found:
                if isinstance(n, Node):
                    owner.setdefault(n.pre, (n, k))
        key = (contexts, tuple((pre, k) for pre, (_, k) in sorted(owner.items())))
        if key not in self.chosen:
            self.chosen[key] = tuple(u for p in patterns for pre in sorted(owner) for u in self._units(p, *owner[pre]))
        return self.chosen[key]

    def _units(self, p: int, n: Node, k: int) -> list[Unit]:
        if (p, n.pre, k) not in self.units:
            rule = self.plan.runner.rules.patterns[p][k]
            parts = [rule.asserts] if rule.lets else [[a] for a in rule.asserts]
            self.units[p, n.pre, k] = [Unit(lambda part=part: self._assert(p, n, rule, part), self.plan.docs) for part in parts]
        return self.units[p, n.pre, k]

    def _assert(self, p: int, n: Node, rule, asserts: list) -> tuple:
        fired = self.plan.runner.fired(n, rule, asserts, self.base)
        return tuple((p, n.pre, a.place, a.id, a.flag, message, location(n) or "/", n, error) for a, message, error in fired)

    def run(self, texts: list[str]) -> list[tuple]:
        out, tell, settled = [], self.plan.tell, False
        for choice in self.open:
            units = tell(choice, texts)
            settled = settled or choice.state == ()
            for unit in units:
                state = unit.state
                while type(state) is list:
                    state = state[1].get(texts[state[0]])
                if state is None:
                    state = tell(unit, texts)
                if state:
                    out += state
        if settled:
            self.open = [u for u in self.open if u.state != ()]
        return out


def names_used(texts: list[str]) -> set[str]:
    return {name for t in texts for name in _VARIABLE.findall(t)}
