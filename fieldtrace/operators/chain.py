"""A chain of rules over shared inputs (K65): every input is computed once, and the events are stored between groups of rules."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from fieldtrace.functions.storage import once


class Inputs:
    """Tables by name, each made from others when it is first asked for, and kept; so observations, spells, motion and stoppages are computed once, however many rules read them."""

    def __init__(self, makers: dict[str, Callable[[Inputs], DataFrame]]) -> None:
        self.makers, self.made = makers, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.made:
            self.made[name] = once(self.makers[name](self))
        return self.made[name]


@dataclass(frozen=True)
class Rule:
    """What becomes of the events; `after` names rules that must have run before."""

    name: str
    work: Callable[[DataFrame, Inputs], DataFrame]
    after: Sequence[str] = field(default=())


def run(events: DataFrame, groups: Sequence[Sequence[Rule]], inputs: Inputs) -> DataFrame:
    """The events after all rules, in order. Within a group the plans grow together; before it and after it the events, few rows a clip, are stored, so that no plan holds the whole chain, and rules that read them twice don't compute them twice.

    Rules that stand before one that they need are an error, and so are two rules of one name.
    """
    names = [r.name for g in groups for r in g]
    if len(names) != len(set(names)):
        raise ValueError("two rules have one name")
    for k, rule in enumerate(r for g in groups for r in g):
        if late := [a for a in rule.after if a not in names[:k]]:
            raise ValueError(f"{rule.name} needs {', '.join(late)} before it")
    events = once(events)
    for group in groups:
        for rule in group:
            events = rule.work(events, inputs)
        events = once(events)
    return events
