"""The log of tree mutations, against a replay that copies the state before each batch."""

from __future__ import annotations

import copy
import random

import pytest

from orrery.operators import mutations

LOG = "tree string, batch long, seq long, op string, unit string, arg string"


def replayed(rows):
    """state after each batch by (tree, batch), and the rule of each batch."""
    states, rules = {}, {}
    for tree in {r[0] for r in rows}:
        units, kinds = {}, set()
        for batch in sorted({r[1] for r in rows if r[0] == tree}):
            before, rule = copy.deepcopy((units, kinds)), None
            for _, _, _, op, unit, arg in sorted(r for r in rows if r[:2] == (tree, batch)):
                line, at = [], unit
                while at in units and at not in line:
                    line.append(at)
                    at = units[at][0]
                if op == "unit":
                    rule = "known" if unit in units else None
                    units.setdefault(unit, (None, None))
                elif op == "nonsense":
                    rule = "op"
                elif unit not in units or (op == "add" and arg not in units):
                    rule = "unknown"
                elif op == "add":
                    if arg in line:
                        rule = "cycle"
                    elif units[arg][0] not in (None, unit):
                        rule = "two_parents"
                    elif units[arg][0] is None:
                        units[arg] = (unit, sum(p == unit for p, _ in units.values()))
                elif op == "behaviour":
                    rule = "repeated_kind" if (unit, arg) in kinds else None
                    kinds.add((unit, arg))
                else:
                    kinds.discard((unit, arg))
                if rule:
                    break
            if rule:
                units, kinds = before
            rules[tree, batch], states[tree, batch] = rule, copy.deepcopy((units, kinds))
    return states, rules


@pytest.mark.parametrize("seed", range(2))
def test_batches_count_whole_or_not_at_all(spark, seed):
    rng = random.Random(seed)
    rows = []
    for tree in "pqr":
        rows += [(tree, 0, i, "unit", f"u{i}", None) for i in range(10)]
        for batch in range(1, 40):
            for seq in range(rng.randrange(1, 4)):
                op = rng.choices(["unit", "add", "behaviour", "remove", "nonsense"], [2, 6, 6, 3, 0.4])[0]
                unit = f"u{rng.randrange(14)}"
                arg = f"u{rng.randrange(14)}" if op == "add" else None if op == "unit" else rng.choice("xyz")
                rows.append((tree, batch, seq, op, unit, arg))
    shuffled = rng.sample(rows, len(rows))
    outcome = mutations.judged(spark.createDataFrame(shuffled, LOG).repartition(3)).cache()
    states, rules = replayed(rows)
    got = outcome.collect()
    assert sorted((r["tree"], r["batch"], r["seq"], r["op"], r["unit"], str(r["arg"])) for r in got) == sorted((*r[:5], str(r[5])) for r in rows)
    assert all(r["rule"] == rules[r["tree"], r["batch"]] for r in got)
    assert {"cycle", "two_parents", "repeated_kind", "unknown", "known", "op", None} == set(rules.values())
    for version in (3, 20, None):
        at = 39 if version is None else version
        units = {(r["tree"], r["unit"], r["parent"], r["ord"]) for r in mutations.units_at(outcome, version).collect()}
        assert units == {(t, u, p, o) for t in "pqr" for u, (p, o) in states[t, at][0].items()}
        kinds = {(r["tree"], r["unit"], r["kind"]) for r in mutations.behaviours_at(outcome, version).collect()}
        assert kinds == {(t, *x) for t in "pqr" for x in states[t, at][1]}


def test_an_empty_log(spark):
    outcome = mutations.judged(spark.createDataFrame([], LOG))
    assert outcome.count() == 0 and mutations.units_at(outcome).count() == 0 and mutations.behaviours_at(outcome, 3).count() == 0
