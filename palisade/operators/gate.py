"""Which rules can fire in a text: the one step that touches every byte.

Spark's own string predicates cost about 5 MB/s per core here (25 rules, 37
patterns: each ``rlike`` decodes the text and walks it once), so the whole scan
would be bound by texts in which nothing is found. The gate therefore runs as an
Arrow UDF: RE2, which Arrow brings along, tests all patterns in a single
automaton at some 300 MB/s per core, and only texts that pass it are tested rule
by rule. Batches stay columnar and no Python object is made per row.

The gate only decides what is looked at. Positions, tokens and all filtering are
native expressions on the (few) texts that pass, so a difference between the
regex engines can cost time but not findings: RE2 folds more letters than Java
does under ``(?i)``, never fewer. Lookarounds, which RE2 lacks, are left out of the
test, so it passes more texts, never fewer. What RE2 still cannot compile (references
back to a group) is tested by ``rlike`` instead.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.catalogue import Pattern, Rule


def _compiles(regex: str) -> bool:
    try:
        pc.match_substring_regex(pa.array([""]), regex)
    except pa.ArrowInvalid:
        return False
    return True


def _scoped(pattern: Pattern) -> str:
    regex = pattern.gate
    return f"(?i:{regex[4:]})" if regex.startswith("(?i)") else f"(?:{regex})"


def _union(patterns: Sequence[Pattern]) -> str:
    return "|".join(dict.fromkeys(_scoped(p) for p in patterns))


def _all_patterns(rule: Rule) -> tuple[Pattern, ...]:
    return (*rule.patterns, *rule.python_patterns)


def _prefilters(regexes: list[str]) -> list[str]:
    """Unions that tell texts without any match; halved until the engine takes each of them."""
    overall = "|".join(f"(?:{regex})" for regex in regexes)
    if len(regexes) == 1 or _compiles(overall):
        return [overall]
    half = len(regexes) // 2
    return _prefilters(regexes[:half]) + _prefilters(regexes[half:])


def _arrow_gate(tests: list[tuple[int, str, str | None]], prefilters: list[str]):
    """UDF over texts returning the ascending positions of the rules that match."""

    @F.arrow_udf("array<int>")
    def fired(texts: pa.Array) -> pa.Array:
        n = len(texts)
        passed = np.zeros(n, dtype=bool)
        for union in prefilters:
            found = pc.fill_null(pc.match_substring_regex(texts, union), False)
            passed |= found.to_numpy(zero_copy_only=False)
        candidates = np.flatnonzero(passed)
        chosen = texts.take(pa.array(candidates, pa.int64()))
        matrix = np.zeros((len(candidates), len(tests)), dtype=bool)
        for column, (_, regex, context) in enumerate(tests):
            verdict = pc.match_substring_regex(chosen, regex)
            if context is not None:
                verdict = pc.and_(verdict, pc.match_substring_regex(chosen, context))
            matrix[:, column] = pc.fill_null(verdict, False).to_numpy(zero_copy_only=False)
        text_at, test_at = np.nonzero(matrix)
        counts = np.zeros(n + 1, dtype=np.int32)
        np.add.at(counts, candidates[text_at] + 1, 1)
        rule_at = np.array([position for position, _, _ in tests], dtype=np.int32)
        return pa.ListArray.from_arrays(
            pa.array(np.cumsum(counts, dtype=np.int32)), pa.array(rule_at[test_at], pa.int32())
        )

    return fired


def fired_rules(rules: Sequence[Rule], content: Column) -> Column:
    """``array<int>``: positions in ``rules`` whose patterns occur in ``content``."""
    tests, native = [], []
    for position, rule in enumerate(rules):
        regex = _union(_all_patterns(rule))
        context = _scoped(rule.context) if rule.context else None
        if _compiles(regex) and (context is None or _compiles(context)):
            tests.append((position, regex, context))
        else:
            native.append(position)
    fired = (
        _arrow_gate(tests, _prefilters([regex for _, regex, _ in tests]))(content)
        if tests
        else F.array().cast("array<int>")
    )
    if not native:
        return fired

    def matches(rule: Rule) -> Column:
        verdict = F.lit(False)
        for pattern in _all_patterns(rule):
            verdict = verdict | F.rlike(content, F.lit(pattern.java))
        if rule.context:
            verdict = verdict & F.rlike(content, F.lit(rule.context.java))
        return verdict

    by_rlike = F.array_compact(F.array(*[F.when(matches(rules[i]), F.lit(i)) for i in native]))
    return F.array_sort(F.concat(fired, by_rlike))
