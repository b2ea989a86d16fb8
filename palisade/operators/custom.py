"""Rules written in Python, as an Arrow table function joined laterally to the texts.

The path gates are columns, as for declared rules, and texts that no function may see never
leave the JVM. The rest go through the table function in Arrow batches, once for all functions;
the text itself is dropped behind it and only its rows go on. (Spark joins no function over whole
Arrow arrays laterally, so ``eval`` is called text by text; batches travel as Arrow all the same.)
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.catalogue import FunctionRule
from palisade.operators.detect import path_gate

HIT_DDL = "rule_ord int, match_ord int, line int, column int, snippet string"


def matching(rules: Sequence[FunctionRule]):
    """Table function over (content, path, places of the allowed rules)."""
    functions = [r.match for r in rules]

    class Matching:
        def eval(self, content: str | None, path: str, allowed: list[int]) -> Iterator[tuple]:
            if content is None:
                return
            for place in allowed:
                for nth, (line, column, snippet) in enumerate(functions[place](content, path)):
                    yield place, nth, line, column, snippet

    return F.udtf(Matching, returnType=HIT_DDL, useArrow=True)


def function_hits(
    texts: DataFrame,
    rules: Sequence[FunctionRule],
    content: str,
    path: str,
    keep: Sequence[str],
    first_ord: int = 0,
) -> DataFrame:
    """``keep`` columns plus one row per hit, with the columns of ``detect``.

    ``first_ord`` is the place of the first function among all rules of the scan.
    """
    allowed = F.array_compact(
        F.array(*[F.when(path_gate(r, F.col(path)), F.lit(i)) for i, r in enumerate(rules)])
    )
    seen = texts.select(
        *dict.fromkeys([*keep, content, path]), allowed.alias("_allowed")
    ).where(F.size("_allowed") > 0)
    arguments = [F.col(c).outer() for c in (content, path, "_allowed")]
    hits = seen.lateralJoin(matching(rules)(*arguments))

    def label(name: str):
        values = F.array(*[F.lit(getattr(r, name)) for r in rules])
        return F.get(values, F.col("rule_ord")).alias(name)

    return hits.select(
        *keep, (F.col("rule_ord") + first_ord).alias("rule_ord"), "match_ord", "line", "column",
        "snippet", F.lit(None).cast("double").alias("entropy"),
        *[label(n) for n in ("rule_id", "severity", "category")],
    )
