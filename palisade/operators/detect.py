"""Compile a list of rules into one row-local pass over texts.

1. *Gate* (``operators.gate``): one columnar regex pass tells which rules can fire in
   a text, a path test which may. Texts with none (nearly all) go no further.
2. Only fired (text, rule) pairs are expanded. One generic expression, fed with
   the rule's parameters, finds positions, tokens and filters false hits.
3. The hits are expanded and the text is dropped.

There is no shuffle and no join in any step, and steps 2 and 3 are native
expressions. The plan does not grow with the rule list.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Sequence

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.catalogue import (
    CALL, ENV, PINECONE_TOKEN_PREFIX, PROMPT, PYTHON_PATH, SECRET, SPREAD_OR_VARIABLE, TOKEN_LIMIT,
    VECTOR, Pattern, Rule,
)
from palisade.functions.calls import call_arguments
from palisade.functions.entropy import is_high_entropy, token_entropy
from palisade.functions.masking import mask, mask_first
from palisade.functions.positions import (
    group_texts, hit_lines, line_positions, mark_matches, marker_template, matched_texts,
    pieces_from_matches, without_groups,
)
from palisade.functions.prompts import has_untrusted
from palisade.operators.gate import fired_rules
from palisade.functions.text import forward_slashes, java_regex, let, trim


def is_python(path: Column) -> Column:
    return F.rlike(path, F.lit(java_regex(PYTHON_PATH)))


def path_gate(rule: Rule, path: Column) -> Column:
    gate = F.lit(True)
    if rule.path_pattern:
        gate = F.rlike(path, F.lit(java_regex(rule.path_pattern)))
    for suffix in rule.skip_suffixes:
        gate = gate & ~F.endswith(forward_slashes(path), F.lit(suffix))
    return gate


_PATTERN_DDL = "struct<regex:string,template:string>"
_RULE_DDL = (
    "struct<rule_id:string,severity:string,category:string,kind:string,redact:boolean,"
    "one_per_line:boolean,min_entropy:double,not_prefix:string,"
    f"patterns:array<{_PATTERN_DDL}>,python_patterns:array<{_PATTERN_DDL}>>"
)


def _pattern_rows(patterns: Sequence[Pattern]) -> list[dict]:
    return [
        {"regex": p.java, "template": marker_template(p.mark, p.groups)} for p in patterns
    ]


def rule_parameters(rules: Sequence[Rule]) -> Column:
    """A constant array, one struct per rule, folded to a literal by the optimizer.

    It enters the plan as one JSON literal: building it from hundreds of ``lit``
    nodes made analysis slower than the scan itself.
    """
    rows = [
        {
            "rule_id": r.rule_id,
            "severity": r.severity,
            "category": r.category,
            "kind": r.kind,
            "redact": r.redact,
            "one_per_line": r.one_per_line,
            "min_entropy": r.min_entropy,
            "not_prefix": r.not_prefix,
            "patterns": _pattern_rows(r.patterns),
            "python_patterns": _pattern_rows(r.python_patterns or r.patterns),
        }
        for r in rules
    ]
    return F.from_json(F.lit(json.dumps(rows)), f"array<{_RULE_DDL}>")


@functools.lru_cache(maxsize=64)
def _named_hits(gateway: object, content: str, path: str, rule: str) -> Column:
    return rule_hits(F.col(content), F.col(path), F.col(rule))


def hits_column(content: str, path: str, rule: str) -> Column:
    """``rule_hits`` for named columns; the large expression is built once per JVM."""
    return _named_hits(SparkContext._gateway, content, path, rule)


def rule_hits(content: Column, path: Column, rule: Column) -> Column:
    """Hits of one rule in one text, in order, false ones removed.

    ``struct<snippets array<array<string>>, hits array<struct<...>>>``. Each line
    with hits is stored once in ``snippets``, under the hits' ``regex_ord`` and ``nth``.
    """
    python = is_python(path)
    patterns = F.when(python, rule["python_patterns"]).otherwise(rule["patterns"])

    def is_bounded(arguments: Column) -> Column:
        return F.rlike(arguments, F.lit(java_regex(TOKEN_LIMIT, False))) | F.rlike(
            trim(arguments), F.lit(java_regex(SPREAD_OR_VARIABLE, False))
        )

    def located(pattern: Column, ord_: Column) -> Column:
        def zipped(b: Column) -> Column:
            bounded = F.when(
                rule["kind"] == CALL,
                call_arguments(
                    pieces_from_matches(b["marked"]), matched_texts(b["marked"]), is_bounded
                ),
            ).otherwise(F.transform(b["tokens"], lambda _: F.lit(False)))
            pairs = F.zip_with(
                b["tokens"], bounded, lambda t, a: F.struct(t.alias("token"), a.alias("bounded"))
            )
            hits = F.zip_with(
                line_positions(b["lines"]),
                pairs,
                lambda p, t: F.struct(
                    ord_.alias("regex_ord"),
                    p["line"].alias("line"),
                    p["column"].alias("column"),
                    p["nth"].alias("nth"),
                    t["token"].alias("token"),
                    t["bounded"].alias("bounded"),
                ),
            )
            return F.struct(
                F.transform(b["lines"], lambda x: x["snippet"]).alias("snippets"),
                hits.alias("hits"),
            )

        def bound(b: Column) -> Column:
            return F.struct(
                b["marked"].alias("marked"),
                b["tokens"].alias("tokens"),
                hit_lines(b["marked"]).alias("lines"),
            )

        # the group texts are read off first and taken out: they may hold line breaks
        return let(
            mark_matches(content, pattern["regex"], pattern["template"]),
            lambda full: let(
                let(
                    F.struct(
                        without_groups(full).alias("marked"), group_texts(full).alias("tokens")
                    ),
                    bound,
                ),
                zipped,
            ),
        )

    def kept(h: Column) -> Column:
        secret = ~F.coalesce(F.startswith(h["token"], rule["not_prefix"]), F.lit(False)) & (
            F.when(rule["min_entropy"].isNull(), F.lit(True)).otherwise(
                is_high_entropy(h["token"], rule["min_entropy"])
            )
        )
        repeated = F.startswith(h["token"], F.lit(PINECONE_TOKEN_PREFIX)) & (h["regex_ord"] > 0)
        return (
            F.when(rule["kind"] == SECRET, secret)
            .when(rule["kind"] == PROMPT, has_untrusted(h["token"], python))
            .when(rule["kind"] == CALL, ~h["bounded"])
            .when(rule["kind"] == VECTOR, ~repeated)
            .when(rule["kind"] == ENV, ~F.contains(h["token"], F.lit("process.env")))
            .otherwise(F.lit(True))
        )

    def first_per_line(hits: Column) -> Column:
        # sorted by line, a hit is a repeat if the one before it has the same line
        by_line = F.array_sort(
            F.transform(
                hits, lambda h, i: F.struct(h["line"].alias("line"), i.alias("i"), h.alias("h"))
            )
        )
        firsts = let(
            by_line,
            lambda b: F.filter(
                b, lambda x, i: (i == 0) | (F.get(b, i - 1)["line"] != x["line"])
            ),
        )
        in_order = F.array_sort(
            F.transform(firsts, lambda x: F.struct(x["i"].alias("i"), x["h"].alias("h")))
        )
        return F.transform(in_order, lambda x: x["h"])

    def finished(found: Column) -> Column:
        hits = F.filter(F.flatten(F.transform(found, lambda x: x["hits"])), kept)
        hits = let(hits, lambda h: F.when(rule["one_per_line"], first_per_line(h)).otherwise(h))
        return F.struct(
            F.transform(found, lambda x: x["snippets"]).alias("snippets"),
            F.transform(
                hits,
                lambda h: F.struct(
                    h["regex_ord"].alias("regex_ord"),
                    h["line"].alias("line"),
                    h["column"].alias("column"),
                    h["nth"].alias("nth"),
                    F.when(rule["redact"], h["token"]).alias("secret"),
                    F.when(rule["min_entropy"].isNotNull(), token_entropy(h["token"]))
                    .alias("entropy"),
                ),
            ).alias("hits"),
        )

    return let(F.transform(patterns, located), finished)


def detect(
    texts: DataFrame,
    rules: Sequence[Rule],
    content: str,
    path: str,
    keep: Sequence[str],
    keep_clean: bool = False,
    per_text: dict[str, Column] | None = None,
) -> DataFrame:
    """``keep`` and ``per_text`` columns plus one row per hit: ``rule_ord, match_ord, line, column,
    snippet, entropy, rule_id, severity, category``.

    With ``keep_clean`` a text without hits yields one row with null hit columns,
    and ``first_row`` is true on exactly one row per text. ``per_text`` columns are
    computed from the text, only where some rule fires.
    """
    if not rules:
        raise ValueError("no active rules")
    c, p = F.col(content), F.col(path)
    gates: dict[tuple, Column] = {}
    for r in rules:
        gates.setdefault((r.path_pattern, r.skip_suffixes), path_gate(r, p))
    allowed = F.array(*gates.values())
    gate_of = F.from_json(
        F.lit(json.dumps([list(gates).index((r.path_pattern, r.skip_suffixes)) for r in rules])),
        "array<int>",
    )
    carried = list(dict.fromkeys([*keep, content, path]))
    # where every rule asks for a kind of path, texts of other paths are not even read
    looked_at = c if any(g == (None, ()) for g in gates) else F.when(F.exists(allowed, lambda ok: ok), c)
    candidates = texts.select(*carried, fired_rules(rules, looked_at).alias("_any"))
    fired = candidates.select(
        *carried,
        F.when(
            F.size("_any") > 0,
            let(allowed, lambda ok: F.filter("_any", lambda i: F.get(ok, F.get(gate_of, i)))),
        )
        .otherwise(F.array().cast("array<int>"))
        .alias("_fired"),
    )
    extra = per_text or {}
    if extra:
        fired = fired.select(
            "*", *[F.when(F.size("_fired") > 0, v).alias(k) for k, v in extra.items()]
        )
    keep = (*keep, *extra)
    # Outer explodes throughout: for an inner one the optimizer infers a size filter
    # and pushes it below the projection, where all gates would be evaluated again.
    carried = list(dict.fromkeys([*keep, content, path]))
    pairs = fired.select(*carried, F.posexplode_outer("_fired").alias("_nth_rule", "rule_ord"))
    if not keep_clean:
        pairs = pairs.where(F.col("rule_ord").isNotNull())
    hits = pairs.select(
        "*", F.get(rule_parameters(rules), F.col("rule_ord")).alias("_rule")
    ).select("*", hits_column(content, path, "_rule").alias("_hits"))
    labels = ("rule_id", "severity", "category")
    # the list is a column of its own, so that exploding does not carry it along
    lists = hits.select(
        *keep, "_nth_rule", "rule_ord", *[F.col(f"_rule.{n}").alias(n) for n in labels],
        F.col("_hits.snippets").alias("_snippets"), F.col("_hits.hits").alias("_list"),
    )
    rows = lists.select(
        *keep, "_nth_rule", "rule_ord", *labels, "_snippets",
        F.posexplode_outer("_list").alias("match_ord", "_hit"),
    )
    if not keep_clean:
        rows = rows.where(F.col("match_ord").isNotNull())
    line = F.get(F.get("_snippets", F.col("_hit.regex_ord")), F.col("_hit.nth"))
    secret = F.col("_hit.secret")
    found = [
        F.col("rule_ord"), F.col("match_ord"), F.col("_hit.line"), F.col("_hit.column"),
        F.when(secret.isNotNull(), mask_first(line, secret, mask(secret))).otherwise(line)
        .alias("snippet"),
        F.col("_hit.entropy"),
        *[F.when(F.col("_hit").isNotNull(), F.col(n)).alias(n) for n in labels],
    ]
    if keep_clean:
        first = (F.coalesce("_nth_rule", F.lit(0)) == 0) & (F.coalesce("match_ord", F.lit(0)) == 0)
        found.append(first.alias("first_row"))
    return rows.select(*keep, *found)
