"""Placeholders of interpolated prompts and whether they carry untrusted input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.functions.text import java_regex, trim

# Placeholder syntax, harmless identifiers, signs of outside input.
PY_PLACEHOLDER = r"\{([^}]+)\}"
JS_PLACEHOLDER = r"\$\{([^}]+)\}"
SAFE_NAMES = (
    "id", "userId", "user_id", "username", "user_name", "email", "user_email", "userRole",
    "role", "status", "style", "textStyle", "count", "paramCount", "theme", "version",
    "created_at", "timestamp",
)
SAFE_EXPRESSION = r"^(?:[a-zA-Z0-9_.]+\.)?(?:" + "|".join(SAFE_NAMES) + r")\z"
REQUEST_ACCESS = r"(?:req|request)\.(?:body|query|params|data|json)"
INPUT_WORDS = r"(?:input|query|prompt|message|msg)"


def placeholders(template: Column, is_python: Column) -> Column:
    return F.when(
        is_python, F.regexp_extract_all(template, F.lit(PY_PLACEHOLDER), F.lit(1))
    ).otherwise(F.regexp_extract_all(template, F.lit(JS_PLACEHOLDER), F.lit(1)))


def is_safe_expression(expr: Column) -> Column:
    return F.rlike(trim(expr), F.lit(java_regex(SAFE_EXPRESSION)))


def is_untrusted_expression(expr: Column) -> Column:
    return ~is_safe_expression(expr) & F.rlike(
        expr, F.lit(java_regex(f"(?:{REQUEST_ACCESS}|{INPUT_WORDS})"))
    )


def has_untrusted(template: Column, is_python: Column) -> Column:
    return F.exists(placeholders(template, is_python), is_untrusted_expression)
