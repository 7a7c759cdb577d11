"""Settings as nested dicts: sources merged in order, overrides by dotted names, checked against a schema."""

from __future__ import annotations

import ast
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge(*sources: dict) -> dict:
    """Nested dicts, the later one's value where both have a key (F32)."""
    out: dict = {}
    for s in sources:
        for k, v in s.items():
            out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def dotted(options: list[str]) -> dict:
    """["a.b=1", ...] or ["a.b", "1", ...] as nested dicts."""
    if options and "=" not in options[0]:
        options = [f"{k}={v}" for k, v in zip(options[::2], options[1::2], strict=True)]
    out: dict = {}
    for o in options:
        name, _, value = o.partition("=")
        node, parts = out, name.split(".")
        for p in parts[:-1]:
            node = node.setdefault(p, {})
        try:
            node[parts[-1]] = ast.literal_eval(value)
        except (ValueError, SyntaxError):
            node[parts[-1]] = {"true": True, "false": False, "null": None}.get(value.lower(), value)
    return out


def check(config: dict, schema: dict[str, dict[str, Any]]) -> dict:
    """The config with types converted; unknown keys, wrong types, missing values and values not among the choices raise (P20).

    schema: key -> {"type": callable, "choices": [...], "required": bool, "default": value}.
    """
    unknown = sorted(set(config) - set(schema))
    if unknown:
        raise ValueError(f"unknown keys {unknown}")
    out = {}
    for key, rule in schema.items():
        if key not in config:
            if rule.get("required"):
                raise ValueError(f"{key} is required")
            if "default" in rule:
                out[key] = rule["default"]
            continue
        value = config[key]
        try:
            value = rule["type"](value) if "type" in rule and value is not None else value
        except (TypeError, ValueError) as e:
            raise ValueError(f"{key}: {value!r} is no {rule['type'].__name__}") from e
        if "choices" in rule and value not in rule["choices"]:
            raise ValueError(f"{key}: {value!r} is none of {rule['choices']}")
        out[key] = value
    return out


def checked_rows(df: DataFrame, words: str, spec: dict) -> DataFrame:
    """Rows of df, one for each setting in its array of `a.b=c` words, with name, value and problem.

    Of equal names the last counts. problem: `no value`, `unknown key`, `not a <type>` or `not a choice` after spec ({name: {type, choices}}), or null. Null words are left out.
    """
    one = df.drop(words).columns
    d = df.select(*one, F.posexplode(F.filter(words, lambda w: w.isNotNull())).alias("_k", "_w"))
    d = d.select(*one, "_k", F.regexp_extract("_w", "^([^=]*)", 1).alias("name"), F.when(F.contains("_w", F.lit("=")), F.regexp_replace("_w", "^[^=]*=", "")).alias("value"))
    d = d.groupBy(*one, "name").agg(F.max_by("value", "_k").alias("value"))
    problem = F.when(F.col("value").isNull(), "no value").when(~F.col("name").isin(*spec), "unknown key")
    for name, rule in spec.items():
        here = F.col("name") == name
        if "type" in rule:
            problem = problem.when(here & F.col("value").try_cast(rule["type"]).isNull(), f"not a {rule['type']}")
        if "choices" in rule:
            problem = problem.when(here & ~F.col("value").isin(*rule["choices"]), "not a choice")
    return d.withColumn("problem", problem)
