"""Template signatures: mask the variable parts of a message, then join the key fields."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Pattern, token, and a text without which the original message cannot match ("" for none).
Rule = tuple[str, str, str]

# What is masked, by which token, in this order. UUIDs and addresses come
# before digit runs, which would otherwise break them up. Quantifiers are possessive and an
# address starts at the head of a digit run, so a long run of digits costs linear time.
DEFAULT_RULES: tuple[Rule, ...] = (
    (r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}", "{UUID}", "-"),
    (r"[0-9](?<![0-9]{2})[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++", "{IP}", "."),
    (r"[0-9]++", "{NUM}", ""),
    (r'"[^"]*+"', "{STR}", '"'),
)

# What a missing field counts as.
FIELD_DEFAULTS = {"level": "INFO", "component": "unknown", "message": ""}


def _replacement(token: str) -> str:
    """``$`` and backslash are special in a regex replacement."""
    return re.sub(r"([\\$])", r"\\\1", token)


def normalize(message: Column, rules: Sequence[Rule] = DEFAULT_RULES) -> Column:
    """Apply the masking rules in order, as one expression that grows by a rule for a rule."""
    text = message
    for pattern, token, _ in rules:
        text = F.regexp_replace(text, F.lit(pattern), F.lit(_replacement(token)))
    return text


def with_template(df: DataFrame, message: Column, rules: Sequence[Rule] = DEFAULT_RULES, out: str = "template") -> DataFrame:
    """Add the masked message; each rule is a step of its own on the text of the step before.

    Most messages lack most of the needles; looking for a plain text first spares them the
    regex, at about half the cost for prose. As a step names its text, using it twice does not
    double the expression.
    """
    df = df.withColumn(out, message)
    for pattern, token, needle in rules:
        masked = F.regexp_replace(out, F.lit(pattern), F.lit(_replacement(token)))
        df = df.withColumn(out, F.when(F.col(out).contains(needle), masked).otherwise(F.col(out)) if needle else masked)
    return df


def field(df: DataFrame, name: str, prefix: str = "log_") -> Column:
    """Read ``name``, else its prefixed twin, else the default. Empty strings are kept."""
    found = [F.col(c) for c in (name, prefix + name) if c in df.columns]
    default = FIELD_DEFAULTS.get(name)
    if default is not None:
        found.append(F.lit(default))
    if not found:
        raise ValueError(f"no column {name} or {prefix}{name}")
    return F.coalesce(*found)


def signature(level: Column, component: Column, message: Column,
              rules: Sequence[Rule] = DEFAULT_RULES) -> Column:
    return F.concat_ws("|", level, component, normalize(message, rules))


def with_signature(df: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES, out: str = "sig") -> DataFrame:
    """Add the signature column from level, component and message."""
    level, component = field(df, "level"), field(df, "component")
    masked = with_template(df, field(df, "message"), rules, out)
    return masked.withColumn(out, F.concat_ws("|", level, component, F.col(out)))


def tag_record(df: DataFrame, sig: str, count: Column) -> DataFrame:
    """Add the four columns that turn a record into an aggregated document."""
    return df.withColumns({
        "_agg_id": F.col(sig),
        "_agg_signature": F.col(sig),
        "count": count.cast("long"),
        "aggregated": F.lit(True),
    })
