"""Secret redaction as column expressions."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from whylake import constants as K
from whylake.functions.text import let

SECRET_NAMES = tuple(name for name, _, _ in K.SECRET_PATTERNS)


#: What every match of a pattern holds, as written there: one of these pieces.
PIECES = {
    "openai_key": ("sk-",), "github_token": ("ghp_", "gho_", "ghs_", "github_pat_"), "slack_token": ("xox",), "aws_access_key": ("AKIA",),
    "google_api_key": ("AIza",), "google_oauth_client": (".apps.googleusercontent.com",), "stripe_key": ("sk_live_", "sk_test_"),
    "sendgrid_key": ("SG.",), "jwt": (".ey",), "private_key": ("-----BEGIN ",), "slack_webhook": ("https://hooks.slack.com/services/",),
}


def may_hold(name: str, text: Column) -> Column:
    """Whether a pattern can match in a text at all, told by searches that cost far less; a false answer is sure."""
    anyone = lambda *pieces: functools.reduce(operator.or_, (F.contains(text, F.lit(p)) for p in pieces))
    if name == "bearer_token":
        return F.regexp_like(text, F.lit("[bB][eE][aA][rR][eE][rR]"))
    if name == "named_secret":
        # the end of a match; its names may be written in many ways (a long s for s, i without or with a dot)
        return anyone(":", "=") & F.regexp_like(text, F.lit(r"(?U)[:=]\s*[\"']?[A-Za-z0-9._-]{12}"))
    return anyone(*PIECES[name])


def redact(text: Column) -> Column:
    """All patterns in their fixed order; each replaces on the result of the one before, where it can match.

    A replacement brings no text in which a later pattern could begin to match, so what can match is told by the text as
    it was.  The text is put into a list of one, so that it is computed once however often the patterns name it.
    """
    def step(value: Column, can_match: Column, pattern: str, replacement: str) -> Column:
        return let(value, lambda v: F.when(can_match, F.regexp_replace(v, pattern, replacement)).otherwise(v))

    def masked(whole: Column) -> Column:
        value = whole
        for name, pattern, replacement in K.SECRET_PATTERNS:
            value = step(value, may_hold(name, whole), pattern, replacement)
        return value

    return let(text, masked)


def with_redaction_counts(df: DataFrame, column: str, prefix: str = "n_") -> DataFrame:
    """Redact ``column`` in place and add one match count per pattern; the matched values never leave the row."""
    for name, pattern, replacement in K.SECRET_PATTERNS:
        df = df.withColumns(
            {
                prefix + name: F.regexp_count(F.col(column), F.lit(pattern)).cast("bigint"),
                column: F.regexp_replace(F.col(column), pattern, replacement),
            }
        )
    return df


def redact_nested(value: Column, dtype: T.DataType) -> Column:
    """Redact every string leaf of a nested value, before any encoding.  Map keys stay as they are."""
    if isinstance(dtype, T.StringType):
        return redact(value)
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda x: redact_nested(x, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.transform_values(value, lambda _, v: redact_nested(v, dtype.valueType))
    if isinstance(dtype, T.StructType):
        fields = [redact_nested(value[f.name], f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def redact_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Redact the named columns (default: all) according to their types."""
    names = columns or df.columns
    return df.withColumns({n: redact_nested(F.col(n), df.schema[n].dataType) for n in names})
