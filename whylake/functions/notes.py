"""Decision notes: what people wrote into commit bodies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from whylake import constants as K
from whylake.functions.redact import redact
from whylake.functions.text import lines, strip


def notes_of(body: Column, prefix: str) -> Column:
    """Texts of the lines that start with ``prefix`` (exact, case-sensitive); blank ones dropped."""
    wanted = F.filter(F.transform(lines(F.coalesce(body, F.lit(""))), strip), lambda x: F.startswith(x, F.lit(prefix)))
    texts = F.transform(wanted, lambda x: strip(F.substr(x, F.lit(len(prefix) + 1))))
    return F.filter(texts, lambda x: x != "")


def decisions(body: Column) -> Column:
    return notes_of(body, K.NOTE_DECISION)


def watches(body: Column) -> Column:
    return notes_of(body, K.NOTE_WATCH)


def rejected(body: Column) -> Column:
    return notes_of(body, K.NOTE_REJECTED)


def has_notes(body: Column, kinds: tuple[str, ...] = (K.NOTE_DECISION, K.NOTE_WATCH, K.NOTE_REJECTED)) -> Column:
    """True when the body carries at least one non-empty note of the given kinds."""
    result = F.lit(False)
    for kind in kinds:
        result = result | (F.size(notes_of(body, kind)) > 0)
    return result


def merged(generated: Column, authored: Column) -> Column:
    """Generated items first, then authored ones, first occurrence kept."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(generated, empty), F.coalesce(authored, empty)))


def without_filler(items: Column) -> Column:
    """Blank items and "not enough material" answers removed."""
    return F.filter(items, lambda x: (F.trim(x) != "") & ~F.startswith(F.trim(x), F.lit(K.FILLER_PREFIX)))


def redacted_list(items: Column) -> Column:
    return F.transform(items, redact)


def texts_or_empty(items: Column) -> Column:
    return F.coalesce(items, F.array().cast("array<string>"))


def has_why(why: Column, decided: Column, dropped: Column, evidence_count: Column) -> Column:
    """A segment explains itself through a why, a decision, a rejected path or evidence; risks do not count."""
    return (
        (F.trim(F.coalesce(why, F.lit(""))) != "")
        | (F.size(decided) > 0)
        | (F.size(dropped) > 0)
        | (F.coalesce(evidence_count, F.lit(0)) > 0)
    )
