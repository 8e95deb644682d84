"""String, path and date column functions."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from whylake import constants as K

# Line separators and blanks wider than Spark's trim, so that text written by
# other tools splits and strips alike.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
EDGE_BLANKS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def lines(text: Column) -> Column:
    """The lines of a text; a last line break ends a line and does not begin an empty one."""
    return F.split(F.regexp_replace(text, f"(?:{LINE_BREAK})\\z", ""), LINE_BREAK)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for a row, however often it is named."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Unicode-aware trim.  The regex runs only where a plain trim is not provably enough."""
    return F.regexp_replace(text, EDGE_BLANKS, "")


def bounded_text(text: Column, limit: int, mark: str = K.TRUNCATED_DIFF_MARK) -> Column:
    """At most ``limit`` characters, with a mark where something was cut."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(mark))).otherwise(text)


def head_tail(text: Column, limit: int) -> Column:
    """Keep both ends of a long text; the result never exceeds ``limit`` characters."""
    if limit <= 1:
        cut = F.right(text, F.lit(limit)) if limit == 1 else F.lit("")
    else:
        head = limit // 2
        tail = limit - head - 1
        end = F.right(text, F.lit(tail)) if tail else F.lit("")
        cut = F.concat(F.substring(text, 1, head), F.lit("…"), end)
    return F.when(F.length(text) <= limit, text).otherwise(cut)


def head_tail_list(items: Column, limit: int) -> Column:
    """Both ends of a long list, ``limit`` items in total."""
    if limit <= 1:
        cut = F.slice(items, -1, 1)
    else:
        head = limit // 2
        cut = F.concat(F.slice(items, 1, head), F.slice(items, head - limit, limit - head))
    return F.when(F.size(items) <= limit, items).otherwise(cut)


def slug(path: Column) -> Column:
    return F.regexp_replace(path, "[^A-Za-z0-9]", "-")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def is_below(path: Column, root: Column) -> Column:
    return F.startswith(path, F.concat(root, F.lit("/")))


def relative_to(path: Column, root: Column) -> Column:
    """Path inside ``root``, NULL for anything outside."""
    return F.when(is_below(path, root), F.substr(path, F.length(root) + 2))


def display_path(path: Column, root: Column) -> Column:
    """Path inside ``root``; outside it only the file name, so no foreign directory leaks."""
    return F.coalesce(relative_to(path, root), basename(path))


def commit_type(subject: Column) -> Column:
    head = F.lower(F.trim(F.split_part(F.split_part(subject, F.lit(":"), F.lit(1)), F.lit("("), F.lit(1))))
    return F.when(head.isin(*K.COMMIT_TYPES), head).otherwise("")


def parse_target(target: Column) -> Column:
    """``file``, ``file:12`` or ``file:12-20`` as struct(file, start, end)."""
    pattern = r"(?s)^(.+):(\d+)(?:-(\d+))?$"
    matched = F.regexp_like(target, F.lit(pattern))
    start = F.when(matched, F.regexp_extract(target, pattern, 2).try_cast("bigint"))
    end = F.when(matched, F.regexp_extract(target, pattern, 3).try_cast("bigint"))
    return F.struct(
        F.when(matched, F.regexp_extract(target, pattern, 1)).otherwise(target).alias("file"),
        start.alias("start"),
        F.coalesce(end, start).alias("end"),
    )


def short_hash(text: Column, length: int) -> Column:
    return F.substring(F.sha2(text, 256), 1, length)


def card_id(file: Column, start: Column, end: Column, anchor: Column, rejected: Column) -> Column:
    raw = F.concat_ws(":", file, start.cast("string"), end.cast("string"), anchor, rejected)
    return F.concat(F.lit("review-"), short_hash(raw, 12))


def question_id(file: Column, start: Column, end: Column, question: Column, newest: Column, since: Column) -> Column:
    number = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    raw = F.concat(
        file, F.lit("|"), number(start), F.lit("-"), number(end), F.lit("|"), question, F.lit("|"), newest,
        F.lit("|"), F.coalesce(since, F.lit("")),
    )
    return F.concat(F.lit("ask:"), short_hash(raw, 40))


def note_folder(name: Column, project: Column) -> Column:
    readable = F.regexp_replace(name, r"[^\p{L}\p{N}_-]", "-")
    return F.concat(readable, F.lit("-"), short_hash(project, 8))


def status_label(code: Column) -> Column:
    """Two-letter working-tree status to its label, the more urgent letter deciding."""
    padded = F.rpad(F.substring(F.coalesce(code, F.lit("  ")), 1, 2), 2, " ")
    x, y = F.substring(padded, 1, 1), F.substring(padded, 2, 1)
    rank = lambda c: F.when(c == " ", F.lit(None)).otherwise(
        F.coalesce(
            *[F.when(c == letter, F.lit(i)) for i, (letter, _) in enumerate(K.STATUS_LABELS)], F.lit(99)
        )
    )
    best = F.least(rank(x), rank(y))
    name = F.coalesce(*[F.when(best == i, F.lit(text)) for i, (_, text) in enumerate(K.STATUS_LABELS)])
    staged = ~x.isin(" ", "?", "U") & (rank(x) == best)
    stripped = F.trim(padded)
    return (
        F.when(best.isNull(), F.when(stripped == "", F.lit("?")).otherwise(stripped))
        .when(name.isNull(), stripped)
        .when(staged, F.concat(F.lit(K.STAGED_PREFIX), name))
        .otherwise(name)
    )


def neutral_markdown(text: Column) -> Column:
    """Back-ticks and angle brackets neutralised, so that no subject text disappears in a note."""
    return F.replace(F.replace(F.replace(text, F.lit("`"), F.lit("ʼ")), F.lit("<"), F.lit("\\<")), F.lit(">"), F.lit("\\>"))


def first_sentence(text: Column) -> Column:
    return F.regexp_replace(F.substring_index(F.coalesce(text, F.lit("")), "。", 1), r"^[。 \n]+|[。 \n]+$", "")


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """Percentage that is 0 for an empty whole."""
    return F.bround(F.lit(100.0) * part / F.greatest(whole, F.lit(1)), digits)


def is_doc_path(path: Column) -> Column:
    lowered = F.lower(path)
    ends = [F.endswith(lowered, F.lit(s)) for s in K.DOC_SUFFIXES]
    return F.startswith(lowered, F.lit("docs/")) | ends[0] | ends[1] | ends[2] | ends[3]


def code_only_diff(diff: Column) -> Column:
    """Drop the sections of a patch that touch documents."""
    header = r"^diff --git a/\S+ b/(\S+)"
    sections = F.split(diff, r"(?m)^(?=diff --git )")
    kept = F.filter(
        sections,
        lambda s: ~(F.regexp_like(s, F.lit(header)) & is_doc_path(F.regexp_extract(s, header, 1))),
    )
    return F.when(~F.contains(diff, F.lit("diff --git")), diff).otherwise(strip(F.array_join(kept, "")))


def is_trivial_name(path: Column) -> Column:
    """Lock files and minified bundles."""
    pattern = "|".join(re.escape(n).replace(r"\*", ".*") for n in K.TRIVIAL_NAMES)
    return F.regexp_like(basename(path), F.lit(f"(?s)^(?:{pattern})$"))


def parse_time(value: Column) -> Column:
    """ISO text, epoch seconds or epoch milliseconds (also as text) to TIMESTAMP; NULL when unreadable."""
    number = value.try_cast("double")
    seconds = F.when(number.isNotNull(), F.when(F.abs(number) >= 1e11, number / 1000).otherwise(number))
    return F.coalesce(
        F.timestamp_micros((seconds * 1000000).cast("bigint")),
        F.try_to_timestamp(value),
    )


def since_bound(phrase: str, now: datetime) -> datetime | None:
    """Lower bound of "N days ago" or an ISO date.  An unknown phrase means no bound."""
    days = {"hour": 1 / 24, "hours": 1 / 24, "day": 1, "days": 1, "week": 7, "weeks": 7, "month": 30, "months": 30}
    words = phrase.split()
    try:
        if len(words) >= 2 and words[-1] == "ago" and words[1] in days:
            return now - timedelta(days=float(words[0]) * days[words[1]])
        return datetime.fromisoformat(phrase)
    except ValueError:
        return None


def packed_hex(text: Column) -> Column:
    """A text as bytes: one for two digits where it is lower-case hexadecimal, as a SHA is, else its own; different texts
    stay different, and SHAs in their order."""
    plain = F.regexp_like(text, F.lit(r"\A(?:[0-9a-f]{2})*\z"))
    return F.when(plain, F.concat(F.unhex(F.lit("01")), F.unhex(text))).otherwise(F.concat(F.unhex(F.lit("00")), F.encode(text, "utf-8")))


def unpacked_hex(data: Column) -> Column:
    """What ``packed_hex`` was made of."""
    rest = F.substring(data, 2, (1 << 31) - 1)
    return F.when(F.hex(F.substring(data, 1, 1)) == "01", F.lower(F.hex(rest))).otherwise(F.decode(rest, "utf-8"))
