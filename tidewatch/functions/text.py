"""Text and number-format column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text that must not reach a reader of untrusted content, and its replacement.
REDACTED = "[REDACTED]"
INJECTION_PATTERNS = [
    r"<\s*/?\s*(?:system|human|assistant|tool_use|tool_result)\b",
    r"\bignore\s+(?:(?:all|previous|above)\s+)*instructions?\b",
    r"\byou\s+are\s+now\b",
    r"\bnew\s+instructions?\s*:",
]

# Trust level of each kind of source.
SOURCE_TRUST = {
    "job": "trusted",
    "metric": "trusted",
    "consumer_lag": "trusted",
    "event": "semi-trusted",
    "log": "untrusted",
    "exception": "untrusted",
}

# Words that make a text read like an anomaly.
ANOMALY_WORDS = [
    "anomaly",
    "spike",
    "degraded",
    "failing",
    "exceeded",
    "threshold",
    "timeout",
    "error",
    "critical",
    "backpressure",
    "lag",
    "pressure",
]

# Number in a text with units, once thousands separators are gone.
NUMBER_PATTERN = r"[-+]?\d*\.?\d+"

_WHITESPACE = " \n\t\r\f\u000b"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` refers to it.

    Conditions and branches are outside of Spark's elimination of common
    subexpressions, so a costly operand would be computed for each of them.
    """
    return F.transform(F.array(value), use)[0]


def contains_any(lowered: Column, words: list[str]) -> Column:
    found = F.contains(lowered, F.lit(words[0]))
    for word in words[1:]:
        found = found | F.contains(lowered, F.lit(word))
    return found


def json_escape(c: Column) -> Column:
    """Escape backslash and double quote, the two characters that end a JSON string."""
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def two_decimals(c: Column) -> Column:
    """Fixed two decimals, half up, independent of the locale."""
    return F.format_string("%.2f", c)


def leading_number(c: Column) -> Column:
    """First number in a text such as '2,340ms'; null when there is none."""
    found = F.regexp_extract(F.replace(c, F.lit(","), F.lit("")), NUMBER_PATTERN, 0)
    return F.nullif(found, F.lit("")).try_cast("double")


def prefix(c: Column, n: int | None) -> Column:
    """The first n characters; the whole text where no length is given."""
    return c if n is None else F.substring(c, 1, n)


def source_trust(kind: Column) -> Column:
    """Trust level of a source kind; a kind that is not listed is untrusted."""
    table = F.create_map(*[F.lit(x) for pair in SOURCE_TRUST.items() for x in pair])
    return F.coalesce(F.try_element_at(table, kind), F.lit("untrusted"))


def sanitize(c: Column, max_chars: int | None = None, trust: Column | str = "untrusted") -> Column:
    """Redact injection patterns in untrusted text; ``max_chars`` cuts any text after that."""
    level = F.lit(trust) if isinstance(trust, str) else trust
    redacted = c
    for pattern in INJECTION_PATTERNS:
        redacted = F.regexp_replace(redacted, "(?iU)" + pattern, REDACTED)
    return prefix(F.when(level == "untrusted", redacted).otherwise(c), max_chars)


def mentions_anomaly(c: Column) -> Column:
    return once(F.lower(c), lambda t: contains_any(t, ANOMALY_WORDS))


def json_block(c: Column) -> Column:
    """JSON part of a text: a json fence, else any fence, else first '{' to last '}', else all.

    Null when a fence is opened and not closed, or the text is null.
    """

    def fenced(fence: str) -> Column:
        start = F.locate(fence, c) + len(fence)
        end = F.position(F.lit("```"), c, start)
        inner = c.substr(start, end - start)
        return F.when(end > 0, F.btrim(inner, F.lit(_WHITESPACE)))

    opening = F.locate("{", c)
    closing = F.length(c) - F.locate("}", F.reverse(c)) + 1
    braces = (opening > 0) & F.contains(c, F.lit("}")) & (closing >= opening)
    return (
        F.when(F.contains(c, F.lit("```json")), fenced("```json"))
        .when(F.contains(c, F.lit("```")), fenced("```"))
        .when(braces, c.substr(opening, closing - opening + 1))
        .otherwise(c)
    )


def front_matter(c: Column) -> Column:
    """Struct (head, body) of a text with an optional '---' block at its start.

    Without the block, head is '' and body the whole text; an unclosed block
    gives a null struct.
    """
    end = F.position(F.lit("---"), c, F.lit(4))
    head = F.btrim(c.substr(F.lit(4), end - 4), F.lit(_WHITESPACE))
    body = F.btrim(c.substr(end + 3, F.length(c)), F.lit(_WHITESPACE))
    return (
        F.when(~F.startswith(c, F.lit("---")), F.struct(F.lit("").alias("head"), c.alias("body")))
        .when(end > 0, F.struct(head.alias("head"), body.alias("body")))
    )


def front_matter_value(head: Column, key: str) -> Column:
    """Value of a 'key: value' line of a front matter block; the last one of a repeated key, null without any."""
    lines = F.filter(F.split(head, "\r?\n"), lambda x: F.btrim(F.substring_index(x, ":", 1)) == key)
    line = F.try_element_at(F.filter(lines, lambda x: F.contains(x, F.lit(":"))), F.lit(-1))
    return F.btrim(F.btrim(line.substr(F.locate(":", line) + 1, F.length(line))), F.lit("\"'"))
