"""Rule categories, message templates and lifecycle messages as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog.catalog import CATEGORIES, OTHER, Category
from tidelog.functions.text import FLAGS, UNKNOWN, strip

# What tells of a start, and what takes it back.
_NEGATED = r"\b(?:failed|failure|not started|already|stopped|fallito)\b"
_UNIT = r"^(Started|Starting|Avviato|Avvio)\s+(.+?)(?:\.$|$)"
_STARTED = r"\b(?:process|service|daemon|server|processo|servizio)\b.{0,60}\b(?:started|launched|avviat[oa])\b"
_STARTED_FIRST = r"^(?:started|avviato)\b"


def classify(process: Column, message: Column, categories: tuple[Category, ...] = CATEGORIES, other: str = OTHER) -> Column:
    """The first category, in the catalogue's order, that a message falls under; ``other`` if there is none."""
    # What is found in the message is found in "process message" too, but for patterns that hold on to the beginning.
    context = F.concat(process, F.lit(" "), message)
    either = lambda patterns: FLAGS + "|".join(f"(?:{p})" for p in patterns)
    cases = []
    for c in categories:
        hit = context.rlike(either(c.patterns))
        first = [p for p in c.patterns if "^" in p or r"\A" in p or "(?<" in p]
        hit = hit | message.rlike(either(first)) if first else hit
        cases.append(F.when(hit & ~message.rlike(either(c.exclude)) if c.exclude else hit, c.id))
    return F.coalesce(*cases, F.lit(other))


def message_template(message: Column) -> Column:
    """The message with addresses, ids and process numbers masked, white space folded, 300 characters at most."""
    out = message
    for pattern, mask in (  # fixed values
        (r"(?U)\b(?:\d{1,3}\.){3}\d{1,3}\b", "<ip>"),
        (r"(?iU)\b[0-9a-f]{8}-[0-9a-f-]{27,}\b", "<id>"),
        (r"(?iU)\bpid[=: ]+\d+", "pid=<pid>"),
        (r"(?U)\[\d+\]", "[<pid>]"),
        (r"(?U)\s+", " "),
    ):
        out = F.regexp_replace(out, pattern, mask)
    return F.coalesce(F.nullif(F.substring(strip(out), 1, 300), F.lit("")), F.lit("(messaggio vuoto)"))


def lifecycle(process: Column, message: Column, pid: Column) -> Column:
    """struct(target, match_process, target_pid, status) of a message that tells of a start, null otherwise.

    Service managers name the unit that they start; other processes tell of themselves.
    """
    text = F.regexp_extract(message, FLAGS + _UNIT, 2)
    verb = F.lower(F.regexp_extract(message, FLAGS + _UNIT, 1))
    managed = message.rlike(FLAGS + _UNIT) & process.isin("systemd", "init")
    of_unit = F.struct(
        F.substring(text, 1, 100).alias("target"),
        F.regexp_extract(text, r"(?U)^\s*(\S+)", 1).alias("match_process"),
        F.lit("").alias("target_pid"),
        F.when(verb.isin("starting", "avvio"), "avvio richiesto").otherwise("avvio segnalato").alias("status"),
    )
    itself = (message.rlike(FLAGS + _STARTED) | message.rlike(FLAGS + _STARTED_FIRST)) & (process != UNKNOWN)
    of_itself = F.struct(process.alias("target"), process.alias("match_process"), pid.alias("target_pid"), F.lit("avvio segnalato").alias("status"))
    return F.when(~message.rlike(FLAGS + _NEGATED), F.when(managed, of_unit).when(itself, of_itself))
