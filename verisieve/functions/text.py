"""Expressions on texts: answers, markers, repetition, keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any script, as a character class of Java and RE2 alike.
SPACE = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"
NUMBER = r"-?\d[\d,]*(?:\.\d+)?"
FLOAT = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"
#: Markers of a final answer in the order in which they are tried (fixed values).
MARKERS = ("####", "answer:", "final answer:", "정답:")


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends; null stays null."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def squeeze(c: Column) -> Column:
    """Stripped, lower case, runs of white space as one space."""
    return F.regexp_replace(F.lower(strip(c)), f"{SPACE}+", " ")


def _literal(marker: str) -> str:
    return r"\Q" + marker + r"\E"


def final_answer(c: Column) -> Column:
    """The last boxed expression, else the first line after the last of the first marker that has one, else the last number; null without any."""
    tries = [last_boxed(c)]
    for m in MARKERS:
        tail = strip(F.regexp_extract(c, f"(?is)^.*{_literal(m)}(.*)$", 1))
        line = strip(F.regexp_extract(tail, r"^([^\n\r]*)", 1))
        tries.append(F.when(line != "", line))
    return F.coalesce(*tries, last_number(c))


def last_number(c: Column) -> Column:
    """The last number as written; null without one."""
    return F.try_element_at(F.regexp_extract_all(c, F.lit(f"({NUMBER})"), F.lit(1)), F.lit(-1))


def to_number(c: Column) -> Column:
    """Commas, dollar signs and closing dots left out; null where that isn't a plain decimal number."""
    plain = F.regexp_replace(F.translate(c, ",$", ""), r"\.+$", "")
    return F.when(plain.rlike(FLOAT), plain.try_cast("double"))


def has_marker(c: Column) -> Column:
    """Any marker of a final answer, in either case."""
    return F.coalesce(F.lower(c).rlike("####|answer:|정답:"), F.lit(False))


def tail_repeats(c: Column, window: int = 32, lookback: int = 512) -> Column:
    """The last ``window`` characters occur in the ``lookback`` before them; False for shorter or null texts."""
    n = F.length(c)
    tail = F.right(c, F.lit(window))
    start = F.greatest(n - F.lit(lookback + window), F.lit(0))
    before = F.substr(c, start + 1, F.greatest(n - F.lit(window) - start, F.lit(0)))
    return F.coalesce((n >= window) & F.contains(before, tail), F.lit(False))


def gold_after_hashes(c: Column) -> Column:
    """What stands after the last ``####``; null without one."""
    return F.when(F.contains(c, F.lit("####")), strip(F.substring_index(c, "####", -1)))


def json_span(c: Column) -> Column:
    """From the first opening to the last closing brace; null without both."""
    got = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    return F.when(got != "", got)


def first_divergence(a: Column, b: Column) -> Column:
    """0-based place of the first differing character; the shorter length where one begins the other, null where they are equal or null."""
    n = F.least(F.length(a), F.length(b))
    at = F.array_position(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce(x != y, F.lit(False))), F.lit(True))
    return F.when(a == b, F.lit(None)).when((at > 0) & (at <= n), at - 1).otherwise(n)


def joined_prompt(messages: Column) -> Column:
    """Contents of a conversation, a line each."""
    return F.array_join(F.transform(messages, lambda m: m["content"]), "\n")


def completion_text(messages: Column) -> Column:
    """Content of the last message; null for an empty conversation."""
    return F.try_element_at(messages, F.lit(-1))["content"]


def last_boxed(c: Column) -> Column:
    """The last boxed expression without braces in it; null without one."""
    return strip(F.try_element_at(F.regexp_extract_all(c, F.lit(r"\\boxed\{([^}]*)\}"), F.lit(1)), F.lit(-1)))


def id_renamed(c: Column, old: str, new: str) -> Column:
    """The first occurrence of ``old`` replaced by ``new``."""
    at = F.instr(c, old)
    return F.when(at > 0, F.concat(F.substring(c, F.lit(1), at - 1), F.lit(new), F.substr(c, at + len(old)))).otherwise(c)


def rendering_check(whole: Column, prompt: Column) -> Column:
    """The 0-based place where a rendered conversation leaves its rendered prompt; null where the prompt is its beginning."""
    return F.when(~F.startswith(whole, prompt), first_divergence(whole, prompt))
