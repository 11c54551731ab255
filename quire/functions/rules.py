"""Custom cleaning rules: regular expressions applied in the order of their priority."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    replacement: str = ""
    enabled: bool = True
    priority: int = 100


# The rules that come with the engine, by name, pattern, replacement, whether on, and priority.
RULES = [
    Rule("remove_extra_whitespace", r"[ \t]+", " ", True, 1),
    Rule("remove_control_chars", r"[\x00-\x08\x0b-\x0c\x0e-\x1f\x7f]", "", True, 2),
    Rule("normalize_newlines", r"\r\n|\r", r"\n", True, 3),
    Rule("remove_page_numbers", r"^\s*\d+\s*$", "", True, 10),
    Rule("remove_page_headers", r"第\s*\d+\s*页\s*/\s*共\s*\d+\s*页", "", True, 11),
    Rule("remove_url", r"https?://[^\s]+", "", False, 20),
    Rule("remove_email", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "", False, 21),
    Rule("remove_figure_captions", r"图\s*\d+[\-\.]?\d*", "", False, 30),
    Rule("remove_table_captions", r"表\s*\d+[\-\.]?\d*", "", False, 31),
]
GROUPS = {
    "basic": ("remove_extra_whitespace", "remove_control_chars", "normalize_newlines"),
    "document": ("remove_page_numbers", "remove_page_headers"),
    "privacy": ("remove_url", "remove_email"),
}
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def java_replacement(template: str) -> str:
    """A replacement with \\1 and \\n as Java's, which has $1 and takes \\n for n."""
    out = template.replace("$", r"\$")
    out = re.sub(r"\\([ntr])", lambda m: ESCAPES[m[1]], out)
    return re.sub(r"\\(\d)", r"$\1", out)


def apply_rules(c: Column, rules: list[Rule] = RULES, only: set[str] | None = None) -> Column:
    """c after the enabled rules, least priority first, ties in the order given; `only` switches on just the named ones.

    A rule without a pattern is skipped.
    """
    for rule in sorted(rules, key=lambda r: r.priority):
        if rule.pattern and (rule.name in only if only is not None else rule.enabled):
            c = F.regexp_replace(c, rule.pattern, java_replacement(rule.replacement))
    return c
