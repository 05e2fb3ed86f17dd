"""SQL snippets for the checks: numbers and sentences as DuckDB writes them."""

from __future__ import annotations

import re


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def say(template: str, **parts: str) -> str:
    pieces = re.split(r"\{(\w+)\}", template)
    out = [quote(p) if i % 2 == 0 else f"CAST({parts[p]} AS VARCHAR)" for i, p in enumerate(pieces) if i % 2 or p]
    return "(" + " || ".join(out) + ")"


def general(x: str) -> str:
    return f"printf('%g', {x})"


def mm(x: str) -> str:
    return f"printf('%g', CAST(printf('%.3g', {x}) AS DOUBLE))"


def mpa(x: str) -> str:
    return f"(CASE WHEN {x} >= 100 THEN printf('%.0f', {x}) ELSE printf('%.1f', {x}) END)"


def dec(x: str, n: int) -> str:
    return f"printf('%.{n}f', {x})"


def grouped(x: str) -> str:
    return f"format('{{:,.0f}}', {x})"


def stem(x: str) -> str:
    name = f"regexp_replace(regexp_replace({x}, '[/\\\\]+$', ''), '^.*[/\\\\]', '')"
    return f"regexp_replace({name}, '^(.+)\\.[^.]*$', '\\1')"


def hint(x: str) -> str:
    s = f"lower({stem(x)})"
    return (f"(CASE WHEN regexp_matches({s}, '(^|[^a-z])(section|sect|cut|cross)') THEN 'section' "
            f"WHEN regexp_matches({s}, '(^|[^a-z])(detail|zoom|close|hot[-_ ]?spot|local|enlarg)') THEN 'detail' END)")


def in_list(values) -> str:
    return "(" + ", ".join(quote(v) for v in values) + ")"
