"""Secret scans with multipart credential linking.

Patterns that speak for themselves (keyword assignments, access identifiers, long hexadecimal runs) are always reported. Weaker
candidates are parts of credentials: identifiers (user names, client ids, short access ids), secrets (short or loosely named
values) and endpoints (addresses of services). Each part takes the interval ``reach`` code points around it within its scope, a block of
text without an empty line; in a record, a block whose lines are all keys with values or JSON, it takes the whole block. An interval join by sorted starts then finds which kinds of other parts begin in that interval. A weak
identifier needs a secret there, a weak secret an identifier or an endpoint, an endpoint both an identifier and a secret. Strong findings count as
parts too. Documents are rows, scopes never cross them, so the join runs where the text is read and nothing is shuffled.

Defined results: null and empty texts have no spans; a weak candidate that touches a strong span, or an earlier weak one, is part of
that and not reported by itself. Other columns are kept; one with the name of the result is replaced. Each row is handled by itself.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import extended

REACH = 200

# fixed values: the strong patterns, each with what must be long enough (group, length)
STRONG = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]+", 0, 16),
}
# fixed values: the weak patterns by the part of a credential that they may be
WEAK = {
    "identifier": r"""(?i:\b(?:user(?:_?name)?|login|account|client_?id|access_?(?:key_?)?id)\b["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@+-]{3,})|\bAKIA[A-Z0-9]{4,}|\b[A-Za-z0-9._+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+""",
    "secret": r"""(?i:\b(?:password|passwd|pwd|pass|secret|token|api_?key|auth|credential|private_?key)\b["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=!@#$%^&*-]{4,})""",
    "endpoint": r"""(?i:\b(?:https?|ftp|ssh|postgres(?:ql)?|mysql|mongodb|redis|amqp|jdbc:[a-z]+)://[^\s"'<>]+)|(?i:\b(?:host|endpoint|server)\b["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]+(?::[0-9]+)?)""",
}
KINDS = (*STRONG, *WEAK)
NEEDS = {"identifier": ({"secret"},), "secret": ({"identifier"}, {"endpoint"}), "endpoint": ({"identifier", "secret"},)}
PART = {"assign": "secret", "access": "identifier", "hex": "secret"}
_strong = {k: (re.compile(p, re.ASCII), g, n) for k, (p, g, n) in STRONG.items()}
_weak = {k: re.compile(p, re.ASCII) for k, p in WEAK.items()}
_scope_end = re.compile(r"\n[ \t\r]*\n")
# a line of a record: brackets alone, a key and what follows it, or a quoted value of a list
_record_line = re.compile(r"""[{}\[\], \t]++|(?:[{\[][ \t]*+)*+["']?[A-Za-z_][\w.-]*+["']?[ \t]*+[:=].*+|["'][^"']*+["'],?""", re.ASCII)

Span = tuple[int, int, int]   # start, end, number of the kind


def strong_spans(text: str) -> list[Span]:
    return sorted((*m.span(), KINDS.index(kind)) for kind, (pattern, group, least) in _strong.items() for m in pattern.finditer(text)
                  if m.end(group) - m.start(group) >= least)


def is_record(block: str) -> bool:
    """Whether a block holds keys with values or JSON: several such lines and no others, or one that opens with a bracket."""
    lines = [line for line in (x.strip(" \t\r") for x in block.split("\n")) if line]
    return (len(lines) > 1 or bool(lines) and lines[0][0] in "{[") and all(map(_record_line.fullmatch, lines))


def spans_of(text: str, reach: int = REACH) -> list[Span]:
    """Strong spans, and the weak ones that complementary parts confirm."""
    strong = strong_spans(text)
    weak = sorted((*m.span(), KINDS.index(kind)) for kind, pattern in _weak.items() for m in pattern.finditer(text))
    if not weak:
        return strong
    taken, free = sorted((a, b) for a, b, _ in strong), []
    starts, far = [a for a, _ in taken], []
    for _, b in taken:
        far.append(max(b, far[-1] if far else 0))
    last = 0
    for a, b, k in weak:
        before = bisect_left(starts, b)       # strong spans that begin before this one ends
        if a >= last and not (before and far[before - 1] > a):
            free.append((a, b, k))
            last = b
    ends = [m.start() for m in _scope_end.finditer(text)]
    where: dict[str, list[int]] = {p: [] for p in WEAK}
    for a, _, k in sorted(strong + free):
        where[PART.get(KINDS[k], KINDS[k])].append(a)
    out, records = list(strong), {}
    for a, b, k in free:
        scope = bisect_left(ends, a)
        low, high = ends[scope - 1] if scope else 0, ends[scope] if scope < len(ends) else len(text)
        if scope not in records:
            records[scope] = is_record(text[low:high])
        if not records[scope]:
            low, high = max(a - reach, low), min(b + reach, high)
        near = {p for p, s in where.items() if bisect_left(s, high) > bisect_left(s, low) and p != KINDS[k]}
        if any(need <= near for need in NEEDS[KINDS[k]]):
            out.append((a, b, k))
    return sorted(out)


def with_spans(df: DataFrame, text: str = "text", out: str = "spans", reach: int = REACH) -> DataFrame:
    """Adds an array of ``start, finish, kind`` in code points, finish exclusive, by start and then kind."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("finish", pa.int64()), ("kind", pa.string())]))

    def of(texts: list[bytes]):
        return ([[{"start": a, "finish": b, "kind": KINDS[k]} for a, b, k in sorted(spans_of(t.decode(), reach), key=itemgetter(0, 2, 1))] for t in texts],)

    return extended(df, text, lambda: of, [(out, "array<struct<start:long,finish:long,kind:string>>", kind)])


def redact(df: DataFrame, text: str = "text", reach: int = REACH, mark: str = "[secret]") -> DataFrame:
    """The same rows with each stretch of secrets in the text replaced by a mark; texts without any, and nulls, stay as they are."""
    def of(texts: list[bytes]):
        out = []
        for t in map(bytes.decode, texts):
            parts, at = [], 0
            for a, b, _ in spans_of(t, reach):
                if a > at or not parts:
                    parts += [t[at:a], mark]
                at = max(at, b)
            out.append("".join(parts) + t[at:] if parts else t)
        return (out,)

    out = extended(df, text, lambda: of, [("__redacted", "string", pa.string())])
    return out.select(*[F.when(F.col(text).isNotNull(), F.col("__redacted")).alias(text) if c == text else F.col(c) for c in df.columns])


def listed(spans):
    """``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["finish"].cast("string"))), ",")
