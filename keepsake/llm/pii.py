"""PII (4): an Aho-Corasick automaton finds anchors, local parsers expand them to spans.

Anchors are the at-sign, the plus sign, digits, dots before digits, ``://`` and cue words of bank
account and social security numbers. From an anchor a parser walks to the boundaries its kind allows and
validates what it holds: parts of an address up to 255, the Luhn sum of a card number, the digits of a
phone number, the mod-97 sum of an IBAN. Base spans equal those of a leftmost, non-overlapping search for
the kind's pattern: each parser remembers where its last match ended, a match that fails validation is
consumed too, and nothing is tried again inside it.

The method adds kinds that a pattern can't judge: ``login`` (``user:secret@`` after a scheme), ``iban``
after a cue and with a right sum, ``ssn`` after a cue. Offsets count code points, ends are exclusive.

Defined results: a null text counts as empty; a text without spans has zero counts, the digest of the
empty string and an empty list; an empty table gives an empty result; other columns stay out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import table

BASE = ("email", "ip", "card", "phone")
ADDED = ("login", "iban", "ssn")
KINDS = BASE + ADDED
RANK = {k: i for i, k in enumerate(KINDS)}
Span = tuple[int, int, str]

DIGITS = frozenset("0123456789")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
LABEL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-")
PHONE = frozenset(" ().0123456789-")
UPPER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
SECRET = LABEL | frozenset("._~!$&'()*+,;=%:")
#: Cue words, looked for in lower case with no letter or digit before or after them.
CUES = {"iban": "iban", "ssn": "ssn", "social security number": "ssn"}


@cache
def _anchors() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for c in "0123456789":
        out.add_word(c, ("card", 1))
        out.add_word("." + c, ("ip", 2))
    out.add_word("@", ("email", 1))
    out.add_word("+", ("phone", 1))
    out.add_word("://", ("login", 3))
    for cue, kind in CUES.items():
        for form in {cue, cue.upper(), cue.title(), cue.capitalize()}:
            out.add_word(form, (kind, len(form)))
    out.make_automaton()
    return out


def _run(text: str, at: int, chars: frozenset) -> int:
    """The end of the run of chars from at on."""
    n = len(text)
    while at < n and text[at] in chars:
        at += 1
    return at


def _luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0


def _email(text: str, at: int, free: int) -> tuple[int, int, bool] | None:
    start = at
    while start > free and text[start - 1] in LOCAL:
        start -= 1
    end = _run(text, at + 1, LABEL)
    if start == at or end == at + 1:
        return None
    first = end
    while end < len(text) and text[end] == "." and (more := _run(text, end + 1, LABEL)) > end + 1:
        end = more
    return (start, end, True) if end > first else None


def _ip(text: str, at: int, free: int) -> tuple[int, int, bool] | None:
    """at: a dot before a digit, the first dot of the match if there is one."""
    start = at
    while start > free and text[start - 1] in DIGITS:
        start -= 1
    if start == at:
        return None
    parts, end = [text[start:at]], at
    while len(parts) < 4 and end < len(text) and text[end] == "." and (more := _run(text, end + 1, DIGITS)) > end + 1:
        parts.append(text[end + 1 : more])
        end = more
    return (start, end, all(int(p) <= 255 if len(p) < 9 else not p.strip("0") or int(p.lstrip("0")[:4]) <= 255 and len(p.lstrip("0")) < 4 for p in parts)) if len(parts) == 4 else None


def _card(text: str, at: int, free: int) -> tuple[int, int, bool] | None:
    end, n = at + 1, len(text)
    while end < n:
        if text[end] in DIGITS:
            end += 1
        elif text[end] in " -" and end + 1 < n and text[end + 1] in DIGITS:
            end += 2
        else:
            break
    if end == at + 1:
        return None
    digits = text[at:end].replace(" ", "").replace("-", "")
    return at, end, 14 <= len(digits) <= 19 and _luhn(digits)


def _phone(text: str, at: int, free: int) -> tuple[int, int, bool] | None:
    if at + 1 >= len(text) or text[at + 1] not in DIGITS:
        return None
    end = _run(text, at + 2, PHONE)
    while end > at + 3 and text[end - 1] not in DIGITS:
        end -= 1
    if end <= at + 3:
        return None
    return at, end, 10 <= sum(c in DIGITS for c in text[at:end]) <= 15


def _login(text: str, at: int, free: int) -> tuple[int, int, bool] | None:
    """at: the colon of ``://``."""
    end = _run(text, at + 3, SECRET)
    who = text[at + 3 : end]
    good = end < len(text) and text[end] == "@" and 0 < who.find(":") < len(who) - 1
    return (at + 3, end, True) if good else None


def _after_cue(text: str, at: int) -> int:
    """Where the identifier begins: after blanks, one of ``:#=`` and blanks, or a short word as in ``SSN is``."""
    while at < len(text) and text[at] in " \t":
        at += 1
    for link in ("number", "no.", "is"):
        if text.startswith(link, at):
            at += len(link)
            break
    while at < len(text) and text[at] in " \t:#=":
        at += 1
    return at


def _iban(text: str, at: int, free: int) -> tuple[int, int, bool] | None:
    start = _after_cue(text, at)
    end, kept = start, []
    while end < len(text) and (text[end] in UPPER or text[end] == " " and end + 1 < len(text) and text[end + 1] in UPPER):
        if text[end] != " ":
            kept.append(text[end])
        end += 1
        if len(kept) > 34:
            return None
    code = "".join(kept)
    if not re.fullmatch("[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", code) or _touched(text, end):
        return None
    return start, end, int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _ssn(text: str, at: int, free: int) -> tuple[int, int, bool] | None:
    start = _after_cue(text, at)
    m = re.compile("([0-9]{3})[- ]([0-9]{2})[- ]([0-9]{4})").match(text, start)
    if not m or _touched(text, m.end()):
        return None
    return start, m.end(), m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000"


def _touched(text: str, at: int) -> bool:
    return 0 <= at < len(text) and text[at].isalnum()


PARSERS = {"email": _email, "ip": _ip, "card": _card, "phone": _phone, "login": _login, "iban": _iban, "ssn": _ssn}


def spans(text: str | None) -> list[Span]:
    """(start, end, kind) of all spans, by start and then as KINDS lists the kinds."""
    out: list[Span] = []
    free = dict.fromkeys(KINDS, 0)
    for last, (kind, n) in _anchors().iter(text) if text else ():
        at = last - n + 1
        if at < free[kind]:
            continue
        if kind in ("iban", "ssn"):
            if _touched(text, at - 1) or _touched(text, last + 1):
                continue
            at = last + 1
        if found := PARSERS[kind](text, at, free[kind]):
            start, free[kind], good = found
            if good:
                out.append((start, free[kind], kind))
    return sorted(out, key=lambda s: (s[0], RANK[s[2]], s[1]))


def joined(found: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in found)


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: id, spans array of (start, end, kind, value)."""

    def batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[{"start": s, "end": e, "kind": k, "value": t[s:e]} for s, e, k in spans(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind_of)], names=[key, "spans"])

    kind_of = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("value", pa.string())]))
    return docs.select(key, text).mapInArrow(batch, f"`{key}` {docs.schema[key].dataType.simpleString()}, spans array<struct<start:int,end:int,kind:string,value:string>>")


def op4_pii(spark, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, BASE), F.sha2(F.concat_ws(",", F.transform(base, line)), 256).alias("base_sha256"), F.concat_ws(",", F.transform("spans", line)).alias("spans"))
