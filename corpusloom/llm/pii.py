"""Personal data by anchor expansion.

One Aho-Corasick pass per text finds the anchors: at-signs, plus signs, digits, URL schemes' ``://`` and
identifier cues. At each anchor a deterministic local parser expands to the left and right and validates
the candidate. The spans equal a leftmost, non-overlapping scan per kind in which failing candidates are
dropped without a retry. A text without anchors costs the automaton's pass and nothing else.

Defined results: null and empty texts have no spans; spans that start together are listed in the order of kinds; repeated rows give repeated results; an empty table
gives an empty result; only the id and text columns are read, so other columns cannot clash. Offsets are
code points, ends exclusive, over whole texts of any length.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.arrow import map_rows

#: Kinds in the order in which equal starts are listed; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "url", "account", "ssn")
BASE_KINDS = KINDS[:4]
SCHEMES = ("https", "http", "ftp", "ssh", "postgres", "postgresql", "mysql", "mongodb", "redis", "amqp")
ACCOUNT_CUES = ("account", "Account", "ACCOUNT", "acct", "Acct", "ACCT", "iban", "Iban", "IBAN")
SSN_CUES = ("ssn", "Ssn", "SSN")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
QUAD = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
USERINFO = re.compile(r"://[^\x20\x09-\x0D/@:]+:[^\x20\x09-\x0D/@]+@[A-Za-z0-9.-]+")
ACCOUNT = re.compile(rf"(?:{'|'.join(ACCOUNT_CUES)})(?: (?:no|number))?[.]? ?[:#=] ?[A-Za-z0-9]{{8,34}}")
SSN = re.compile(rf"(?:{'|'.join(SSN_CUES)}) ?[:#=]? ?[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in text.split("."))


def finder() -> Callable[[str], list[tuple[int, int, int]]]:
    """A function from a text to its sorted spans (start, rank of the kind, end)."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for c in "0123456789":
        automaton.add_word(c, (0, 1))
    automaton.add_word("@", (1, 1))
    automaton.add_word("+", (2, 1))
    automaton.add_word("://", (3, 3))
    for cue in ACCOUNT_CUES:
        automaton.add_word(cue, (4, len(cue)))
    for cue in SSN_CUES:
        automaton.add_word(cue, (5, len(cue)))
    automaton.make_automaton()

    def find(text: str) -> list[tuple[int, int, int]]:
        spans: list[tuple[int, int, int]] = []
        email_end = quad_from = card_from = url_end = account_end = ssn_end = 0
        for last, (what, size) in automaton.iter(text):
            at = last + 1 - size
            if what == 0:
                if at >= quad_from:
                    m = QUAD.match(text, at)
                    if m is None:
                        # No start inside this dotted chain has four parts left.
                        quad_from = DOTTED.match(text, at).end()
                    else:
                        quad_from = m.end()
                        if octets(m[0]):
                            spans.append((at, 1, m.end()))
                if at >= card_from:
                    m = CARD.match(text, at)
                    card_from = m.end() if m else at + 1
                    if m and m.end() - at >= 12 and 12 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
                        spans.append((at, 2, m.end()))
            elif what == 1:
                start = at
                while start > email_end and text[start - 1] in LOCAL:
                    start -= 1
                if start < at and (m := DOMAIN.match(text, at + 1)):
                    email_end = m.end()
                    spans.append((start, 0, email_end))
            elif what == 2:
                if (m := PHONE.match(text, at)) and 9 <= len(digits_of(m[0])) <= 15:
                    spans.append((at, 3, m.end()))
            elif what == 3:
                lead = max((len(s) for s in SCHEMES if text.endswith(s, max(url_end, at - len(s)), at)), default=0)
                if lead and (m := USERINFO.match(text, at)):
                    url_end = m.end()
                    spans.append((at - lead, 4, url_end))
            elif what == 4:
                if at >= account_end and (m := ACCOUNT.match(text, at)):
                    account_end = m.end()
                    spans.append((at, 5, account_end))
            elif at >= ssn_end and (m := SSN.match(text, at)):
                ssn_end = m.end()
                spans.append((at, 6, ssn_end))
        spans.sort()
        return spans

    return find


def _rows():
    find = finder()

    def work(ids: list, texts: list):
        for i, text in zip(ids, texts, strict=True):
            yield i, [{"start": s, "end": e, "kind": KINDS[k]} for s, k, e in (find(text) if text else ())]

    return work


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, spans array<struct<start, end, kind>>): a map without a shuffle; spans in order."""
    kind = dict(df.dtypes)[id_col]
    return map_rows(
        df.select(id_col, text_col), _rows, f"{id_col} {kind}, spans array<struct<start:bigint,end:bigint,kind:string>>"
    )


def _masked():
    find = finder()

    def mask(text: str) -> str:
        out, at = [], 0
        for start, kind, end in find(text):
            if start >= at:
                out += [text[at:start], f"<{KINDS[kind].upper()}>"]
            at = max(at, end)
        return "".join([*out, text[at:]])

    def work(*columns: list):
        *rest, texts = columns
        for row, text in zip(zip(*rest, strict=True), texts, strict=True):
            yield (*row, mask(text) if text else text)

    return work


def mask_pii(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The same columns, every span of ``text_col`` replaced by its kind, as in <EMAIL>. Spans that overlap
    an earlier one are covered by it. Null stays null."""
    names = [c for c in df.columns if c != text_col]
    schema = ", ".join(f"`{c}` {t}" for c, t in [(c, dict(df.dtypes)[c]) for c in [*names, text_col]])
    return map_rows(df.select(*[F.col(f"`{c}`") for c in [*names, text_col]]), _masked, schema).select(
        *[F.col(f"`{c}`") for c in df.columns]
    )
