"""Scalar text functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a word of two letters or more, with inner apostrophes and hyphens.
WORD = "[A-Za-z][A-Za-z'-]+"
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def collapse(c: Column) -> Column:
    """White space runs become one space, ends are trimmed; null becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def words(c: Column) -> Column:
    """Lower-cased words of two letters or more."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(f"({WORD})"), F.lit(1))


def phrases(word_array: Column, n: int = 14) -> Column:
    """array<string> of n-word phrases; shorter texts have none."""
    last = F.size(word_array) - (n - 1)
    return F.when(
        last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.concat_ws(" ", F.slice(word_array, i, n)))
    ).otherwise(F.array().cast("array<string>"))


def estimated_tokens(c: Column) -> Column:
    """A quarter of the code points, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(c, F.lit(""))) / 4)).cast("long")


def stable_id(*parts: Column) -> Column:
    """UUID version 5 of the parts joined by '::' in the URL namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(F.concat_ws("::", *parts), "UTF-8")))
    # The variant's two bits: 8, 9, a or b by the low bits of the digit.
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def html_escaped(c: Column) -> Column:
    out = c
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(plain), F.lit(entity))
    return out


def ellipsis(c: Column, most: int = 2400) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("…"))).otherwise(c)


def after_thinking(c: Column) -> Column:
    """The answer: what follows the last </think>."""
    return F.trim(F.substring_index(c, "</think>", -1))


def thinking(c: Column) -> Column:
    """What stands before the last </think>, without its opening tag; '' if there is none."""
    at = F.length(c) - F.length(F.substring_index(c, "</think>", -1)) - len("</think>")
    return F.when(c.contains("</think>"), F.trim(F.replace(F.substring(c, F.lit(1), at), F.lit("<think>"), F.lit("")))).otherwise("")


def finished_answer(c: Column) -> Column:
    """'' where thinking was begun and never ended."""
    return F.when(c.contains("<think>") & ~c.contains("</think>"), "").otherwise(after_thinking(c))


def labelled_line(c: Column, label: str = "Current copy:") -> Column:
    """Text after the first label up to the end of its line, trimmed; '' without the label."""
    at = F.locate(label, c)
    return F.when(at > 0, F.trim(F.substring_index(F.substring(c, at + len(label), F.length(c)), "\n", 1))).otherwise("")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def quoted_literal(c: Column) -> Column:
    """A regular expression that matches the text itself."""
    return F.concat(F.lit(r"\Q"), F.replace(c, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def flat_content(parts: Column, plain: Column | None = None) -> Column:
    """Text of message parts array<struct<type, text>>, joined by spaces; ``plain`` where the content is a string."""
    joined = F.array_join(F.transform(F.filter(parts, lambda p: p["text"].isNotNull()), lambda p: p["text"]), " ")
    return joined if plain is None else F.coalesce(plain, joined, F.lit(""))


def wilson(x: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Low and high end of the Wilson score interval of x in n; null for n = 0."""
    share, zz = x / F.nullif(n, F.lit(0)), F.lit(z * z)
    centre = (share + zz / (2 * n)) / (1 + zz / n)
    half = F.lit(z) / (1 + zz / n) * F.sqrt(share * (1 - share) / n + zz / (4 * n * n))
    return centre - half, centre + half
