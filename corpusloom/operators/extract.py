"""Candidate strings from source files and pages, and the predicates that keep interface copy.

Everything is built-in expressions: match positions, and from them line numbers, are rebuilt from the text
between matches (``split``) and the matches (``regexp_extract_all``). Paths are matched as given, so give
paths relative to the scanned root: a folder above it named build or tests then rejects nothing. Lines end
at line feeds, for numbers and contexts alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import collapse, quoted_literal

#: What is scanned, and the patterns of candidates and of strings that are no copy.
EXTENSIONS = ("js", "jsx", "ts", "tsx", "vue", "svelte", "html", "json")
SKIPPED_FOLDERS = (".git", ".next", ".nuxt", "build", "coverage", "dist", "node_modules", "vendor")
MOST_BYTES, MOST_CONTEXT, WINDOW = 1_000_000, 2_000, 3
LITERAL = (
    r"""(aria-label|title|placeholder|label|alt|text|message|description)?\s*[:=]\s*(["'])"""
    r"""([A-Za-z](?:\\.|(?!\2)[^\n{}<>]){1,140})\2"""
)
TAG_TEXT = r">([A-Za-z][^<>{}\n]{2,140})<"
JSON_PAIR = r'"([A-Za-z0-9_.-]+)"\s*:\s*"([A-Za-z][^"\n]{1,140})"'
NOT_UI_PATH = (
    r"(?i)(\.test\.|\.spec\.|\.stories\.|__mocks__|/test/|/tests/|cypress|/e2e/|\.cy\."
    r"|mocks?\.tsx?$|fixtures|\.schemas?\.ts$|generated|schema\.json$)"
)
PRIMITIVES = (
    "string", "number", "boolean", "object", "array", "null", "any", "void", "integer", "float", "bigint", "symbol", "undefined",
    "unknown", "never",
)
#: Lines of code around a value.
BOUND_NAME, CONSTANT = r"""(?:^|[\s,{(\[])([A-Za-z_][A-Za-z0-9_]*)\s*[:=]\s*['"]""", "^[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+$"
TYPE_OF, COLOUR, NAME_KEY, MODULE = r"""['"]?type['"]?\s*:\s*['"]""", r"#[0-9a-fA-F]{3,8}\b", r"\bname\b\s*:", r"(?U)\([\w.\-]+\)\s*$"
CSS_CHARS, CSS_MARK = r"^[a-z0-9:\[\]/.%#-]+$", r"[-0-9:\[\]/.%#]"


def scannable(files: DataFrame, path: str = "path", length: str = "length") -> DataFrame:
    """Files of the extensions, outside the skipped folders, of a megabyte at most: tests on names and sizes
    only, so that they reach a binaryFile scan before any content is read."""
    folders = "|".join(f.replace(".", r"\.") for f in SKIPPED_FOLDERS)
    return files.where(
        F.col(path).rlike(rf"(?i)\.({'|'.join(EXTENSIONS)})$") & ~F.col(path).rlike(rf"(^|/)({folders})/") & (F.col(length) <= MOST_BYTES)
    )


def decoded(content: Column) -> Column:
    """UTF-8 text of bytes, invalid ones left out."""
    return F.replace(F.make_valid_utf8(content.cast("string")), F.lit("�"), F.lit(""))


def _newlines(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


HITS = "array<struct<source:int,value:string,prefix:string,line:int>>"


def _hits(found: Column, gaps: Column, pattern: str, value: int, prefix: int | None, source: int) -> Column:
    """array<struct<source, value, prefix, line>> of a pattern's matches and the texts between them. Value and prefix
    are read from each match, not from the text again; matches have no line feed after the value."""
    part = lambda m, k: F.regexp_extract(m, pattern, k)

    def step(acc: Column, x: Column) -> Column:
        line = acc["line"] + _newlines(x["gap"]) + _newlines(x["match"])
        name = part(x["match"], prefix) if prefix is not None else F.lit("")
        one = F.struct(F.lit(source).alias("source"), collapse(part(x["match"], value)).alias("value"), name.alias("prefix"), line.alias("line"))
        return F.struct(line.alias("line"), F.concat(acc["out"], F.array(one)).alias("out"))

    zipped = F.arrays_zip(found.alias("match"), F.slice(gaps, F.lit(1), F.size(found)).alias("gap"))
    return F.aggregate(zipped, F.struct(F.lit(1).alias("line"), F.array().cast(HITS).alias("out")), step, lambda a: a["out"])


def literals(files: DataFrame, path: str = "path", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(path, *keep, hits array<struct<source, value, prefix, line>>, lines), a row a file: literals (0) and tag texts
    (1), or the key and value pairs (2) of .json files. Each pattern runs over a text twice."""
    t, is_json = F.coalesce(F.col(text), F.lit("")), F.lower(path).endswith(".json")
    own = lambda pattern, of: (F.when(of, F.regexp_extract_all(t, F.lit(pattern), F.lit(0))), F.when(of, F.split(t, pattern, -1)))
    kinds = {"literal": (LITERAL, ~is_json), "tag": (TAG_TEXT, ~is_json), "pair": (JSON_PAIR, is_json)}
    parts = [c.alias(f"_{k}_{n}") for k, (pattern, of) in kinds.items() for n, c in zip(("found", "gaps"), own(pattern, of))]
    col = lambda k: (F.col(f"_{k}_found"), F.col(f"_{k}_gaps"))
    hits = F.when(is_json, _hits(*col("pair"), JSON_PAIR, 2, 1, 2)).otherwise(
        F.concat(_hits(*col("literal"), LITERAL, 3, 1, 0), _hits(*col("tag"), TAG_TEXT, 1, None, 1))
    )
    return files.select(path, *keep, F.split(t, "\n", -1).alias("lines"), *parts).select(path, *keep, hits.alias("hits"), "lines")


def interesting(v: Column) -> Column:
    return (
        F.length(v).between(3, 140) & v.rlike("[A-Za-z]") & ~v.rlike("^[A-Z0-9_./:-]+$")
        & ~(v.startswith("http://") | v.startswith("https://") | v.startswith("/") | v.startswith("./") | v.startswith("../"))
    )


def ui_path(path: Column) -> Column:
    return ~path.rlike(NOT_UI_PATH)


def ui_shape(v: Column) -> Column:
    """No underscore; several words, fewer than half of them like style classes; or one capitalised word."""
    words = F.split(collapse(v), " ")
    css = F.size(F.filter(words, lambda w: w.rlike(CSS_CHARS) & w.rlike(CSS_MARK)))
    several = F.size(words) >= 2
    return ~v.contains("_") & F.when(several, css / F.size(words) < 0.5).otherwise(collapse(v).rlike("^[A-Z][a-z]{2,}$"))


def constant_value(v: Column, line: Column) -> Column:
    """The line binds the value to a constant in capitals, or to a name that equals it."""
    key = F.call_function("regexp_extract", line, F.concat(F.lit(BOUND_NAME), quoted_literal(v), F.lit("['\"]")), F.lit(1))
    return (key != "") & (key.rlike(CONSTANT) | (F.lower(key) == F.lower(v)))


def type_annotation(v: Column, line: Column) -> Column:
    pattern = F.concat(F.lit(TYPE_OF), quoted_literal(v), F.lit("['\"]"))
    return F.lower(v).isin(*PRIMITIVES) & F.regexp_like(line, pattern)


def colour_map(line: Column) -> Column:
    return line.rlike(COLOUR) & line.rlike(NAME_KEY)


def module_path(v: Column) -> Column:
    return v.rlike(MODULE)


def not_ui(v: Column, line: Column) -> Column:
    return constant_value(v, line) | type_annotation(v, line) | colour_map(line) | module_path(v)


def ui_copy(v: Column, line: Column, path: Column) -> Column:
    """Cheap tests first."""
    return ui_path(path) & ui_shape(v) & ~not_ui(v, line)


def kind(prefix: Column, v: Column, path: Column) -> Column:
    low = F.lower(v)
    return (
        F.when(prefix.isin("aria-label", "alt"), "accessibility_label")
        .when(prefix == "placeholder", "form_label")
        .when(low.contains("error") | low.contains("invalid") | low.contains("failed"), "error")
        .when(F.lower(path).endswith(".json"), "i18n_string")
        .when(F.size(F.split(v, " ")) <= 4, "button_or_label")
        .otherwise("body_copy")
    )


def context(lines: Column, line: Column, window: int = WINDOW) -> Column:
    """Numbered lines around a line."""
    first = F.greatest(F.lit(1), line - window)
    part = F.slice(lines, first, F.least(F.size(lines), line + window) - first + 1)
    return F.array_join(F.transform(part, lambda x, k: F.concat((first + k).cast("string"), F.lit(": "), x)), "\n")


def candidates(files: DataFrame, path: str = "path", text: str = "text", keep: tuple[str, ...] = (), most: int | None = None) -> DataFrame:
    """(path, *keep, line, kind, current_copy, context) of all strings that pass the gates. Gates and contexts work inside
    a file's row, so that only what passes becomes a row, without the file's lines. ``most``: the first ones in the
    order of paths and, in a file, of patterns and places."""
    p, lines = F.col(path), F.col("lines")

    def passes(h: Column) -> Column:
        line = F.coalesce(F.try_element_at(lines, h["line"]), F.lit(""))
        return interesting(h["value"]) & ui_shape(h["value"]) & ~not_ui(h["value"], line)

    def row(h: Column) -> Column:
        around = context(lines, h["line"]).alias("context")
        return F.struct(h["line"].alias("line"), kind(h["prefix"], h["value"], p).alias("kind"), h["value"].alias("current_copy"), around)

    found = F.filter(F.transform(F.filter("hits", passes), row), lambda c: F.length(c["context"]) <= MOST_CONTEXT)
    # An outer explode: for a plain one a filter would be inferred that finds all matches once more.
    out = literals(files.where(ui_path(p)), path, text, keep).select(path, *keep, F.posexplode_outer(found).alias("_at", "c")).where("c IS NOT NULL")
    if most is not None:
        out = out.orderBy(path, "_at").limit(most)
    return out.select(path, *keep, "c.*")


def source_line(context_col: Column, line: Column) -> Column:
    """The line of a numbered context; '' if it is not there."""
    mark = F.concat(line.cast("string"), F.lit(": "))
    hit = F.filter(F.split(context_col, "\n"), lambda x: x.startswith(mark))
    return F.coalesce(F.substring(F.try_element_at(hit, F.lit(1)), F.length(mark) + 1, F.lit(1_000_000)), F.lit(""))


def plain_context(context_col: Column) -> Column:
    """A context without its line numbers."""
    return F.regexp_replace(context_col, r"(?m)^\d+: ", "")


def captured_whole(fragments: DataFrame, scanned: DataFrame, on: str = "path", fragment: str = "current_copy") -> DataFrame:
    """``fragments`` with captured: some string scanned in the same file goes on beyond the fragment."""
    longer = scanned.select(on, F.col("current_copy").alias("whole"))
    both = fragments.join(longer, on).where(F.col("whole").startswith(F.col(fragment)) & (F.col("whole") != F.col(fragment)))
    hits = both.select(*fragments.columns).distinct().withColumn("captured", F.lit(True))
    return fragments.join(hits, fragments.columns, "left").withColumn("captured", F.coalesce("captured", F.lit(False)))


#: Code instead of copy.
PLACEHOLDER, TERNARY = r"(?U)\{\{\s*[\w.]+\s*\}\}", r"\{[^{}]*\?[^{}]*:[^{}]*\}"
OPERATOR, TAG = "===|!==|=>", r"</?[a-zA-Z][^<>]*>"


def escape(c: Column) -> Column:
    """A suggestion that is code: a ternary, an operator, a tag, or one brace expression. {{ name }} is none."""
    s = F.trim(F.coalesce(c, F.lit("")))
    rest = F.regexp_replace(s, PLACEHOLDER, "")
    braces = s.startswith("{") & s.endswith("}") & ~s.rlike(r"^\{\{[^{}]*\}\}$")
    return (s != "") & (rest.rlike(TERNARY) | rest.rlike(OPERATOR) | rest.rlike(TAG) | braces)


def loose_escape(c: Column) -> Column:
    """The older predicate, which placeholders do not escape; its counts differ."""
    s = F.coalesce(c, F.lit(""))
    return s.rlike(r"\{[^}]*\?[^}]*:[^}]*\}") | s.rlike(OPERATOR) | s.rlike(r"</?[a-zA-Z][^>]*>") | (F.trim(s).startswith("{") & F.trim(s).endswith("}"))


def cut_at_apostrophe(copy: Column, context_col: Column) -> Column:
    """The context goes on with an apostrophe and a letter where the copy ends."""
    return F.regexp_like(F.coalesce(context_col, F.lit("")), F.concat(quoted_literal(collapse(copy)), F.lit("'[a-zA-Z]")))


def changed(current: Column, suggested: Column, exact: bool = False) -> Column:
    """An edit: not empty, no code, and different beyond white space (or, exact, at all)."""
    differs = (current != suggested) if exact else (collapse(current) != collapse(suggested))
    return differs & (collapse(suggested) != "") & ~escape(suggested)
