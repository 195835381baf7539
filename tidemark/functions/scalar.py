"""Scalar expressions: keys, breadcrumbs, guards and small parsers, all inside codegen."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_FILE_BYTES = 5_000_000
MAX_AST_BYTES = 2_000_000
LANGUAGES = {"py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "rs": "rust", "rb": "ruby", "java": "java"}


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def chunk_key(natural_key: Column, index: Column, trail: Column) -> Column:
    """A chunk's key: stable while the file, the ordinal and the symbol trail stay."""
    return F.sha2(F.concat_ws("|", natural_key, index.cast("string"), F.coalesce(trail, F.lit(""))), 256)


def natural_key(kind: str, *parts: Column) -> Column:
    """"repo:<source id>:<path>", "jira:<key>" or "drive:<id>"."""
    return F.concat_ws(":", F.lit(kind), *parts)


def breadcrumb(prefix: Column, trail: Column) -> Column:
    """"prefix > trail" with white space in the trail squeezed; the prefix alone without a trail."""
    return F.when(F.coalesce(trail, F.lit("")) == "", prefix).otherwise(F.concat(prefix, F.lit(" > "), F.regexp_replace(trail, r"\s+", " ")))


def with_breadcrumb(crumb: Column, text: Column) -> Column:
    """What gets embedded: the breadcrumb, a blank line and the text."""
    return F.when(F.coalesce(crumb, F.lit("")) == "", text).otherwise(F.concat(crumb, F.lit("\n\n"), text))


def normalise_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def is_blank(text: Column) -> Column:
    """Only Unicode white space, or nothing."""
    return text.rlike(r"^[\p{IsWhite_Space}]*$")


def brace_delta(line: Column) -> Column:
    """Opening minus closing braces."""
    count = lambda c: F.length(line) - F.length(F.replace(line, F.lit(c), F.lit("")))
    return count("{") - count("}")


def language(path: Column) -> Column:
    """Language by extension, null if unknown; a name that is all extension (".py") has none."""
    extension = F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)
    known = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.element_at(known, extension)


def retry_after(header: Column) -> Column:
    """Seconds to wait: the header if it is a positive integer, else 60."""
    seconds = F.regexp_extract(F.coalesce(header, F.lit("")), r"^([+]?\d+)$", 1).try_cast("int")
    return F.when(seconds > 0, seconds).otherwise(60)


def is_binary(content: Column) -> Column:
    """Bytes that hold a NUL or aren't UTF-8; content is a binary column."""
    return F.coalesce((F.locate("\x00", content.cast("string")) > 0) | ~F.is_valid_utf8(content.cast("string")), F.lit(False))


def preflight(language_: Column, content: Column) -> Column:
    """Why content isn't parsed, cheapest check first: unsupported_language, too_large, binary; or null."""
    return (
        F.when(language_.isNull() | ~language_.isin(*sorted(set(LANGUAGES.values()))), "unsupported_language")
        .when(F.octet_length(content) > MAX_AST_BYTES, "too_large")
        .when(is_binary(content.cast("binary")), "binary")
    )


def fallback(reason: Column, final_attempt: Column) -> Column:
    """What follows a refused or failed parse: ok, heuristic_fallback, skip, crashed_fallback, retry."""
    return (
        F.when(reason.isNull(), "ok")
        .when(reason == "unsupported_language", "heuristic_fallback")
        .when(reason.isin("too_large", "binary"), "skip")
        .when(final_attempt, "crashed_fallback")
        .otherwise("retry")
    )


def like_escape(text: Column) -> Column:
    """Text with LIKE's own characters escaped by a backslash."""
    return F.regexp_replace(text, r"([%_\\])", r"\\$1")


def error_body(text: Column) -> Column:
    """What an error message shows of a response."""
    return F.substring(text, 1, 200)


def clamp_top_k(value: object) -> int:
    """A result size: integers from 1 up to 100, 20 for anything else."""
    return min(value, 100) if isinstance(value, int) and not isinstance(value, bool) and value >= 1 else 20


_SCHEMES = ("https://", "http://", "ssh://", "git://", "file://")


def valid_ref(ref: object) -> bool:
    """A revision that no tool could take for an option."""
    return isinstance(ref, str) and re.fullmatch(r"[0-9A-Za-z][\w./-]*", ref, re.ASCII) is not None


def valid_path(path: object) -> bool:
    """A relative path that stays inside its repository."""
    if not isinstance(path, str) or path.startswith("/") or "\0" in path:
        return False
    depth = 0
    for part in path.split("/"):
        depth += -1 if part == ".." else 0 if part in ("", ".") else 1
        if depth < 0:
            return False
    return True


def valid_url(url: object) -> bool:
    """A clone URL with a known transport; transport helpers ("::") and options are refused."""
    if not isinstance(url, str) or url.startswith("-") or "::" in url:
        return False
    return url.startswith(_SCHEMES) or re.match(r"[\w.-]+@[\w.-]+:", url) is not None


def java_regex(pattern: str) -> str:
    """A POSIX basic regular expression as a Java one: there, bare ( ) { } | + ? are literal and
    their escaped forms are operators."""
    out, i, in_set = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if in_set:
            if pattern.startswith("[:", i) and ":]" in pattern[i:]:
                end = pattern.index(":]", i)
                name = pattern[i + 2 : end]
                out.append({"alpha": r"\p{Alpha}", "digit": r"\p{Digit}", "alnum": r"\p{Alnum}", "space": r"\s", "upper": r"\p{Upper}", "lower": r"\p{Lower}", "punct": r"\p{Punct}", "xdigit": r"\p{XDigit}", "blank": r"\p{Blank}", "cntrl": r"\p{Cntrl}", "print": r"\p{Print}", "graph": r"\p{Graph}"}.get(name, ""))
                i = end + 2
                continue
            out.append("\\" + c if c in "\\[&" else c)
            in_set = c != "]"
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            n = pattern[i]
            out.append(n if n in "(){}|+?" else {"<": r"\b", ">": r"\b"}.get(n, "\\" + n))
        elif c == "[":
            in_set = True
            out.append(c)
            if pattern[i + 1 : i + 2] == "^":
                out.append("^")
                i += 1
            if pattern[i + 1 : i + 2] == "]":
                out.append("\\]")
                i += 1
        elif c in "(){}|+?" or (c == "*" and (i == 0 or pattern[i - 2 : i] == "\\(" or (i == 1 and pattern[0] == "^"))):
            out.append("\\" + c)
        else:
            out.append(c)
        i += 1
    return "".join(out)
