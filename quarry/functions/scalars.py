"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .extract import DOCUMENT_LANGUAGES, LANGUAGES

# --- fixed values: the first port and the number of ports
BASE_PORT, PORTS = 7842, 2000
# --- end of fixed values

_SPACES = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units, as ECMAScript counts."""
    return F.when(F.octet_length(c) == F.length(c), F.length(c)).otherwise((F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int"))


def estimate_tokens(c: Column) -> Column:
    """A quarter of the length, rounded up; 0 for empty or null."""
    return F.coalesce(F.ceil(utf16_length(c) / 4), F.lit(0)).cast("long")


def js_round(c: Column) -> Column:
    """Round half toward positive infinity."""
    return F.floor(c + F.lit(0.5))


def content_hash(c: Column) -> Column:
    return F.md5(c)


def collapse_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, _SPACES, " "))


def signature_hash(c: Column) -> Column:
    return F.substring(F.md5(collapse_spaces(c)), 1, 8)


def project_hash(path: Column) -> Column:
    return F.substring(F.sha2(path, 256), 1, 8)


def project_port(hash_: Column) -> Column:
    return (F.lit(BASE_PORT) + F.conv(F.substring(hash_, 1, 4), 16, 10).cast("int") % PORTS).cast("int")


def language_of(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(F.substring_index(path, ".", -1))), F.lit("unknown"))


def is_document_language(c: Column) -> Column:
    return c.isin(*DOCUMENT_LANGUAGES)


def forward_slashes(c: Column) -> Column:
    return F.replace(c, F.lit("\\"), F.lit("/"))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """The folder of a path, "." if there is none."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def join_path(folder: Column, rest: Column) -> Column:
    """folder/rest with "." and ".." resolved; steps above the root stay as "..". """
    parts = F.split(F.concat_ws("/", folder, rest), "/")

    def step(acc, x):
        up = (F.size(acc) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), acc), -1) != "..")
        return (
            F.when((x == ".") | (x == ""), acc)
            .when((x == "..") & up, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
            .otherwise(F.concat(acc, F.array(x)))
        )

    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def preview(c: Column, units: int = 200) -> Column:
    """Trimmed text, cut to ``units`` characters with an ellipsis."""
    t = F.regexp_replace(F.regexp_replace(c, "^" + _SPACES, ""), _SPACES + "$", "")
    return F.when(F.length(t) <= units, t).otherwise(F.concat(F.substring(t, 1, units), F.lit("…")))


def route_parts(name: Column, signature: Column) -> tuple[Column, Column]:
    """(method, path) of a route: its name split at the first space; without one, the name and the signature."""
    at = F.instr(name, " ")
    return F.when(at > 0, F.substring(name, F.lit(1), at - 1)).otherwise(name), F.when(at > 0, F.substring(name, at + 1, F.length(name))).otherwise(signature)


def line_slice(text: Column, start: Column, count: int) -> Column:
    """So many lines of a text from the 1-based line start."""
    return F.array_join(F.slice(F.split(text, "\n"), start, count), "\n")


def percent(part: Column, whole: Column) -> Column:
    """part of whole in percent with one decimal, 0 where whole is 0."""
    return F.when(whole > 0, js_round(part / whole * 1000) / 10).otherwise(F.lit(0.0))


def short_number(c: Column, millions: bool = True) -> Column:
    """Thousands as K and millions as M with one decimal; without ``millions`` these are thousands too."""
    v = c.cast("double")
    small = F.when(v >= 1e3, F.format_string("%.1fK", v / 1e3)).otherwise(c.cast("string"))
    return F.when(v >= 1e6, F.format_string("%.1fM", v / 1e6)).otherwise(small) if millions else small


def duration_text(begin: Column, end: Column) -> Column:
    """Minutes between two times, hours with one decimal from sixty on; null unless end is later."""
    ms = F.unix_millis(end) - F.unix_millis(begin)
    m = js_round(ms / 60_000)
    gap = "\u202f"
    return F.when(
        ms > 0, F.when(m < 1, F.lit(f"<1{gap}min")).when(m < 60, F.concat(m.cast("string"), F.lit(f"{gap}min"))).otherwise(F.concat(F.format_string("%.1f", m / 60), F.lit(f"{gap}h")))
    )
