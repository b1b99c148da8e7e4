"""Small values: metadata maps, JSON fields, vectors as text, dates and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# First folders and root names that tell a document's type, and the shape of field declarations.
DOC_TYPES = {
    "api": "api", "apis": "api", "reference": "api", "ref": "api", "modules": "module", "module": "module", "guides": "guide", "guide": "guide",
    "tutorials": "guide", "tutorial": "guide", "howto": "guide", "how-to": "guide", "overview": "overview",
}
OVERVIEW_STEMS = ("readme", "index", "overview", "introduction", "intro", "main")
GO_FIELD = r"^\s*[A-Za-z_]\w*\s+([^/\n]+?)(?:\s+`|$)"
COLON_FIELD = r":\s*([^=#\n]+?)\s*(?:=|$)"

#: Namespace of names that are URLs (RFC 4122).
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def literal_map(table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))


def doc_type(path: Column) -> Column:
    """overview, module, api or guide, by the first folder, or by the name of a file without one."""
    parts = F.split(path, "/")
    stem = F.lower(F.regexp_replace(path, r"(?<=.)\.[^.]*$", ""))
    of_root = F.when(stem.isin(*OVERVIEW_STEMS), "overview").otherwise("guide")
    return F.when(F.size(parts) == 1, of_root).otherwise(F.coalesce(literal_map(DOC_TYPES)[F.lower(parts[0])], F.lit("guide")))


def field_type(signature: Column, language: Column) -> Column:
    """The type in a field's declaration, null if it has none or the language isn't known."""
    found = F.when(language == "go", F.regexp_extract(F.trim(signature), GO_FIELD, 1)).when(language.isin("python", "typescript", "javascript"), F.regexp_extract(F.trim(signature), COLON_FIELD, 1))
    return F.nullif(F.regexp_replace(F.trim(found), ",+$", ""), F.lit(""))


def short_snippet(text: Column, chars: int = 600) -> Column:
    """Trimmed text, cut to ``chars`` with three dots at its end."""
    whole = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    return F.when(F.length(whole) <= chars, whole).otherwise(F.concat(F.regexp_replace(F.substring(whole, 1, chars - 3), r"\s+$", ""), F.lit("...")))


def cut_at_line(text: Column, chars: int) -> tuple[Column, Column]:
    """(text cut to ``chars`` after its last whole line, whether it was cut)."""
    cut = F.regexp_replace(F.substring(text, 1, chars), r"(?s)\A(.+)\n[^\n]*\z", "$1")
    more = F.length(text) > chars
    return F.when(more, F.regexp_replace(cut, r"\s+\z", "")).otherwise(text), more


def iso_z(at: Column) -> Column:
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def vector_text(vector: Column) -> Column:
    """A vector as a JSON list."""
    return F.to_json(vector)


def vector_of(text: Column) -> Column:
    """The vector of a JSON list; null if it isn't one."""
    return F.from_json(text, "array<double>")


def metadata_list(metadata: Column, key: str) -> Column:
    """The list under a key of a map of lists, empty without one."""
    return F.coalesce(metadata[key], F.array().cast("array<string>"))


def with_metadata_list(metadata: Column, key: str, values: Column) -> Column:
    """metadata with the distinct values under key, in order; without the key if there are none."""
    rest = F.map_filter(metadata, lambda k, _: k != key)
    kept = F.array_distinct(values)
    return F.when(F.size(kept) > 0, F.map_concat(rest, F.map_from_arrays(F.array(F.lit(key)), F.array(kept)))).otherwise(rest)


def keys_by_value(counts: Column) -> Column:
    """Keys of positive value, the largest first, equal ones by key."""
    entries = F.filter(F.map_entries(counts), lambda e: e["value"] > 0)
    ordered = F.array_sort(F.transform(entries, lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k"))))
    return F.transform(ordered, lambda e: e["k"])


def outline(headings: Column, most: int = 30) -> Column:
    """The first headings of a document in reading order, as indented lines; headings is an array of (level, heading)."""
    return F.transform(F.slice(headings, 1, most), lambda h: F.concat(F.repeat(F.lit("  "), h["level"] - 1), h["heading"]))


def as_int(text: Column) -> Column:
    return F.coalesce(text.try_cast("int"), F.lit(0))


def as_bool(text: Column) -> Column:
    return F.coalesce(text.try_cast("boolean"), F.lit(False))


def as_texts(text: Column) -> Column:
    """Strings of a JSON list; empty if it isn't one."""
    return F.filter(F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>")), lambda x: x.isNotNull())


def append_unique(values: Column, value: Column) -> Column:
    return F.array_distinct(F.array_append(values, value))


def _uuid(hex32: Column, version: int) -> Column:
    """32 hex digits with version and variant set."""
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(hex32, 17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    return F.concat_ws("-", F.substring(hex32, 1, 8), F.substring(hex32, 9, 4), F.concat(F.lit(str(version)), F.substring(hex32, 14, 3)), F.concat(variant, F.substring(hex32, 18, 3)), F.substring(hex32, 21, 12))


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """The name's UUID of version 5."""
    return _uuid(F.substring(F.sha1(F.concat(F.unhex(F.lit(namespace)), name.cast("binary"))), 1, 32), 5)


def uuid7(at: Column, key: Column) -> Column:
    """A UUID of version 7: its order is that of ``at`` by milliseconds; the key gives the rest, so reruns agree."""
    return _uuid(F.concat(F.lpad(F.lower(F.hex(F.unix_millis(at))), 12, "0"), F.substring(F.sha2(key, 256), 1, 20)), 7)
