"""Identity and change keys; they decide what an incremental run does again."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def symbol_key(language: Column, qualified_name: Column, signature: Column) -> Column:
    return F.concat_ws(":", language, qualified_name, F.substring(F.sha2(F.coalesce(signature, F.lit("")), 256), 1, 8))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def neighbour_hash(callers: Column, callees: Column) -> Column:
    """Of caller and callee names, in any order."""
    joined = lambda a: F.array_join(F.sort_array(a), "|")
    return F.substring(F.sha2(F.concat(joined(callers), F.lit("||"), joined(callees)), 256), 1, 16)


def summary_hash(*parts: Column) -> Column:
    """Of a node's descriptive fields; contents count with their first 2048 characters."""
    return F.sha2(F.concat_ws("\x1e", *(F.coalesce(p, F.lit("")) for p in parts)), 256)


def fingerprint(rows: Column) -> Column:
    """Of an array of strings, in any order."""
    return F.sha2(F.array_join(F.array_sort(rows), "\n"), 256)


def idempotency_key(user: Column, key: Column) -> Column:
    return F.sha2(F.concat_ws(":", user, key), 256)
