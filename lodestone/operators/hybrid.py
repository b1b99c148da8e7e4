"""Hybrid retrieval over several stores: streams, fusion and the final order as one lazy plan."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import gram_index as GI
from lodestone.operators import retrieval as R
from lodestone.operators import token_index as TI
from lodestone.operators import vector_index as VI

LAYER_STORE = {"code": "code", "ast": "code", "ast_summary": "code", "repo_doc": "repo_docs"}
MODES = {"code": ("code", "ast", "ast_summary"), "wiki": ("repo_doc",), "mixed": ("code", "ast_summary", "repo_doc")}
STORES = ("code", "repo_docs", "md_collections")  # equal scores come in this order
MOST = 25

_log = logging.getLogger(__name__)


@dataclass
class Store:
    """A searchable table: its texts, its vectors (optional), and for code the column of names. With indexes no stream reads the table."""

    rows: DataFrame
    id: str
    fields: dict[str, str]
    vectors: DataFrame | None = None
    vector_id: str = "id"
    vector: str = "embedding"
    symbol: str | None = None
    tokens: TI.TokenIndex | None = None
    grams: GI.GramIndex | None = None
    near: VI.VectorIndex | None = None

    def by_vector(self, query: list[float], k: int) -> DataFrame:
        return VI.search(self.near, query, k) if self.near else R.vector_stream(self.vectors, query, k, self.vector_id, self.vector)

    def by_words(self, query: str, k: int) -> DataFrame:
        return TI.search(self.tokens, query, k) if self.tokens else R.lexical_stream(self.rows, query, k, self.id, self.fields)

    def by_name(self, query: str, k: int) -> DataFrame:
        return GI.similar(self.grams, query, k) if self.grams else R.symbol_stream(self.rows, query, k, self.id, self.symbol)


def layers_of(mode: str = "mixed", layers: tuple[str, ...] | None = None) -> tuple[str, ...]:
    return layers or MODES[mode]


def stores_of(layers: tuple[str, ...], stores: tuple[str, ...] | None = None) -> set[str]:
    """Stores that layers need, or those that are asked for instead."""
    return set(stores) if stores else {LAYER_STORE[x] for x in layers}


def check_window(since: datetime | None, until: datetime | None, as_of: datetime | None) -> None:
    if since and until and since > until:
        raise ValueError("since is after until")
    if since and as_of and since > as_of:
        raise ValueError("since is after as_of")


def in_window(rows: DataFrame, changed: str, created: str, since=None, until=None, as_of=None) -> DataFrame:
    """Rows whose last change (creation without one) lies in the window, both ends included."""
    check_window(since, until, as_of)
    at = F.coalesce(changed, created)
    for value, keep in ((as_of, at <= F.lit(as_of)), (since, at >= F.lit(since)), (until, at <= F.lit(until))):
        if value is not None:
            rows = rows.where(keep)
    return rows


def _stream(name: str, build: Callable[[], DataFrame]) -> DataFrame | None:
    """A stream that can't even be planned is left out with a warning; failures of tasks aren't hidden."""
    try:
        return build()
    except (AnalysisException, ValueError) as e:
        _log.warning("stream %s is left out: %s", name, e)
        return None


def hybrid(stores: dict[str, Store], text: str, vector: list[float] | None, k: int, cap: int = R.CANDIDATE_CAP, rrf_k: int = R.RRF_K) -> DataFrame:
    """(store, id, score): each store's streams are fused, then all stores are ordered together.

    Vectors are searched if a query vector is given, words if the text isn't blank, names for code only.
    """
    out = None
    for place, name in enumerate(STORES):
        store = stores.get(name)
        if store is None:
            continue
        streams: dict[str, Callable[[], DataFrame]] = {}
        if vector and (store.vectors is not None or store.near):
            streams["vector"] = lambda s=store: s.by_vector(vector, cap)
        if text.strip():
            streams["lexical"] = lambda s=store: s.by_words(text, cap)
            if store.symbol:
                streams["symbol"] = lambda s=store: s.by_name(text, cap)
        built = {n: s for n, b in streams.items() if (s := _stream(f"{name}.{n}", b)) is not None}
        if built:
            part = R.fuse(built, rrf_k, cap).select(F.lit(name).alias("store"), F.lit(place).alias("_place"), "id", "score")
            out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("nothing to search")
    return out.orderBy(F.desc("score"), "_place", "id").limit(min(k, MOST)).drop("_place")


SNIPPET_CHARS = 1200


def with_snippets(hits: DataFrame, rows: DataFrame, id: str, text: str, most: int = SNIPPET_CHARS) -> DataFrame:
    """hits(id, ...) with ``snippet``: their text up to ``most`` characters, cut with an ellipsis. Hits are few: their ids go into the filter of the scan."""
    ids = [r[0] for r in hits.select("id").distinct().collect()]  # MOST of each store
    body = F.coalesce(F.col(text), F.lit(""))
    cut = F.when(F.length(body) > most, F.concat(F.substring(body, 1, most), F.lit("…"))).otherwise(body)
    own = rows.where(F.col(id).cast("string").isin([str(i) for i in ids])) if dict(rows.dtypes)[id] not in ("bigint", "int") else rows.where(F.col(id).isin([int(i) for i in ids]))
    return hits.join(own.select(F.col(id).cast("string").alias("id"), cut.alias("snippet")), "id", "left")


def page_bundle(code: Store, docs: Store, edges: DataFrame, nodes: DataFrame, text: str, vector: list[float] | None, k_code: int = 12, k_docs: int = 6, k_pivot: int = 5) -> dict[str, DataFrame]:
    """What a page is written from: the best code and documents, each by itself, and the neighbours of
    the first code hits (none of them with k_pivot of 0, as for one section)."""
    from lodestone.operators.documents import pivot

    best = hybrid({"code": code}, text, vector, k_code)
    if not k_pivot:
        return {"code": best, "docs": hybrid({"repo_docs": docs}, text, vector, k_docs)}
    first = best.orderBy(F.desc("score"), "id").limit(k_pivot)
    hits = first.select((-F.col("score")).alias("pos"), F.col("id").cast(dict(nodes.dtypes)["id"]).alias("id"))
    return {"code": best, "docs": hybrid({"repo_docs": docs}, text, vector, k_docs), "pivot": pivot(hits, edges, nodes, k_pivot)}


def section_bundle(code: Store, docs: Store, edges: DataFrame, nodes: DataFrame, purpose: str, heading: str, vector: list[float] | None) -> dict[str, DataFrame]:
    """The smaller bundle of one section: its heading is searched with its page's purpose, without neighbours."""
    return page_bundle(code, docs, edges, nodes, f"{purpose} :: {heading}", vector, 8, 4, 0)
