"""A whole search request: find, locate, shape and gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from clausedelta.operators import stored_search as stored
from clausedelta.operators.search import (
    DEFAULT_LIMIT,
    filter_by_type,
    gate_results,
    result_cards,
    search_diffs,
    search_snapshots,
)


def search_request(
    snapshots: DataFrame, diffs: DataFrame, documents: DataFrame, sources: DataFrame, query: str,
    has_access: bool | Column, kind: str = "all", limit: int = DEFAULT_LIMIT, scored: bool = False,
) -> DataFrame:
    found_diffs = search_diffs(diffs, documents, sources, query, limit)
    found_snapshots = search_snapshots(snapshots, documents, sources, query, limit)
    return gate_results(filter_by_type(result_cards(found_diffs, found_snapshots, scored), kind), has_access)


def stored_cards(
    store: stored.SearchStore, documents: DataFrame, sources: DataFrame, query: str, kind: str = "all",
    limit: int = DEFAULT_LIMIT, by_terms: bool = False, scored: bool = False,
) -> DataFrame:
    """Cards of what a stored search finds; a side that the kind leaves out is not searched."""
    def found(side: stored.Side, wanted: str, columns: list[str]) -> DataFrame:
        find = store.keys_with_terms if by_terms else store.keys_containing
        keys = find(side, query) if kind in ("all", wanted) else store.keys(side).limit(0)
        return store.search(side, keys, documents, sources, limit, columns)

    diffs = found(stored.DIFFS, "diffs", ["changes"])
    return result_cards(diffs, found(stored.SNAPSHOTS, "snapshots", ["version", "cleaned_text"]), scored)


def stored_search_request(
    store: stored.SearchStore, documents: DataFrame, sources: DataFrame, query: str, has_access: bool | Column,
    kind: str = "all", limit: int = DEFAULT_LIMIT, by_terms: bool = False, scored: bool = False,
) -> DataFrame:
    """The same request over a store: by substring, or by the words of the index."""
    return gate_results(stored_cards(store, documents, sources, query, kind, limit, by_terms, scored), has_access)
