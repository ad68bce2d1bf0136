"""Composite runs: each is one lazy DataFrame plan (or
a short sequence of Spark jobs), not a chain of processes exchanging files."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import adapters as ad
from ..operators import aggregate as agg
from ..operators import graph as gr
from ..operators import sampling as sm
from ..operators.encode import apply_class_map, fit_class_map
from ..operators.sets import combine


def standardize_sources(sources: dict[str, tuple]) -> dict[str, DataFrame]:
    """name -> common-v1 table of (raw DataFrame, adapter name, content key[, adapter options])."""
    return {name: ad.standardize(raw, adapter, **({} if adapter == "unsw_nb15" else {"key": key}) | (options[0] if options else {}))
            for name, (raw, adapter, key, *options) in sources.items()}


def reduce_combine(standard: dict[str, DataFrame], rates: dict[str, float], reduced: bool = True) -> DataFrame:
    """Standardized sources reduced by rarity (rate per source), tagged with their provenance and united with re-numbered flow ids."""
    parts = []
    for name, std in standard.items():
        if reduced and name in rates:
            std = sm.reduce_by_rarity(std, "attack_type", rates[name], "flow_id")
        parts.append(ad.with_source(std, name))
    return combine(parts, renumber="flow_id")


def reduce_standardize_combine(sources: dict[str, tuple], rates: dict[str, float],
                               reduced: bool = True) -> DataFrame:
    """PIP-1: per source reduce by rarity (rate per source), standardize with
    its adapter, tag provenance, and union with re-numbered flow ids.
    ``sources``: name -> (raw DataFrame, adapter name, content key[, adapter options])."""
    return reduce_combine(standardize_sources(sources), rates, reduced)


def process_dataset(df: DataFrame, source: str, key: str = "flow_key"):
    """PIP-2: standardize -> encode attack types -> host graph -> metrics."""
    std = ad.standardize(df, source, key=key)
    cmap = fit_class_map(std, "attack_type")
    enc = apply_class_map(std, cmap, "attack_type", "attack_type_encoded")
    nodes, edges = gr.host_graph(enc)
    return enc, cmap, nodes, edges, agg.graph_metrics(nodes, edges)
