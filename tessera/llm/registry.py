"""The operators' queries and their DuckDB counterparts, each imported when it is asked for."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Query name: (module, name of its oracle there or None).
OPERATORS = {
    "op1_quality": ("quality", None),
    "op2_dedup_spans": ("spans", None),
    "op3_mix_sources": ("mixing", "oracle"),
    "op4_shard_by_links": ("sharding", None),
    "op5_jaccard_join": ("similarity", None),
    "op6_warc_archive": ("warc", "oracle"),
    "op7_pack_best_fit": ("packing", None),
    "op8_personal_data": ("pii", None),
    "op9_nearest_neighbours": ("neighbours", None),
    "op10_sniff_media": ("media", None),
    "op11_phrase_collocations": ("phrases", "oracle"),
    "op12_periodic_runs": ("runs", None),
    "op13_minimum_bin_slack": ("slack", None),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(importlib.import_module(f"{__package__}.{module}"), name) for name, (module, _) in OPERATORS.items()}


def oracles() -> dict[str, str]:
    found = {name: (module, oracle) for name, (module, oracle) in OPERATORS.items() if oracle}
    return {name: getattr(importlib.import_module(f"{__package__}.{module}"), oracle)() for name, (module, oracle) in found.items()}
