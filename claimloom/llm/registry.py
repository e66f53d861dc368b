"""The modules whose queries __spark_entry__ registers."""

from __future__ import annotations

import importlib

NAMES = ["wrappers", "jaccard", "kdtree", "perplexity", "bpe", "webp", "idfiles", "urls", "chat", "decontaminate", "toxicity", "audit", "collocations"]


def modules() -> list:
    return [importlib.import_module(f"{__package__}.{n}") for n in NAMES]
