"""What the operators share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import BLOCK_BYTES, LOWER, SPACE, Text, U, blocks, get, mixed, of_rows, run_hashes, words
from ..sources.kept import dropped, kept, release, shared_dir

__all__ = ["BLOCK_BYTES", "LOWER", "SPACE", "Text", "U", "blocks", "get", "mixed", "of_rows", "run_hashes", "words", "dropped", "kept", "release", "shared_dir", "free", "whole_ids", "hex64"]


def free(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores before it as it takes to be no column's name (letters of either case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def whole_ids(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs, if its ids are integers, which rank documents; any other type is an error."""
    if docs.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{id_col} must be an integer, not {docs.schema[id_col].dataType.simpleString()}")
    return docs


def plain(docs: DataFrame) -> list:
    """Its columns, whatever characters are in their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def hex64(h: np.ndarray) -> list[str]:
    return [f"{x:016x}" for x in h.tolist()]
