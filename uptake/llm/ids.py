"""Joins with sets of document ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.stages import materialize

#: Ids that may be broadcast: 64 MiB at 8 bytes.
BROADCAST_IDS = 1 << 23


def narrow(ids: DataFrame) -> DataFrame:
    """``ids`` with a broadcast hint if its counted size is within ``BROADCAST_IDS``; else Spark shuffles both sides."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def without(docs: DataFrame, gone: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id is not in the one column of ``gone``; rows without id stay."""
    name = "_gone_id"
    while name in docs.columns:
        name += "_"
    gone = materialize(gone.toDF(name).distinct())
    return docs.join(narrow(gone), docs[doc_id] == gone[name], "left_anti")
