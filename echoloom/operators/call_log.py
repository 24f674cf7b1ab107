"""Calls of analyses, made once and logged: every operator that asks a model can leave a row for each call in the usage log."""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settled
from ..sources.records import append_calls
from .complete import INJECTION, TOO_LARGE, Complete, complete
from .usage import to_call_rows


@dataclass(frozen=True, eq=False)
class CallLog:
    """Where calls are logged and in whose name: context is a table (key, tenant_id, call_id), key a column of the rows that are asked about.

    Analyses, trees and bulk summaries are asked about by corpus, records by id. A key that context repeats counts with its least row; one that it lacks
    is logged without a tenant and call.
    """

    path: str
    operation: str
    context: DataFrame
    key: str = "corpus_id"

    def add(self, answered: DataFrame, completion: str = "completion") -> None:
        """Append a row for each call that was sent; messages that a gate held back were no calls. A log that cannot be written is reported and stops nothing."""
        c = F.col(completion)
        sent = answered.where(F.coalesce(~c["error_class"].isin(TOO_LARGE, INJECTION), F.lit(True))).select(self.key, c.dropFields("content").alias("completion"))
        who = self.context.groupBy(self.key).agg(F.min(F.struct("tenant_id", "call_id")).alias("_who"))
        rows = sent.join(who, self.key, "left").select("_who.tenant_id", F.lit(self.operation).alias("operation"), "_who.call_id", F.current_timestamp().alias("ts"), "completion")
        try:
            append_calls(to_call_rows(rows), self.path)
        except Exception:  # noqa: BLE001  answers that are there are not lost for want of their log
            logging.getLogger(__name__).exception("calls of %s were not logged in %s", self.operation, self.path)


def answered(df: DataFrame, fn: Complete, log: CallLog | None = None, out: str = "completion", **opts) -> DataFrame:
    """complete(), its result written to the shared folder without the messages (columns system and user), so that no call is made again when it is read; and logged."""
    got = settled(complete(df, fn, out=out, **opts).drop("system", "user"))
    if log:
        log.add(got, out)
    return got
