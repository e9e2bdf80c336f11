"""What to do with a revision, from its ordered events: discard, save or wait.

A negative event discards, and the first one in the order of events is the reason. Else, with
compilation and rendering both succeeded, a success saves; the reason is the first kind of success in
the order of the list, not of events. Everything else waits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of events, successes in order of priority. Fixed values.
NEGATIVE = ("revision.corrected", "revision.deleted", "revision.manual-edited", "revision.regenerated", "revision.reverted", "render.failed", "compile.failed")
SUCCESS = ("workspace.exported", "workspace.published", "workspace.reused", "workspace.next-task-unchanged")
COMPILED, RENDERED = "compile.succeeded", "render.succeeded"


def facts(kind: Column, order: Sequence[Column]) -> list[Column]:
    """Aggregates that a decision needs. All of them combine on the map side, and later events can be
    merged into them."""
    rank = F.coalesce(*(F.when(kind == s, i) for i, s in enumerate(SUCCESS)))
    return [
        F.min(F.when(kind.isin(*NEGATIVE), F.struct(*order, kind.alias("kind")))).alias("negative"),
        F.coalesce(F.bool_or(kind == COMPILED), F.lit(False)).alias("compiled"),
        F.coalesce(F.bool_or(kind == RENDERED), F.lit(False)).alias("rendered"),
        F.min(rank).alias("success"),
    ]


def decision(negative: Column, compiled: Column, rendered: Column, success: Column) -> tuple[Column, Column]:
    """(action, reason) from the facts."""
    name = F.get(F.array(*(F.lit(s) for s in SUCCESS)), success)
    action = F.when(negative.isNotNull(), "discard").when(compiled & rendered & success.isNotNull(), "save").otherwise("wait")
    reason = (
        F.when(negative.isNotNull(), negative)
        .when(success.isNull(), "no-success-signal")
        .when(compiled & rendered, name)
        .otherwise("awaiting-compile-and-render")
    )
    return action.alias("action"), reason.alias("reason")


def decide(events: DataFrame, keys: Sequence[str], order: Sequence[str], kind: str = "type") -> DataFrame:
    """keys, action and reason: one row for each revision. One shuffle, of partial facts."""
    found = events.groupBy(*keys).agg(*facts(F.coalesce(F.col(kind), F.lit("")), [F.col(c) for c in order]))
    return found.select(*keys, *decision(F.col("negative.kind"), F.col("compiled"), F.col("rendered"), F.col("success")))


def valid_decision(action: Column, reason: Column) -> Column:
    return action.isin("discard", "save", "wait") & (F.coalesce(F.length(reason), F.lit(0)) > 0)


#: What a review has to pass. Fixed values.
CHECKS = ("compile", "tests", "render", "privacy", "semantic")


def review_passes(checks: Column, digest: Column, commit: Column) -> Column:
    """Whether a map of checks has all that are asked for, each passed and bound to one candidate."""
    good = [checks[c]["passed"] & (checks[c]["evidence"]["candidate_digest"] == digest) & (checks[c]["evidence"]["candidate_commit"] == commit) for c in CHECKS]
    out = good[0]
    for g in good[1:]:
        out = out & g
    return F.coalesce(out, F.lit(False)) & (F.size(F.map_keys(checks)) == len(CHECKS))
