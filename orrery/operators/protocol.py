"""Rules of a publication: what a decision, a source, a lease, a candidate and its receipts have to be.

A rule is a condition on struct columns. A check gives the name of the first rule that isn't met, in
order, and null for a row that meets all; it is an expression, so that a table of attempts is judged
where it lies. Digests and commits are compared in lower case where they are written by a tool.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_safe_id

ACTIONS = ("save", "wait", "discard")
#: Answers to a request for a lease, besides `acquired`. Fixed values.
SKIPPED = ("busy", "completed", "discarded", "waiting")
#: What a review has to show evidence for. Fixed value.
CHECKS = ("compile", "tests", "render", "privacy", "semantic")
DIGEST, COMMIT, REVISION = "^[a-f0-9]{64}\\z", "^([a-f0-9]{40}|[a-f0-9]{64})\\z", "^[a-zA-Z0-9_-]{1,128}\\z"
SAFE_INTEGER = (1 << 53) - 1


def first_unmet(rules: Mapping[str, Column]) -> Column:
    return F.coalesce(*(F.when(~F.coalesce(met, F.lit(False)), F.lit(name)) for name, met in rules.items()), F.lit(None).cast("string"))


def revision(revision_id: Column, sha256: Column) -> Column:
    return first_unmet({"revision_id": revision_id.rlike(REVISION), "source_sha256": F.lower(sha256).rlike(DIGEST)})


def decision(own: Column) -> Column:
    return first_unmet({"action": own["action"].isin(*ACTIONS), "reason": own["reason"] != ""})


def acquisition(status: Column, action: Column) -> Column:
    """Only a decision to save is given a lease, and no other answer is known."""
    return first_unmet({"status": status.isin("acquired", *SKIPPED), "lease_without_save": (status != "acquired") | (action == "save")})


def source(own: Column, sha256: Column) -> Column:
    return first_unmet({"immutable": own["immutable"], "sha256": own["sha256"] == sha256, "checkout_id": is_safe_id(own["checkout_id"])})


def lease(own: Column) -> Column:
    finite = ~F.isnan(own["expires_at"].cast("double")) & (F.abs(own["expires_at"].cast("double")) != float("inf"))
    return first_unmet({"token": is_safe_id(own["token"]), "fence": own["fence"].between(1, SAFE_INTEGER), "expires_at": finite})


def public_lease(own: Column) -> Column:
    return F.struct(own["expires_at"].alias("expires_at"), own["fence"].alias("fence"), own["token"].alias("token"))


def candidate(own: Column, sha256: Column) -> Column:
    return first_unmet({
        "isolation": own["isolation"] == "isolated-candidate",
        "base_sha256": own["base_sha256"] == sha256,
        "candidate_id": is_safe_id(own["candidate_id"]),
        "workspace": own["workspace"].isNotNull(),
    })


def sealed(own: Column, opened: Column, sha256: Column) -> Column:
    return first_unmet({
        "candidate_id": own["candidate_id"] == opened["candidate_id"],
        "base_sha256": own["base_sha256"] == sha256,
        "digest": F.lower(own["digest"]).rlike(DIGEST),
        "commit": F.lower(own["commit"]).rlike(COMMIT),
        "artifact": own["artifact"].isNotNull(),
    })


def review_subject(own: Column) -> Column:
    """What a reviewer is shown of a sealed candidate: not the artifact."""
    return F.struct(own["base_sha256"].alias("base_sha256"), F.lower(own["commit"]).alias("commit"), F.lower(own["digest"]).alias("digest"), own["candidate_id"].alias("candidate_id"))


def same_artifact(own: Column, of: Column) -> Column:
    return (own["digest"] == F.lower(of["digest"])) & (own["commit"] == F.lower(of["commit"]))


def review(own: Column, of: Column, sha256: Column) -> Column:
    """own: accepted, review_id, sha256, digest, commit, checks (map of name to passed, evidence_id, summary, digest, commit)."""
    rules = {"accepted": own["accepted"], "review_id": is_safe_id(own["review_id"]), "bound": (own["sha256"] == sha256) & same_artifact(own, of)}
    for name in CHECKS:
        given = F.try_element_at(own["checks"], F.lit(name))
        rules[name] = given["passed"] & is_safe_id(given["evidence_id"]) & (F.trim(given["summary"]) != "") & same_artifact(given, of)
    return first_unmet(rules)


def applied(own: Column, of: Column) -> Column:
    return first_unmet({"applied": own["applied"], "bound": same_artifact(own, of), "persisted_commit": F.lower(own["persisted_commit"]).rlike(COMMIT)})


def committed(own: Column, of: Column) -> Column:
    """own: committed, digest, commit, receipt (applied, digest, commit, persisted_commit), decision, reason."""
    return F.coalesce(first_unmet({"committed": own["committed"], "bound": same_artifact(own, of)}), applied(own["receipt"], of))


def authority_failure(state: Column, otherwise: str) -> Column:
    """What a refusal by the authority means: a cancellation if its decision is to discard, else a lost lease."""
    discards = F.coalesce(state["decision"]["action"] == "discard", F.lit(False))
    return F.struct(F.when(discards, "canceled").otherwise("lease-lost").alias("kind"), F.coalesce(state["reason"], F.lit(otherwise)).alias("reason"))


def handled(attempts: DataFrame) -> DataFrame:
    """attempts with outcome and detail: how far each attempt to publish a revision came.

    Columns: revision_id, sha256, status, decision, source, lease, candidate, sealed, review, result. Outcomes:
    `invalid` (detail: part and rule), `skipped` (the status), `canceled` (the authority's reason, if it has
    decided to discard meanwhile), `failed` (part and rule), `committed`. Steps are judged in their order.
    """
    c = F.col
    before = {"revision": revision(c("revision_id"), c("sha256")), "decision": decision(c("decision")), "acquisition": acquisition(c("status"), c("decision.action"))}
    bound = F.lower("sha256")
    after = {
        "source": source(c("source"), bound), "lease": lease(c("lease")), "candidate": candidate(c("candidate"), bound), "sealed": sealed(c("sealed"), c("candidate"), bound),
        "review": review(c("review"), c("sealed"), bound), "commit": committed(c("result"), c("sealed")),
    }
    named = lambda rules: F.coalesce(*(F.concat(F.lit(f"{part}."), rule) for part, rule in rules.items()))
    invalid, failed = named(before), named(after)
    gone = failed.startswith("commit.") & (c("result.decision.action") == "discard")
    came = lambda outcome, detail: F.struct(F.lit(outcome).alias("outcome"), detail.alias("detail"))
    kind = (
        F.when(invalid.isNotNull(), came("invalid", invalid))
        .when(c("status") != "acquired", came("skipped", c("status")))
        .when(gone, came("canceled", F.coalesce("result.reason", F.lit("commit-rejected"))))
        .when(failed.isNotNull(), came("failed", failed))
        .otherwise(came("committed", F.lower("result.receipt.persisted_commit")))
    )
    return attempts.withColumn("__kind", kind).select(*attempts.columns, "__kind.outcome", "__kind.detail")
