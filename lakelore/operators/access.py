"""Who may see which sources: grants, scopes, their folds and intersections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def effective_scope(enforced: Column, asked: Column) -> Column:
    """Null: unrestricted. An admin gets what they ask for; others what they ask for within their scope; empty stays empty."""
    return F.when(enforced.isNull(), asked).when(asked.isNull(), enforced).otherwise(F.array_intersect(asked, enforced))


def allowed(enforced: Column, source_id: Column) -> Column:
    return enforced.isNull() | F.coalesce(F.array_contains(enforced, source_id), F.lit(False))


def client_routes(staff_clients: DataFrame, source_clients: DataFrame) -> DataFrame:
    """user_id, source_id, client_id of grants by client that aren't revoked."""
    return staff_clients.where("revoked_at is null").join(source_clients, "client_id").select("user_id", "source_id", "client_id").distinct()


def user_sources(staff_clients: DataFrame, source_clients: DataFrame, staff_sources: DataFrame) -> DataFrame:
    """user_id, source_id: what a user may see by client or directly, each once."""
    direct = staff_sources.where("revoked_at is null").select("user_id", "source_id")
    return client_routes(staff_clients, source_clients).select("user_id", "source_id").union(direct).distinct()


def shared_sources(grants: DataFrame, sources: DataFrame, members: DataFrame) -> DataFrame:
    """group_id, source_id: what every member of a group may see, but nothing confidential to a client.

    ``members``: group_id, user_id. Division: as many members with the grant as the group has.
    """
    needed = members.groupBy("group_id").agg(F.countDistinct("user_id").alias("needed"))
    open_ = sources.where("data_class <> 'client_confidential'").select("source_id")
    held = grants.join(members, "user_id").join(open_, "source_id").groupBy("group_id", "source_id").agg(F.countDistinct("user_id").alias("held"))
    return held.join(needed, "group_id").where("held = needed").select("group_id", "source_id")


def mint_scope(kind: Column, own: Column, common: Column) -> Column:
    """A direct message sees the user's own sources, a channel what its members have in common."""
    return F.when(kind == "direct", own).otherwise(common)


def dedup_grants(grants: DataFrame) -> DataFrame:
    """One grant per user and client: an active one first, then the newest, then the least id."""
    order = Window.partitionBy("user_id", "client_id").orderBy(F.col("revoked_at").isNotNull(), F.desc("granted_at"), "id")
    return grants.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def fold_grants(events: DataFrame, *key: str) -> DataFrame:
    """State of a log of grants and revocations (action, at, event_id): a grant clears a revocation, the last event counts.

    A revocation without a grant before it leaves nothing. Repeated revocations keep the time of the first since the grant.
    """
    last = events.groupBy(*key).agg(F.max(F.when(F.col("action") == "grant", F.struct("at", "event_id"))).alias("granted"))
    joined = events.join(last.where("granted is not null"), list(key))
    since = F.min(F.when((F.col("action") == "revoke") & (F.struct("at", "event_id") > F.col("granted")), F.col("at")))
    return joined.groupBy(*key, "granted").agg(since.alias("revoked_at")).select(*key, F.col("granted.at").alias("granted_at"), "revoked_at")


def public_sources(sources: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Sources by age without their configuration; only those of a scope, if there is one."""
    out = sources.drop("config")
    if scope is not None:
        out = out.where(F.col("source_id").isin(scope)) if scope else out.where(F.lit(False))
    return out.orderBy("created_at", "source_id")
