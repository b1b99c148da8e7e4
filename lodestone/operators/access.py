"""Read scopes: which rows a caller may see, applied before anything is ranked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALL = ("owner", "admin")
RANK = {"read": 1, "write": 2}


def readable(rows: DataFrame, grants: DataFrame, members: DataFrame, user=None, role: str | None = None, public_read: bool = True, id: str = "id", deleted: str | None = "deleted", owner: str | None = None) -> DataFrame:
    """Rows(id, visibility, ...) for a caller: owners and admins see all, anonymous callers what is
    public (if allowed), users what is public, their own, or granted to one of their groups.

    grants(resource_id, group_id), members(user_id, group_id).
    """
    live = rows.where(~F.col(deleted)) if deleted else rows
    if role in ALL:
        return live
    public = F.col("visibility") == "public"
    if user is None:
        return live.where(public) if public_read else live.limit(0)
    mine = members.where(F.col("user_id") == user).select("group_id")
    granted = grants.join(mine, "group_id", "left_semi").select(F.col("resource_id").alias(id)).distinct().withColumn("_granted", F.lit(True))
    own = F.col(owner) == user if owner else F.lit(False)
    return live.join(granted, id, "left").where(public | own | F.coalesce("_granted", F.lit(False))).drop("_granted")


def best_permission(grants: DataFrame, members: DataFrame) -> DataFrame:
    """(user_id, resource_id, level) of the strongest grant."""
    rank = F.max(F.when(F.col("permission") == "write", 2).otherwise(1))
    out = members.join(grants, "group_id").groupBy("user_id", "resource_id").agg(rank.alias("rank"))
    return out.select("user_id", "resource_id", F.when(F.col("rank") == 2, "write").otherwise("read").alias("level"))


def paged(rows: DataFrame, page: int, size: int, *order) -> DataFrame:
    return rows.orderBy(*order).offset((page - 1) * size).limit(size)


def page_info(rows: DataFrame, size: int) -> DataFrame:
    return rows.agg(F.count("*").alias("total")).select("total", F.ceil(F.col("total") / size).alias("pages"))


def in_given_order(ids: list, rows: DataFrame, id: str) -> DataFrame:
    """Rows of the given ids in their order, with ``pos`` from 0; unknown ids are left out."""
    wanted = rows.sparkSession.createDataFrame([(i, k) for k, i in enumerate(ids)], [id, "pos"])
    return rows.join(F.broadcast(wanted), id).orderBy("pos")
