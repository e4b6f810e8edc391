"""Sharding by balanced label propagation.

Linked documents (members of one group) move, round by round, to the shard that holds most of
their neighbours, as far as that shard's quota allows. Every step is a join or an aggregation
over narrow rows: groups are counted by shard before anything is joined, quotas are met by
running sums that deal a shard's rows over many tasks, and the driver sees only counts by
shard. A group larger than a shard fills it and spreads over the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.common import row_rank, running_sum, utf8, written

SHARDS = 40
ROUNDS = 6


def quotas(rows: int, shards: int) -> list[int]:
    """Rows of each shard; they differ by one at most."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def pick(values: list[int], at: Column) -> Column:
    return F.get(F.array(*[F.lit(v).cast("long") for v in values]), at)


def propagate(state: DataFrame, quota: list[int], rounds: int = ROUNDS) -> DataFrame:
    """Move the members of groups. ``state`` (rid, gid, shard) is a written table.

    A group's shards are ordered by how many members they hold. Members in the last of them
    propose to move to the first, as far as there is room, then to the second, and so on; for
    a small group that means: all go where most are. Proposals are counts by (group, from,
    to); a running sum over each target accepts whole counts until the quota is used up, so
    few groups are split. A round without a move ends the loop; ``rounds`` bounds it.
    """
    for _ in range(rounds):
        held = {r["shard"]: r["count"] for r in state.groupBy("shard").count().collect()}
        room = [max(0, q - held.get(s, 0)) for s, q in enumerate(quota)]
        counts = state.groupBy("gid", "shard").agg(F.count(F.lit(1)).alias("n")).withColumn("room", pick(room, F.col("shard")))
        # At most one row a shard in these windows.
        first = Window.partitionBy("gid").orderBy(F.desc("n"), "shard")
        last = Window.partitionBy("gid").orderBy("n", F.desc("shard"))
        ends = counts.select("gid", "shard", "n", "room", F.row_number().over(first).alias("pos"), F.sum("room").over(first).alias("room_end"), F.sum("n").over(last).alias("n_end"))
        ends = written(ends, "ends")
        give = ends.select("gid", "shard", F.col("pos").alias("g_pos"), (F.col("n_end") - F.col("n")).alias("g_start"), F.col("n_end").alias("g_end"))
        take = ends.where("room > 0").select("gid", F.col("shard").alias("to"), F.col("pos").alias("t_pos"), (F.col("room_end") - F.col("room")).alias("t_start"), F.col("room_end").alias("t_end"))
        low, high = F.greatest("g_start", "t_start"), F.least("g_end", "t_end")
        wanted = give.join(take, "gid").where((F.col("t_pos") < F.col("g_pos")) & (low < high)).select("gid", "shard", "to", (low - F.col("g_start")).alias("begin"), (high - low).alias("n"))
        flow = running_sum(written(wanted, "flow"), ["to"], ["gid", "shard"], "n", "ahead")
        granted = flow.withColumn("n", F.least(F.col("n"), pick(room, F.col("to")) - F.col("ahead"))).where("n > 0").select("gid", "shard", "to", "begin", "n")
        granted = written(granted, "granted")
        if granted.isEmpty():
            break
        ranked = row_rank(state, ["gid", "shard"], ["rid"], "at")
        goes = (ranked["gid"] == granted["gid"]) & (ranked["shard"] == granted["shard"]) & (F.col("at") >= F.col("begin")) & (F.col("at") < F.col("begin") + F.col("n"))
        moved = ranked.join(granted, goes, "left").select("rid", ranked["gid"], F.coalesce("to", ranked["shard"]).alias("shard"))
        state = written(moved, "labels")
    return state


def settle(state: DataFrame, quota: list[int]) -> DataFrame:
    """Give every row its final shard and slot. ``state`` (rid, linked, shard, ...) is written.

    Rows rank within their shard, linked ones first; ranks beyond the quota go, in order, to
    the shards that lack rows. Counts by shard are all that the driver reads.
    """
    shards = len(quota)
    n = {(r["shard"], r["linked"]): r["count"] for r in state.groupBy("shard", "linked").count().collect()}
    linked = [n.get((s, True), 0) for s in range(shards)]
    rows = [linked[s] + n.get((s, False), 0) for s in range(shards)]
    over = [max(0, r - q) for r, q in zip(rows, quota, strict=True)]
    lack = [max(0, q - r) for r, q in zip(rows, quota, strict=True)]
    over_before = [sum(over[:s]) for s in range(shards)]
    lack_before = [sum(lack[:s]) for s in range(shards)]
    ranked = row_rank(state, ["shard", "linked"], ["rid"], "at")
    at = F.col("at") + F.when(F.col("linked"), F.lit(0)).otherwise(pick(linked, F.col("shard")))
    moved = F.col("rank") - pick(quota, F.col("shard")) + pick(over_before, F.col("shard"))
    # The last shard whose rows to fill begin at or before this one.
    to = sum((F.when(moved >= lack_before[s], 1).otherwise(0) for s in range(1, shards)), F.lit(0))
    to = F.get(F.array(*[F.lit(max([x for x in range(s + 1) if lack[x]], default=s)) for s in range(shards)]), to)
    stays = F.col("rank") < pick(quota, F.col("shard"))
    done = ranked.withColumn("rank", at).withColumn("_to", F.when(stays, F.col("shard")).otherwise(to).cast("int")).withColumn("_moved", moved)
    slot = F.when(stays, F.col("rank")).otherwise(pick(rows, F.col("_to")) + F.col("_moved") - pick(lack_before, F.col("_to")))
    return done.withColumn("slot", slot.cast("long")).withColumn("shard", F.col("_to")).drop("at", "rank", "_to", "_moved", "linked")


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, size, text_crc32, law ("rows"), shard, slot, grown_shard (null).

    Documents with equal texts are linked; a null text counts as empty. Shards differ by one
    row at most, whatever the groups. Rows are told apart by a number given when they are
    first written, so null and repeated ids, even wholly repeated rows, each get a slot. Other
    columns are not read. An empty table gives an empty result.
    """
    raw = utf8(F.col(text))
    base = docs.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col(id),
        (F.octet_length(raw) + 16).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.xxhash64(raw, F.octet_length(raw)).alias("gid"),
    )
    base = written(base.withColumn("shard", F.pmod(F.xxhash64("rid"), F.lit(shards)).cast("int")), "sizes")
    quota = quotas(base.count(), shards)
    groups = base.groupBy("gid").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gid")
    # Written, it is an input of its own, and Spark can split a hot group's rows in the join.
    groups = written(groups, "groups")
    state = written(base.select("rid", "gid", "shard").join(groups, "gid").select("rid", "gid", "shard"), "labels")
    labels = propagate(state, quota, rounds).select("rid", F.col("shard").alias("_label"))
    full = base.join(labels, "rid", "left")
    full = full.select("rid", id, "size", "text_crc32", F.col("_label").isNotNull().alias("linked"), F.coalesce("_label", "shard").alias("shard"))
    out = settle(written(full, "state"), quota)
    return out.select(id, "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
