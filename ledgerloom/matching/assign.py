"""One-to-one assignment: statement rows in order, each takes its best free ledger row.

Every ledger row prefers the statement row with the smaller id, so the serial
procedure has the same result as deferred acceptance: statement rows propose in
order of preference, a ledger row keeps the smallest proposer, and the rest
propose further down their lists. The order of proposals does not matter, which
makes each round one DataFrame job.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from ledgerloom.lineage import checkpoint

LIST_LENGTH = 64
# Lists grow from round to round up to this, so a group of equal rows settles in few rounds.
LONGEST_LIST = 4096
# Edges of a session that one task may hold: about 200 MB.
MOST_EDGES = 4_000_000


def empty_held(edges: DataFrame) -> DataFrame:
    return edges.where(F.lit(False)).select("session_id", "led", "stmt", "score", F.lit(False).alias("fresh"))


def settle(edges: DataFrame, held: DataFrame, list_length: int = LIST_LENGTH, most_edges: int = MOST_EDGES) -> DataFrame:
    """Run proposals over ``edges`` until no statement row can improve its state.

    ``edges`` has session_id, stmt, led and score; ``held`` the pairs held so
    far. Returns the held pairs; statement rows that lost theirs are absent.
    Sessions with at most ``most_edges`` edges, counted first, are settled in one job, a
    session in a task; larger ones in rounds. Both have one result.
    """
    sizes = edges.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    large = checkpoint(sizes.where(F.col("n") > most_edges).select("session_id"))
    if large.isEmpty():
        return checkpoint(_settled_in_tasks(edges, held))
    small = [df.join(large, "session_id", "left_anti") for df in (edges, held)]
    some = checkpoint(_settled_in_tasks(*small))
    edges, held = (df.join(large, "session_id", "left_semi") for df in (edges, held))
    # Every round settles a row or is the last, so this ends without a limit.
    while True:
        held = checkpoint(_round(edges, held, list_length))
        if held.where("fresh").isEmpty():
            return held.unionByName(some)
        list_length = min(2 * list_length, LONGEST_LIST)


def _settled_in_tasks(edges: DataFrame, held: DataFrame) -> DataFrame:
    """Proposals of each session in one task: its edges by numpy order, a stack of rows without a partner."""
    kind = held.schema["session_id"].dataType
    spread = edges.select("session_id", "stmt", "led", "score").groupBy("session_id")
    pairs = held.select(*(F.col(c).alias(f"h_{c}") for c in ("session_id", "led", "stmt", "score"))).groupBy("h_session_id")
    names = ["session_id", "led", "stmt", "score", "fresh"]
    kinds = (kind, LongType(), LongType(), DoubleType(), BooleanType())
    schema = StructType([StructField(n, k) for n, k in zip(names, kinds)])

    def run(wishes: pd.DataFrame, holding: pd.DataFrame) -> pd.DataFrame:
        session = wishes["session_id"].iloc[0] if len(wishes) else holding["h_session_id"].iloc[0]
        stmt, led, score = (wishes[c].to_numpy() for c in ("stmt", "led", "score"))
        order = np.lexsort((led, -score, stmt))
        stmt, led, score = stmt[order], led[order].tolist(), score[order].tolist()
        owner = dict(zip(holding["h_led"].tolist(), zip(holding["h_stmt"].tolist(), holding["h_score"].tolist())))
        rows, first = np.unique(stmt, return_index=True)
        at = dict(zip(rows.tolist(), first.tolist()))
        end = dict(zip(rows.tolist(), np.r_[first[1:], len(stmt)].tolist()))
        busy = {s for s, _ in owner.values()}
        waiting = [s for s in rows.tolist()[::-1] if s not in busy]
        while waiting:
            s = waiting.pop()
            k, last = at[s], end[s]
            # The next ledger row that is free, or held by a later statement row.
            while k < last and owner.get(led[k], (s + 1,))[0] <= s:
                k += 1
            at[s] = k + 1
            if k < last:
                loser = owner.get(led[k])
                owner[led[k]] = (s, score[k])
                # A loser whose edges are not here asks again in another turn.
                if loser and loser[0] in at:
                    waiting.append(loser[0])
        found = [(session, r, s, x, False) for r, (s, x) in owner.items()]
        return pd.DataFrame(found, columns=names)

    return spread.cogroup(pairs).applyInPandas(run, schema)


def _round(edges: DataFrame, held: DataFrame, list_length: int) -> DataFrame:
    holders = held.select("session_id", "led", F.col("stmt").alias("holder"))
    busy = held.select("session_id", "stmt")
    open_edges = (
        edges.join(busy, ["session_id", "stmt"], "left_anti")
        .join(holders, ["session_id", "led"], "left")
        .where(F.col("holder").isNull() | (F.col("holder") > F.col("stmt")))
    )
    best = Window.partitionBy("session_id", "stmt").orderBy(F.desc("score"), "led")
    lists = (
        open_edges.withColumn("r", F.row_number().over(best))
        .where(F.col("r") <= list_length)
        .groupBy("session_id", "stmt")
        .agg(F.array_sort(F.collect_list(F.struct("r", "led", "score"))).alias("choices"))
    )
    # Statement rows with one and the same list share it out by rank: whoever
    # comes later may skip the entries that earlier ones propose to right now.
    same_list = Window.partitionBy("session_id", F.col("choices.led")).orderBy("stmt")
    turns = lists.withColumn("turn", F.row_number().over(same_list)).where(F.col("turn") <= list_length)
    mine = F.try_element_at("choices", F.col("turn"))
    proposals = turns.select(
        "session_id",
        mine["led"].alias("led"),
        "stmt",
        mine["score"].alias("score"),
        F.lit(True).alias("fresh"),
    ).where(F.col("led").isNotNull())

    claims = held.withColumn("fresh", F.lit(False)).unionByName(proposals)
    kept = claims.groupBy("session_id", "led").agg(
        F.min_by(F.struct("stmt", "score", "fresh"), "stmt").alias("k")
    )
    return kept.select("session_id", "led", "k.stmt", "k.score", "k.fresh")


def settle_small(edges: DataFrame) -> DataFrame:
    """The serial procedure itself, one fold per session.

    Only for sessions whose number of pairs was checked beforehand: each
    session's edges are gathered in one row.
    """
    # One shuffle serves both groupings; a fixed number of partitions keeps the folds apart.
    tasks = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = edges.repartition(tasks, "session_id")
    best = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("worse"), "led")))
    wishes = spread.groupBy("session_id", "stmt").agg(best.alias("wishes"))
    queue = wishes.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("stmt", "wishes"))).alias("queue"))
    nothing = F.array().cast("array<struct<stmt:bigint,led:bigint,score:double>>")

    def step(done, row):
        free = F.filter(row["wishes"], lambda w: ~F.exists(done, lambda m: m["led"] == w["led"]))
        first = F.try_element_at(free, F.lit(1))
        match = F.struct(row["stmt"].alias("stmt"), first["led"].alias("led"), (-first["worse"]).alias("score"))
        return F.when(first.isNull(), done).otherwise(F.concat(done, F.array(match)))

    done = queue.select("session_id", F.explode(F.aggregate("queue", nothing, step)).alias("m"))
    return done.select("session_id", "m.led", "m.stmt", "m.score")
