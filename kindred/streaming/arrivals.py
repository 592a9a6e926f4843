"""Structured Streaming: event-time windows of arriving rows, and arriving classes scored against a pack."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """(window_start, event_type, n, total) of events (ts, event_type, value), on a stream or a table."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if rows.isStreaming else rows
    out = rows.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def stream_table(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(like.schema).parquet(path)


SCORED = "digest string, pack string, family string, score double, present long, total long, weight_present long, weight_total long, tier_1 long, tier_2 long, tier_3 long"
_HITS = "array<struct<entry_id:int,tier:int,distance:int,pos:int>>"


def _kept(packs: dict[str, tuple[str, dict[int, int]]]) -> Callable:
    """Updates a sample's state: its classes so far, how many it has in all, and each entry's best hit; tells the scores when it is complete.

    packs: of each pack its family and its entries' weights.
    """

    def step(key, frames, state):
        seen, due, best = state.get if state.exists else (0, None, "[]")
        held = {(pack, entry): tuple(hit) for pack, entry, *hit in json.loads(best)}
        for rows in frames:
            seen += int(rows["n"].sum())
            told = rows["due"].dropna()
            due = int(told.iloc[0]) if len(told) else due
            for pack, hits in zip(rows["pack"], rows["hits"]):
                for h in hits if pack is not None and hits is not None else ():
                    hit = (h["tier"], h["distance"], h["pos"])
                    at = (pack, h["entry_id"])
                    held[at] = min(held.get(at, hit), hit)
        if due is None or seen < due:
            state.update((seen, due, json.dumps([[p, int(e), *map(int, hit)] for (p, e), hit in held.items()])))
            return
        state.remove()
        out = []
        for pack, (family, weights) in packs.items():
            mine = {e: hit for (p, e), hit in held.items() if p == pack}
            have, whole = sum(weights[e] for e in mine), sum(weights.values())
            tiers = [sum(hit[0] == t for hit in mine.values()) for t in (1, 2, 3)]
            out.append((key[0], pack, family, have / whole if whole else 0.0, len(mine), len(weights), have, whole, *tiers))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in SCORED.split(", ")])

    return step


def score_arrivals(classes: DataFrame, sizes: DataFrame, entries: DataFrame, meta: DataFrame, out: str, checkpoint: str, radius: int | None = None) -> StreamingQuery:
    """Scores each arriving sample against packs once all its classes are there, in whichever batches they come.

    classes: a stream of signed class rows (digest, ...); sizes (digest, n_classes) tells how many a sample has. A
    batch's classes meet the packs' entries in a join; keyed state holds a sample's best hit of each entry until the sample
    is complete, then its row of every pack is written as `match_family` would score it. The state of a sample is bounded by
    the packs' entries, which come to the driver (an entry's weight each). A sample without a size waits; a sample's classes
    are expected once each. Files of a batch are written once, whatever is retried.
    """
    from kindred.operators.family import detect, pack_radius, scorable

    spark = classes.sparkSession
    radius = pack_radius(meta) if radius is None else radius
    packs: dict[str, tuple[str, dict[int, int]]] = {r["pack"]: (r["family"], {}) for r in meta.select("pack", "family").collect()}
    for r in entries.select("pack", "entry_id", ((F.col("instructions") + 1) * F.col("coverage")).cast("long").alias("w")).collect():
        packs[r["pack"]][1][r["entry_id"]] = r["w"]
    told = spark.createDataFrame([], f"digest string, n long, due long, pack string, hits {_HITS}").schema

    def found(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        hits = detect(scorable(rows), entries, radius).groupBy("digest", "pack").agg(F.collect_list(F.struct("entry_id", "tier", "distance", "pos")).alias("hits"))
        counts = rows.groupBy("digest").agg(F.count("*").alias("n")).join(sizes.select("digest", F.col("n_classes").cast("long").alias("due")), "digest", "left")
        none = F.lit(None)
        lines = counts.select("digest", "n", "due", none.cast("string").alias("pack"), none.cast(_HITS).alias("hits")).unionByName(hits.select("digest", F.lit(0).cast("long").alias("n"), none.cast("long").alias("due"), "pack", "hits"))
        lines.write.mode("overwrite").parquet(f"{out}/hits/part={batch_id}")
        rows.unpersist()

    classes.writeStream.foreachBatch(found).option("checkpointLocation", f"{checkpoint}/hits").trigger(availableNow=True).start().awaitTermination()
    lines = spark.readStream.schema(told).parquet(f"{out}/hits/part=*")
    scored = lines.groupBy("digest").applyInPandasWithState(_kept(packs), SCORED, "seen long, due long, best string", "append", "NoTimeout")
    return scored.writeStream.format("parquet").option("path", f"{out}/scores").option("checkpointLocation", f"{checkpoint}/scores").trigger(availableNow=True).start()
