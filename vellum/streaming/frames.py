"""Partial frames of running answers: chunks in, whole frames out, as a stream with state by conversation.

An answer comes as `data: {json}` lines, cut anywhere. State holds the unfinished line of
each conversation, the number of its next chunk and chunks that came ahead of it. A line ends a frame; a frame that
isn't JSON is passed over, as are comments and `[DONE]`. When a conversation has been silent for
`patience` of event time, its unfinished line is given up, reported, and its state deleted.
Chunks that come again (a replay) are passed over.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vellum.sources.folders import new_folder
from vellum.sources.tables import table
from vellum.streaming.sinks import drained, keyed_state, sunk

CHUNK = "conv_id bigint, n bigint, at timestamp, chunk string"
FRAME = "conv_id bigint, frame bigint, status string, text string"


def frame_text(line: str) -> tuple[str, str | None] | None:
    """(status, text) of a whole line: a text delta or an error; None for all else."""
    if not line.startswith("data:"):
        return None
    payload = line[5:].strip()
    if not payload or payload == "[DONE]":
        return None
    try:
        event = json.loads(payload)
    except json.JSONDecodeError:
        return None
    if not isinstance(event, dict):
        return None
    if event.get("type") == "error":
        return "error", (event.get("error") or {}).get("message")
    delta = event.get("delta") or {}
    if event.get("type") == "content_block_delta" and delta.get("type") == "text_delta" and delta.get("text") is not None:
        return "text", delta["text"]
    return None


class Frames(StatefulProcessor):
    """Chunks of one conversation to frames, in the order of the chunks' numbers."""

    def __init__(self, patience_ms: int) -> None:
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "rest string, next bigint, frames bigint, alarm bigint")
        self.ahead = handle.getMapState("ahead", "n bigint", "chunk string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        rest, following, frames, alarm = self.open.get() if self.open.exists() else ("", 0, 0, None)
        seen, latest = {}, 0
        for row in rows:
            latest = max(latest, int(row.at.timestamp() * 1000))
            if row.n >= following:
                seen[row.n] = row.chunk or ""
        while following in seen or self.ahead.containsKey((following,)):
            if following in seen:
                rest += seen.pop(following)
            else:
                rest += self.ahead.getValue((following,))[0]
                self.ahead.removeKey((following,))
            following += 1
        for n, chunk in seen.items():
            self.ahead.updateValue((n,), (chunk,))
        *lines, rest = rest.split("\n")
        for line in lines:
            found = frame_text(line)
            if found:
                yield Row(conv_id=key[0], frame=frames, status=found[0], text=found[1])
                frames += 1
        if alarm is not None:
            self.handle.deleteTimer(alarm)
        alarm = max(alarm or 0, latest + self.patience_ms)
        self.handle.registerTimer(alarm)
        self.open.update((rest, following, frames, alarm))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        rest, _, frames, _ = self.open.get()
        if rest.strip():
            yield Row(conv_id=key[0], frame=frames, status="unfinished", text=None)
        self.open.clear()
        self.ahead.clear()

    def close(self) -> None:
        pass


def frames_of(chunks: DataFrame, patience: str = "10 minutes", patience_ms: int = 600_000) -> DataFrame:
    """A stream of chunks (CHUNK) to a stream of frames (FRAME)."""
    keyed = chunks.withWatermark("at", patience).groupBy("conv_id")
    return keyed.transformWithState(Frames(patience_ms), FRAME, "Append", "EventTime")


#: Seconds over which an answer is sent: less than the patience, so that no long answer's clock runs past another's chunks.
SENT_IN = 300


def as_chunks(turns: DataFrame, size: Column, lose: Column) -> DataFrame:
    """turns (conv_id, turn, text) as the chunks in which a service might send them, `size` characters each; the last
    `lose` characters never come. All answers are sent at one time, each over SENT_IN seconds, however many its chunks."""
    event = F.struct(F.lit("content_block_delta").alias("type"), F.struct(F.lit("text_delta").alias("type"), F.col("text")).alias("delta"))
    line = F.concat(F.when(F.col("turn") % 3 == 1, ": still here\n").otherwise("event: delta\n"), F.lit("data: "), F.to_json(event), F.lit("\n\n"))
    whole = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda t: t["line"]), "").alias("all"))
    sent = whole.withColumn("sent", F.substring("all", F.lit(1), F.length("all") - lose)).withColumn("size", size)
    chunks = F.ceil(F.length("sent") / F.col("size"))
    at = sent.select("conv_id", "sent", "size", chunks.alias("chunks"), F.posexplode(F.sequence(F.lit(1), F.length("sent"), F.col("size"))).alias("n", "first"))
    return at.select("conv_id", F.col("n").cast("long").alias("n"), F.timestamp_seconds(1_700_000_000 + SENT_IN * F.col("n") / F.col("chunks")).alias("at"), F.substring("sent", F.col("first"), F.col("size")).alias("chunk"))


#: Waves in which the chunks arrive, the last of which only says that time has passed.
WAVES = 2


def stream_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations cut at odd places and read back as frames, over several runs of one stream.

    Every tenth conversation breaks off within its last frame; every seventh sends its last chunk first.
    """
    c = F.col("conv_id")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    chunks = as_chunks(turns, (c % 23 + 7).cast("int"), F.when(c % 10 == 0, 5).otherwise(0))
    last = F.max("n").over(Window.partitionBy("conv_id"))
    wave = F.when((c % 7 == 0) & (F.col("n") == last), 0).otherwise(F.floor(F.col("n") * WAVES / (last + 1)))
    folder = new_folder(spark, "frames")
    chunks.withColumn("wave", wave).write.partitionBy("wave").parquet(f"{folder}/waves")
    with keyed_state(spark):
        for number in range(WAVES + 1):
            new = spark.read.schema(f"{CHUNK}, wave int").parquet(f"{folder}/waves").where(F.col("wave") == number).drop("wave")
            if number == WAVES:  # a conversation of no interest, days later
                new = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("n"), F.timestamp_seconds(F.lit(1_800_000_000)).alias("at"), F.lit("").alias("chunk"))
            new.write.mode("append").parquet(f"{folder}/feed")
            drained(frames_of(spark.readStream.schema(CHUNK).parquet(f"{folder}/feed")), folder)
    return sunk(spark, f"{folder}/rows", FRAME)


QUERIES = {"stream_frames": stream_frames}
ORACLE_SQL = {
    "stream_frames": """WITH t AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS frame, turn = max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations)
      SELECT conv_id, frame, CASE WHEN last AND conv_id % 10 = 0 THEN 'unfinished' ELSE 'text' END AS status, CASE WHEN last AND conv_id % 10 = 0 THEN NULL ELSE text END AS text FROM t""",
}
