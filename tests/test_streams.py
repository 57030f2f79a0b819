"""Streams with restarts, replays, disorder and late rows."""

import datetime
import json

from pyspark.sql import functions as F

from vellum.sources.folders import new_folder
from vellum.streaming import frames, ledger, sinks

T0 = datetime.datetime(2024, 1, 1)


def delta(text):
    return "data: " + json.dumps({"type": "content_block_delta", "delta": {"type": "text_delta", "text": text}}) + "\n\n"


def fed(spark, folder, kind, rows):
    spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{folder}/feed")


def test_whole_lines_only_become_frames():
    assert frames.frame_text(delta("a\n\"é").strip()) == ("text", 'a\n"é')
    assert frames.frame_text('data: {"type": "error", "error": {"message": "overloaded"}}') == ("error", "overloaded")
    for line in ("", ": comment", "data:", "data: [DONE]", "data: {", "data: 3", 'data: {"type": "message_stop"}', "event: delta", 'data: {"type": "content_block_delta", "delta": {"type": "other"}}'):
        assert frames.frame_text(line) is None


def test_frames_over_restarts_disorder_and_replays(spark):
    folder = new_folder(spark, "frames")
    texts = ["first", "second é\n", "", "third"]
    whole = "".join(delta(t) for t in texts) + 'data: {"type": "error", "error": {"message": "broke"}}\n' + delta("unfinished")[:-8]
    cut = [whole[i : i + 11] for i in range(0, len(whole), 11)]
    rows = [(1, n, T0 + datetime.timedelta(seconds=n), c) for n, c in enumerate(cut)]
    runs = [
        [rows[k] for k in (3, 1, 0, 7, 7)] + [(2, 0, T0, delta("whole"))],
        [rows[k] for k in (2, 0, 3, 5, 4)] + [(3, 1, T0, "never reached")],
        rows[6:] + rows[:4],
    ]
    seen = []
    with sinks.keyed_state(spark):
        for run in [*runs, [(9, 0, T0 + datetime.timedelta(days=2), "")]]:
            fed(spark, folder, frames.CHUNK, run)
            sinks.drained(frames.frames_of(spark.readStream.schema(frames.CHUNK).parquet(f"{folder}/feed")), folder)
            seen.append(sorted(tuple(r) for r in sinks.sunk(spark, f"{folder}/rows", frames.FRAME).collect()))
    done = [(1, i, "text", t) for i, t in enumerate(texts)] + [(1, 4, "error", "broke"), (2, 0, "text", "whole")]
    assert seen[2] == sorted(done) and set(seen[0]) <= set(seen[1]) <= set(seen[2])
    assert seen[3] == sorted([*done, (1, 5, "unfinished", None)], key=lambda r: r[:2])


def test_a_long_conversation_leaves_the_others_their_chunks(spark, tmp_path):
    # 20 characters a chunk: the long one has over a thousand; the short ones' later chunks come after most of its own.
    rows = [(13, t, "user", f"{t} " + "long words " * 400) for t in range(6)]
    rows += [(c, t, "user", f"short turn {t} of {c}") for c in (7, 10, 15, 21, 40) for t in range(3)]
    spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(tuple(r) for r in frames.stream_frames(spark, str(tmp_path)).collect())
    broken = {(c, max(t for d, t, *_ in rows if d == c)) for c in (10, 40)}
    assert got == sorted((c, t, "unfinished", None) if (c, t) in broken else (c, t, "text", text) for c, t, _, text in rows)


def test_a_replayed_batch_changes_nothing(spark):
    folder, rows = new_folder(spark, "sink"), spark.range(5).withColumn("x", F.col("id") * 2)
    write = sinks.batch_sink(folder)
    for number in (0, 1, 1, 0):
        write(rows.where(F.col("id") % 2 == number), number)
    assert sorted(r.id for r in sinks.sunk(spark, folder, "id bigint, x bigint").collect()) == [0, 1, 2, 3, 4]


def test_ledger_counts_late_calls_apart_and_forgets_closed_days(spark):
    folder, held = new_folder(spark, "ledger"), []
    for day in range(8):
        at = T0 + datetime.timedelta(days=day)
        calls = [(day * 10 + i, at + datetime.timedelta(hours=i), "abc"[i % 3], 1.5) for i in range(9)]
        late = [(900 + day, T0 + datetime.timedelta(hours=1), "a", 1.0)] + [(800 + day, at - datetime.timedelta(days=1), "b", 1.0)] * (day > 0)
        fed(spark, folder, ledger.CALL, calls + late)
        _, rollup = ledger.run_ledger(spark, folder)
        held.append(rollup.lastProgress["stateOperators"][0]["numRowsTotal"])
    got = {(r.day, r.step): (r.calls, r.value, r.late) for r in ledger.closed_days(spark, folder).collect()}
    # The first day closes after the fourth delivery, whose own first-day call still counts as it comes.
    assert set(got) == {(f"2024-01-0{d}", s) for d in range(1, 6) for s in "abc"}
    assert sum(v[2] for v in got.values()) == got["2024-01-01", "a"][2] > 0
    assert got["2024-01-01", "a"][0] + got["2024-01-01", "a"][2] == 3 + 8
    assert got["2024-01-02", "b"] == (4, 5.5, 0) and got["2024-01-03", "c"] == (3, 4.5, 0)
    assert max(held) <= 3 * 4 and held[-1] == held[-2] == held[-3]
