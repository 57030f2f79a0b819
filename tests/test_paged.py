"""The paged listing: which pages are asked for, what a resumed run reads, and answers that go wrong."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from vellum.plans import harvests
from vellum.sources import paged

SIZE = 4


@pytest.fixture
def site():
    """A listing over HTTP that notes every start that was asked for."""
    state = {"total": 0, "asked": [], "broken": set()}

    class Answers(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            start = int(self.path.rsplit("/", 1)[1])
            state["asked"].append(start)
            records = [{"pointer": i, "title": f"t{i}" if i % 3 else None, "extra": [1]} for i in range(start, min(start + SIZE, state["total"] + 1))]
            body = json.dumps({"pager": {"total": state["total"]}, "records": records}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body[:-5] if start in state["broken"] else body)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    state["url"] = f"http://127.0.0.1:{server.server_port}/{{start}}"
    yield state
    server.shutdown()
    server.server_close()



def test_every_record_once(spark, site):
    site["total"] = 18
    for per_task in (1, 3, 99):
        rows = paged.listing(spark, site["url"], SIZE, per_task).collect()
        assert sorted(r.pointer for r in rows) == list(range(1, 19))
        assert all(r.page_start == r.pointer - r.pos and (r.title is None) == (r.pointer % 3 == 0) and r.filetype is None for r in rows)
    assert paged.listing(spark, site["url"], SIZE).rdd.getNumPartitions() == 5


@pytest.mark.parametrize(
    ("where", "starts"),
    [("page_start > 5", {9, 13, 17}), ("page_start >= 5 AND page_start < 13", {5, 9}), ("page_start = 9", {9}), ("page_start IN (13, 14, 99)", {13}), ("page_start <= 4 AND pointer > 2", {1}), ("page_start > 99", set())],
)
def test_filters_choose_the_pages_asked_for(spark, site, where, starts):
    site["total"] = 18
    got = paged.listing(spark, site["url"], SIZE).where(where).collect()
    assert {r.page_start for r in got} == starts
    assert set(site["asked"]) <= starts | {1}  # the first answer tells the total
    assert len(got) == sum(min(SIZE, 19 - s) - (2 if "pointer" in where else 0) for s in starts)


def test_a_resumed_run_asks_for_missing_pages_only(spark, site, tmp_path):
    site["total"] = 39
    folder = str(tmp_path / "stored")
    paged.listing(spark, site["url"], SIZE).where("page_start IN (1, 5, 17, 37)").write.parquet(folder)
    stored = spark.read.schema(paged.LISTING).parquet(folder)
    assert paged.missing_ranges(stored, 39, SIZE) == [[9, 13], [21, 33]]
    site["asked"].clear()
    assert paged.harvest(spark, site["url"], folder, stored, SIZE) == [[9, 13], [21, 33]]
    assert {s for s in site["asked"] if s > 1} == {9, 13, 21, 25, 29, 33}
    whole = spark.read.schema(paged.LISTING).parquet(folder)
    assert sorted(r.pointer for r in whole.collect()) == list(range(1, 40))
    site["asked"].clear()
    paged.harvest(spark, site["url"], folder, whole, SIZE)
    assert set(site["asked"]) == {1} and spark.read.parquet(folder).count() == 39


def test_a_task_takes_its_pages_over_holes(spark, site):
    site["total"] = 400
    holes = [[s, s] for s in range(1, 401, 8)]  # every other page
    rows = paged.listing(spark, site["url"], SIZE, 10, holes)
    assert rows.rdd.getNumPartitions() == 5
    assert sorted(r.page_start for r in rows.collect()) == sorted(s for s, _ in holes for _ in range(SIZE))
    rows = paged.listing(spark, site["url"], SIZE, 10, [[1, 45], [53, 201]])
    assert rows.rdd.getNumPartitions() == 5 and sorted(r.pointer for r in rows.collect()) == [*range(1, 49), *range(53, 205)]


def test_the_harvest_runs_fewer_tasks_than_pages(spark, tmp_path, monkeypatch):
    rows = spark.range(1, 20_001).selectExpr("id AS c_custkey", "concat('c', id) AS c_name", "'m' AS c_mktsegment")
    rows.write.parquet(f"{tmp_path}/customer.parquet")
    monkeypatch.setattr(harvests, "new_folder", lambda spark, name: f"{tmp_path}/{name}")
    got = harvests.catalog_harvest(spark, str(tmp_path))
    assert sorted(r.pointer for r in got.collect()) == list(range(1, 20_001))
    # 200 and 201 pages; a task stores one file.
    assert [len(list(tmp_path.glob(f"listing/stored/run={n}/*.parquet"))) for n in (1, 2)] == [2, 3]


def test_an_empty_listing_and_a_broken_answer(spark, site):
    assert paged.listing(spark, site["url"], SIZE).collect() == []
    site["total"], site["broken"] = 18, {9}
    with pytest.raises(Exception, match="JSON|delimiter|Expecting"):
        paged.listing(spark, site["url"], SIZE).collect()
    assert paged.listing(spark, site["url"], SIZE).where("page_start < 9").count() == 8
