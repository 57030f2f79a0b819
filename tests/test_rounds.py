"""Rounds of an edition hold together: nothing is cited or taken twice, and the deals go on from one another."""

import os

from vellum.plans import rounds

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_rounds_build_on_one_another(spark):
    rows = rounds.edition_rounds(spark, SF).collect()
    assert rows and {r["round"] for r in rows} == {1, 2, 3, 4}
    for issue in {r.issue_id for r in rows}:
        own = [r for r in rows if r.issue_id == issue]
        firsts = [r for r in own if r.place == 1]
        cited = [i for r in firsts for i in r.refs.split(",")]
        assert len(cited) == len(set(cited)) and "" not in cited
        assert len({r.card for r in firsts}) == len(firsts)
        for r in own:
            assert r.place <= rounds.DEAL and r.fresh > 0 and (r.refs != "") == (r.place == 1)
            assert not any(f.card == r.card and f["round"] < r["round"] for f in firsts)
            assert len(r.refs.split(",")) <= min(rounds.REFS, r.fresh) or r.place > 1
        # A round deals three cards unless it has run out of them, in places without gaps.
        for n in range(1, 5):
            places = sorted(r.place for r in own if r["round"] == n)
            assert places == list(range(1, len(places) + 1))
