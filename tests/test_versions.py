"""A refresh is seen as a whole or not at all, whenever it is stopped."""

import pytest
from pyspark.sql import functions as F

from cashweave.plans import pipeline, versions
from cashweave.plans.pipeline import PipelineConfig, run_pipeline
from cashweave.plans.versions import Piece, Snapshot, StaleVersion, Versions
from test_pipeline import raw  # noqa: F401


def contents(spark, database):
    names = [t.name for t in spark.catalog.listTables(database) if not t.isTemporary]
    return {n: sorted(map(str, spark.table(f"{database}.{n}").collect())) for n in sorted(names)}


def test_a_refresh_killed_between_layers_changes_nothing(spark, raw, tmp_path, monkeypatch):  # noqa: F811
    cfg = PipelineConfig(str(raw), "cw_kill", str(tmp_path / "db"), model={"trees": 2})
    counts = run_pipeline(spark, cfg)
    before = contents(spark, "cw_kill")
    assert set(counts) == set(before)
    stages = list(pipeline.STAGES)

    def lost(tables, cfg):
        raise RuntimeError("driver lost")

    changed = tmp_path / "changed"
    changed.mkdir()
    for file in raw.iterdir():  # another day's files: fewer products, other sales
        (changed / file.name).write_text("\n".join(file.read_text().splitlines()[:-1]) + "\n")
    other = PipelineConfig(str(changed), "cw_kill", str(tmp_path / "db"), model={"trees": 2})
    for layer in range(1, 4):
        monkeypatch.setattr(pipeline, "STAGES", (*stages[:layer], lost))
        with pytest.raises(RuntimeError, match="driver lost"):
            run_pipeline(spark, other)
        assert contents(spark, "cw_kill") == before
    monkeypatch.setattr(pipeline, "STAGES", tuple(stages))
    run_pipeline(spark, other)
    after = contents(spark, "cw_kill")
    assert after != before and after.keys() == before.keys()
    # what the killed refreshes wrote is gone, and so is all but the last two versions
    left = {int(n.rpartition("__v")[2]) for n in Versions(spark, "cw_kill")._stored() if "__v" in n}
    assert left == {1, 5}


def test_a_kill_right_after_the_switch_is_finished_by_sync(spark, tmp_path, monkeypatch):
    v = Versions(spark, "cw_switch", str(tmp_path / "db"))
    first = v.begin()
    for name in ("x", "y"):
        first.write(name, spark.createDataFrame([("A", 1), ("B", 2)], "tenant_id string, v int"), partition_by=["tenant_id"])
    held = first.publish()
    second = v.begin()
    for name in ("x", "y"):
        second.write(name, spark.createDataFrame([("A", 7)], "tenant_id string, v int"))
    monkeypatch.setattr(Versions, "sync", lambda self: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        second.publish()
    monkeypatch.undo()
    now = v.published()
    assert [now(n).count() for n in ("x", "y")] == [1, 1]  # a snapshot has both tables of the new version
    assert [held(n).count() for n in ("x", "y")] == [2, 2]  # and an older one still both of its own
    for _ in range(2):
        v.sync()
        assert [spark.table(f"cw_switch.{n}").count() for n in ("x", "y")] == [1, 1]


def test_a_failed_write_and_a_lost_race_publish_nothing(spark, tmp_path):
    v = Versions(spark, "cw_race", str(tmp_path / "db"))
    df = spark.createDataFrame([("A", 1)], "tenant_id string, v int")
    slow, fast = v.begin(), v.begin()
    assert slow.number != fast.number
    slow.write("x", df)
    with pytest.raises(Exception, match="no such"):
        slow.write("y", df.select(F.raise_error(F.lit("no such")).alias("tenant_id")))
    fast.write("x", df.withColumn("v", F.lit(2)))
    fast.publish()
    with pytest.raises(StaleVersion):
        slow.publish()
    assert [r["v"] for r in spark.table("cw_race.x").collect()] == [2]
    assert "y" not in v.published() and not spark.catalog.tableExists("cw_race.y")


def test_tenants_cover_older_pieces_and_are_folded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versions, "FOLD_AFTER", 2)
    v = Versions(spark, "cw_cover", str(tmp_path / "db"))
    schema = "tenant_id string, v int"
    whole = v.begin()
    whole.write("x", spark.createDataFrame([("007", 0), ("A'", 0), ("B", 0), (None, 0)], schema), partition_by=["tenant_id"])
    whole.publish()
    want = {"007": [0], "A'": [0], "B": [0], None: [0]}
    for step, (tenant, rows) in enumerate([("A'", [1, 1]), ("007", [2]), ("A'", []), ("B", [3]), ("new", [4])], 1):
        draft = v.begin(tenant)
        more = "" if step < 4 else ", note string"
        data = [(tenant, r) + ((f"n{r}",) if more else ()) for r in rows]
        assert draft.write("x", spark.createDataFrame(data, schema + more), partition_by=["tenant_id"]) == len(rows)
        want[tenant] = rows
        assert sorted(r["v"] for r in draft("x").collect()) == sorted(sum(want.values(), []))
        draft.publish()
        got = {}
        for r in spark.table("cw_cover.x").collect():
            got.setdefault(r["tenant_id"], []).append(r["v"])
        assert got == {k: x for k, x in want.items() if x}
        pieces = v.published().pieces["x"]
        assert sum(p.tenant_id is not None for p in pieces) <= 2
        if step == 4:
            assert pieces == (Piece(f"cw_cover__versions.x__v{draft.number}"),)  # three tenants: folded
    assert {r["note"] for r in spark.table("cw_cover.x").collect()} == {None, "n3", "n4"}


def test_covered():
    whole, a, b = Piece("x__v1"), Piece("x__v2", "A"), Piece("x__v3", "B")
    assert versions.covered((whole, a, b), Piece("x__v4", "A")) == (whole, b, Piece("x__v4", "A"))
    assert versions.covered((whole, a, b), Piece("x__v4")) == (Piece("x__v4"),)


def test_nothing_is_published_at_first(spark, tmp_path):
    v = Versions(spark, "cw_none", str(tmp_path / "db"))
    assert v.published().pieces == {} and v.vacuum() == [] and isinstance(v.published(), Snapshot)
