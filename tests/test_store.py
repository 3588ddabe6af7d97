"""The episode store against its rules."""

import pytest

from loomspark.sources.store import EpisodeStore

EPISODE = "id string, session string, started long, ended long, register string, trust string, summary string, closed_by string"
MEMBER = "id string, path string, role string, ordinal int"
EDGE = "old_id string, new_id string, reason string, source_at long"


def batch(spark, ids):
    episodes = [(i, f"s{i[-1]}", 10 * n, None if n == 2 else 10 * n + 5, "verdict", "high", f"did {i}", "window_end") for n, i in enumerate(ids)]
    members = [(i, p, "touched", k) for i in ids for k, p in enumerate(["a.ts", f"{i}.ts"])]
    return spark.createDataFrame(episodes, EPISODE), spark.createDataFrame(members, MEMBER)


def test_store(spark, tmp_path):
    store = EpisodeStore.create(spark, str(tmp_path / "store"))
    assert store.has("episode_supersessions") and not store.has("nothing")
    assert store.record(*batch(spark, ["e0", "e1", "e2"])) == (3, 0)
    assert store.record(*batch(spark, ["e1", "e3"])) == (1, 1)
    assert store.table("episodes").count() == 4 and store.table("episode_members").count() == 8 and store.table("sessions").count() == 4
    cards = [(r["rank"], r.id) for r in store.recall(["a.ts"]).collect()]
    assert cards == [(1, "e3"), (2, "e1"), (3, "e0"), (4, "e2")]  # e3 ended at 15 like e1, the larger id first; e2 has no known end
    assert store.supersede(spark.createDataFrame([("e0", "e1", "marker", None), ("e2", "e2", "self", 1)], EDGE)) == 1
    assert store.supersede(spark.createDataFrame([("e0", "e3", "late", 7)], EDGE)) == 0
    assert store.supersede(spark.createDataFrame([("e0", "e1", "again", 9)], EDGE)) == 1
    assert store.supersede(spark.createDataFrame([("e0", "e1", "again", 11)], EDGE)) == 0
    assert [tuple(r) for r in store.supersessions().collect()] == [("e0", "e1", "marker", 9)]
    served = spark.createDataFrame([("e3",)], "id string")
    assert [r.id for r in store.recall(["a.ts"], served=served).collect()] == ["e1", "e2"]
    assert [r.id for r in store.recall(["e3.ts", "zzz"]).collect()] == ["e3"] and store.recall(["a.ts"], budget=10).count() == 0
    again = EpisodeStore.create(spark, str(tmp_path / "store"))
    assert again.table("episodes").count() == 4 and again.written == 4 - 1
    again.close()
    assert not again.has("episodes")
    with pytest.raises(ValueError, match="closed"):
        again.table("episodes")
