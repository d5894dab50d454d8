import pytest

from kinweave.operators import ingest as ing
from kinweave.plans import EDGES
from kinweave.sources import events_from_rows, read_events
from tests.graphs import EDA, BOB, FOX, TOM, SUE, event


def edges_after(spark, *calls, strict=False):
    edges = spark.createDataFrame([], EDGES)
    for call in calls:
        edges = ing.ingest(edges, events_from_rows(spark, call), strict=strict)
    return {(r[0], r[1]) for r in edges.collect()}


@pytest.mark.parametrize(
    ("bad", "says"),
    [
        (None, "Event is required"),
        ({"kind": 1}, "Expected Kind 3 event, got Kind 1"),
        ({"kind": 3, "created_at": "x", "tags": []}, "Invalid created_at"),
        ({"kind": 3, "created_at": -1, "tags": []}, "Invalid created_at"),
        ({"kind": 3, "created_at": 1, "tags": "x"}, "Invalid tags"),
    ],
)
def test_one_bad_event_rejects_the_call(spark, bad, says):
    with pytest.raises(ValueError, match=says):
        events_from_rows(spark, [event(EDA, [FOX]), bad])


def test_frames_are_validated(spark):
    good = events_from_rows(spark, [event(EDA, [FOX], at=0)])
    ing.validate(good)
    for column, value, says in (("kind", "1", "got Kind 1"), ("created_at", "-1L", "created_at"), ("tags", "cast(null as array<array<string>>)", "tags")):
        with pytest.raises(ValueError, match=says):
            ing.validate(good.withColumn(column, __import__("pyspark.sql.functions", fromlist=["expr"]).expr(value)))


def test_tags(spark):
    tags = [["p"], ["p", "bad"], ["e", FOX], [], ["p", FOX.upper(), "wss://x", "name"], ["p", FOX], ["p", SUE], "x", [1, 2],
            ["P", TOM], ["p", TOM[:63] + "g"], ["p", TOM + "0"]]
    assert edges_after(spark, [event(EDA, [], tags=tags)]) == {(EDA, FOX), (EDA, SUE)}
    assert edges_after(spark, [event(EDA, [])]) == set()


def test_latest_event_within_a_call(spark):
    assert edges_after(spark, [event(EDA, [FOX], 1), event(EDA, [SUE], 4102444800)]) == {(EDA, SUE)}
    assert edges_after(spark, [event(EDA, [FOX]), event(EDA, [SUE])]) == {(EDA, FOX)}
    # A newer empty list shadows the older one of the same call.
    assert edges_after(spark, [event(EDA, [FOX], 1), event(EDA, [], 2)]) == set()


def test_replacement_across_calls(spark):
    first, later = [event(EDA, [FOX, TOM], 2000), event(BOB, [EDA])], [event(EDA, [SUE], 1000)]
    assert edges_after(spark, first, later) == {(EDA, SUE), (BOB, EDA)}
    assert edges_after(spark, first, [event(EDA, [], 3000)]) == {(EDA, FOX), (EDA, TOM), (BOB, EDA)}
    assert edges_after(spark, first, later, strict=True) == {(EDA, FOX), (EDA, TOM), (BOB, EDA)}
    assert edges_after(spark, first, [event(EDA, [], 3000)], strict=True) == {(BOB, EDA)}


def test_author_is_kept_as_is(spark):
    assert edges_after(spark, [event(EDA.upper(), [FOX])]) == {(EDA.upper(), FOX)}


def test_json_lines(spark, tmp_path):
    import json

    (tmp_path / "e.jsonl").write_text("\n\n".join(json.dumps(event(k, [FOX])) for k in (EDA, BOB)) + "\n")
    kept = ing.latest_per_author(read_events(spark, str(tmp_path)), "id")
    assert ing.follows_of(kept).count() == 2


def test_broken_json_lines_are_not_lost_in_silence(spark, tmp_path):
    import json

    good = [json.dumps(event(k, [FOX])) for k in (EDA, BOB)]
    (tmp_path / "e.jsonl").write_text("\n".join([good[0], "", '{"pubkey": "x", "tags": [', "   ", good[1], '{"created_at": "late"}']) + "\n")
    path = str(tmp_path)
    assert {r["pubkey"] for r in read_events(spark, path, "drop").collect()} == {EDA, BOB}
    kept = read_events(spark, path, "keep")
    assert kept.filter("broken is not null").count() == 2 and kept.count() == 4
    with pytest.raises(Exception, match="not an event: "):
        ing.latest_per_author(read_events(spark, path), "id").collect()
    with pytest.raises(ValueError, match="broken must be"):
        read_events(spark, path, "ignore")


def test_only_newest_lists_are_combined(spark):
    """Tags of all events went through the sort and the shuffle of the aggregate."""
    rows = [event(k, [FOX] * (1 + i % 3), at=1000 + i % 20) for i in range(60) for k in (EDA, BOB)]
    frame = events_from_rows(spark, rows)
    first, again = frame.select("pubkey", "created_at", "tags", "ord"), frame.select("pubkey", "created_at", "tags", "ord").limit(1)
    ties = first.unionByName(again)  # one event twice, in all columns
    nulls = spark.createDataFrame([(None, 5, [["p", FOX]], 1), (None, None, [["p", TOM]], 2), (SUE, 7, [["p", TOM]], None)], first.schema)
    got = {(x["pubkey"], x["created_at"], x["ord"], len(x["tags"])) for x in ing.latest_per_author(ties.unionByName(nulls)).collect()}
    assert got == {(EDA, 1019, 38, 2), (BOB, 1019, 39, 2), (None, None, 2, 1), (SUE, 7, None, 1)}
    twins = ing.latest_per_author(again.unionByName(again))
    assert twins.count() == 1
    plan = ing.latest_per_author(frame)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan
    lean = plan.split("LeftSemi")[1].split("Aggregate")[1]  # the side that finds the newest
    assert "tags" not in lean.split("\n")[0] and "tags" not in lean.split("\n")[1]


def test_events_are_read_for_one_call_only_as_often_as_needed(spark):
    """The kept events were made anew for the authors and for the edges of a call."""
    made = spark.sparkContext.accumulator(0)
    frame = events_from_rows(spark, [event(EDA, [FOX]), event(BOB, [FOX, TOM])])

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    for strict in (False, True):
        made.value = 0
        old = spark.createDataFrame([(EDA, SUE, 1), (TOM, SUE, 1)], EDGES)
        got = {(r[0], r[1]) for r in ing.ingest(old, frame.mapInArrow(count, frame.schema), strict=strict).collect()}
        assert got == {(EDA, FOX), (BOB, FOX), (BOB, TOM), (TOM, SUE)} and made.value <= 4
