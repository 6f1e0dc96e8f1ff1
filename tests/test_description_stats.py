from __future__ import annotations

from dayweave.operators import responses


def test_names_of_an_activity_are_listed(spark):
    rows = [(1, "coding", ["b", "a"], ["t"]), (1, "coding", ["a", None], None), (None, "coding", None, [])]
    obs = spark.createDataFrame(rows, "recording_id int, activity_type string, apps array<string>, topics array<string>")
    got = {r.recording_id: (r.frames, r.apps, r.topics) for r in responses.description_stats(obs, ["recording_id"]).collect()}
    assert got == {1: (2, ["a", "b"], ["t"]), None: (1, [], [])}
