"""Builds that follow changes equal builds of everything."""

import json
import random

from pyspark.sql import functions as F

from quillstone.durable import durable
from quillstone.operators import build, follow, graph

EDGE = "parent_level int, parent_id long, child_level int, child_id long, relation string, weight double"


def event_nodes(spark, events):
    meta = lambda p: json.dumps({"source_type": "note", "source_uri": f"/v/{p}/n.md"})
    rows = [(k, 1, "event", f"t{k}", None if d is None else f"2024-01-{d:02d} 00:00:00", meta(p)) for k, (p, d) in sorted(events.items())]
    made = spark.createDataFrame(rows, "node_id long, level int, node_type string, title string, s string, metadata_json string")
    return spark.createDataFrame([], build.NODE).unionByName(made.withColumn("time_start", F.col("s").cast("timestamp")).drop("s"), allowMissingColumns=True)


def concept_edges(spark, of):
    return spark.createDataFrame([(3, c, 1, k, "contains", 1.0) for k, cs in sorted(of.items()) for c in cs], EDGE)


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_changes_equal_whole_builds(spark):
    rng = random.Random(2)
    draw = lambda: (rng.choice("abcdef"), rng.choice([None, *range(1, 28)]))
    events, of = {k: draw() for k in range(1, 41)}, {k: rng.sample(range(900, 906), rng.randint(0, 2)) for k in range(1, 41)}
    nodes, edges = build.episodes(event_nodes(spark, events), concept_edges(spark, of))
    edges = durable(graph.concept_links(edges))
    for batch in range(3):
        before, before_of = dict(events), dict(of)
        for k in rng.sample(sorted(events), 3):
            events[k] = draw()
        lost = rng.sample(sorted(events), 3)
        events = {k: e for k, e in events.items() if k not in lost} | {100 * (batch + 1) + k: draw() for k in range(2)}
        for k in [*rng.sample(sorted(events), 2), *(set(events) - set(before))]:
            of[k] = rng.sample(range(900, 906), rng.randint(0, 2))
        of = {k: c for k, c in of.items() if k in events}
        differ = [(k, e[k][0]) for k in {*events, *before} if events.get(k) != before.get(k) for e in (events, before) if k in e]
        changed = spark.createDataFrame(differ, "event_id long, project string").withColumn("project", F.concat(F.lit("/v/"), "project"))
        now = durable(nodes.where("level <> 1").unionByName(event_nodes(spark, events)))
        moved = lambda a, b: spark.createDataFrame([(3, c, 1, k, "contains", 1.0) for k in a for c in a[k] if c not in b.get(k, [])], EDGE)
        went, came = moved(before_of, of), moved(of, before_of)
        # Everything made anew, from the same state.
        all_nodes, all_edges = build.episodes(now, follow.drop_events(now, edges, spark.createDataFrame([(k,) for k in lost], "event_id long"))[1].join(went.drop("weight"), follow._LINK, "left_anti").unionByName(came))
        all_edges = durable(graph.concept_links(all_edges))
        # The change alone, with the edges of lost events still there.
        change = {k: durable(df) for k, df in follow.episodes(now, edges, changed).items()}
        named = {r.title.split(":")[0] for r in change["came"].collect()}
        assert named <= {p for _, p in differ} and change["came"].count() < now.where("level = 2").count()
        gone_edges = change["gone_edges"].unionByName(went.select(follow._LINK))
        came_edges = change["came_edges"].unionByName(came, allowMissingColumns=True)
        related = {k: durable(df) for k, df in follow.links(edges, gone_edges, came_edges).items()}
        got_nodes, got_edges = follow.applied(now, edges, {**change, "gone_edges": gone_edges, "came_edges": came_edges})
        got_nodes, got_edges = follow.applied(got_nodes, got_edges, related)
        assert rows_of(got_nodes, "node_id", "level", "title", "content", "fingerprint") == rows_of(all_nodes, "node_id", "level", "title", "content", "fingerprint")
        assert rows_of(got_edges.where("relation = 'relates_to'"), *follow._LINK, "weight") == rows_of(all_edges.where("relation = 'relates_to'"), *follow._LINK, "weight")
        assert rows_of(got_edges.where("relation = 'contains'"), *follow._LINK) == rows_of(all_edges.where("relation = 'contains'"), *follow._LINK)
        nodes, edges = durable(got_nodes), durable(got_edges)


def test_events_that_were_dropped_before(spark):
    """An episode none of whose events is left goes, though its edges went with them; no change changes nothing."""
    events = {1: ("a", 1), 2: ("a", 1), 3: ("a", 9), 4: ("b", 1)}
    nodes, edges = build.episodes(event_nodes(spark, events), spark.createDataFrame([], EDGE))
    gone = spark.createDataFrame([(3, "/v/a")], "event_id long, project string")
    left, left_edges = follow.drop_events(nodes, edges, gone)
    change = follow.episodes(left, left_edges, gone)
    assert change["gone"].count() == 1 and change["came"].count() == 0 and change["came_edges"].count() == 0
    after, _ = follow.applied(left, left_edges, change)
    assert {r.title for r in after.where("level = 2").collect()} == {"a: 2 events, 2024-01-01", "b: 1 event, 2024-01-01"}
    none = follow.episodes(nodes, edges, gone.limit(0))
    assert none["gone"].count() == none["came"].count() == none["gone_edges"].count() == 0
    still = follow.links(edges.withColumn("weight", F.lit(1.0)), edges.limit(0), edges.limit(0))
    assert still["gone_edges"].count() == still["came_edges"].count() == 0


def test_links_count_pairs_once(spark, monkeypatch):
    """Memberships that come, go, do both or are given twice, in one pass over pairs; equal to the relations of all edges."""
    rng = random.Random(5)
    member = lambda n: {(level, rng.randint(1, 6) + 10 * level, 1, rng.randint(1, 30), "contains", 1.0) for _ in range(n) for level in (2, 3)}
    before, came = member(40), member(8)
    went = set(rng.sample(sorted(before), 12)) | set(sorted(before & came)[:1]) | {(3, 39, 1, 99, "contains", 1.0)}
    made = lambda rows: graph.concept_links(spark.createDataFrame(sorted(rows), EDGE))
    edges, met = durable(made(before)), []
    monkeypatch.setattr(graph, "_meetings", lambda *a, f=graph._meetings: met.append(a) or f(*a))
    twice = lambda rows: spark.createDataFrame(sorted(rows) * 2, EDGE)
    change = follow.links(edges, twice(went), twice(came))
    assert len(met) == 1
    monkeypatch.undo()
    got = follow.applied(edges, edges, change)[1].where("relation = 'relates_to'")
    want = made((before - went) | came).where("relation = 'relates_to'")
    assert rows_of(got, *follow._LINK, "weight") == rows_of(want, *follow._LINK, "weight") != rows_of(edges.where("relation = 'relates_to'"), *follow._LINK, "weight")


def test_projects_read_metadata_once(spark):
    """Columns come along without a join, and each part of the JSON is read once however often the key names it."""
    nodes = event_nodes(spark, {1: ("a", 3), 2: ("b", None)})
    odd = [(7, "not json"), (8, None), (9, "{}"), (10, '{"source_type": "git_commit", "source_uri": "/r/x@abc"}'), (11, '{"source_type": "chat", "source_uri": 5}')]
    more = spark.createDataFrame(odd, "node_id long, metadata_json string").withColumns({"level": F.lit(1), "node_type": F.lit("event"), "title": F.lit("o")})
    got = follow.projects(nodes.unionByName(more, allowMissingColumns=True), "title")
    assert rows_of(got, "event_id", "project", "title") == sorted([(1, "/v/a", "t1"), (2, "/v/b", "t2"), (7, "unknown", "o"), (8, "unknown", "o"), (9, "unknown", "o"), (10, "/r/x", "o"), (11, "chat", "o")], key=str)
    one = follow.projects(durable(nodes), "title")
    assert one._jdf.queryExecution().optimizedPlan().toString().count("get_json_object") == 2
