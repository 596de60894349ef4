"""Sums of concepts by window that follow changes equal those of all events."""

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone import versions
from quillstone.functions import vectors
from quillstone.operators import centres, memory

EVENT = "event_id long, concept_id long, ts timestamp, vector array<float>"


def frame(spark, events):
    return spark.createDataFrame([(k, c, t, v) for k, (c, t, v) in sorted(events.items())], EVENT)


def draw(rng):
    import datetime as dt

    day = rng.choice([None, *range(60)])
    ts = None if day is None else dt.datetime(2024, 1, 1) + dt.timedelta(days=day, hours=rng.randrange(24))
    vector = rng.choice([None, [0.0, 0.0, 0.0], *[[rng.gauss(0, 1) for _ in range(3)] for _ in range(6)]])
    return rng.choice([None, 1, 2, 3, 4, 5, 6, 7]), ts, vector


def table(df):
    return sorted(map(tuple, df.select("concept_id", "idx", "t0", "total", "n").collect()), key=str)


def test_sums_follow_changes(spark, tmp_path, monkeypatch):
    rng, root = random.Random(5), str(tmp_path / "kept")
    events, again = {k: draw(rng) for k in range(120)}, 0
    centres.take(spark, root, 0, frame(spark, events), frame(spark, events), days=7.0, buckets=4)
    for batch in range(1, 5):
        before = dict(events)
        for k in rng.sample(sorted(events), 6):
            events[k] = draw(rng)
        for k in rng.sample(sorted(events), 4):
            del events[k]
        events |= {1000 * batch + k: draw(rng) for k in range(3)}
        if batch == 3:  # a concept goes, another comes
            events = {k: e for k, e in events.items() if e[0] != 2} | {9000: (8, *draw(rng)[1:2], [1.0, 2.0, 3.0])}
        after = frame(spark, events)
        added = frame(spark, {k: e for k, e in events.items() if before.get(k) != e})
        removed = frame(spark, {k: e for k, e in before.items() if events.get(k) != e})
        if batch == 2:  # died before its switch, then done again
            with monkeypatch.context() as m, pytest.raises(OSError):
                m.setattr(versions, "commit", lambda *a, **k: (_ for _ in ()).throw(OSError("killed")))
                centres.take(spark, root, batch, after, added, removed, days=7.0)
        told = centres.take(spark, root, batch, after, added, removed, days=7.0)
        again += told["again"]
        assert centres.take(spark, root, batch, after, added, removed, days=7.0) == {"repeated": True}
        whole = str(tmp_path / f"whole{batch}")
        centres.take(spark, whole, 0, after, after, days=7.0, buckets=4)
        assert table(centres.read(spark, root)) == table(centres.read(spark, whole))
    assert again > 0
    kept = centres.read(spark, root)
    # Drift as of the full build.
    rows = frame(spark, events).where("concept_id is not null and vector is not null")
    windows = memory.drift_windows(rows, 7.0).join(memory.drift_metric(memory.window_index(rows, 7.0), ["concept_id"], "idx", "vector"), ["concept_id", "idx"])
    got, expected = ({(r.concept_id, r.idx): r for r in df.collect()} for df in (centres.drift(kept, 7.0), windows))
    assert got.keys() == expected.keys()
    for k, r in expected.items():
        assert (got[k].window_start, got[k].window_end, got[k].support) == (r.window_start, r.window_end, r.support) and abs(got[k].drift - r.drift) < 1e-9
    # Central ranks and cores from what is kept.
    member = rows.select(F.col("concept_id").alias("cluster"), F.col("event_id").alias("node_id"), "vector")
    known = centres.centres(kept).withColumnRenamed("concept_id", "cluster")
    ranks = [{(r.cluster, r.node_id): r.place for r in memory.central_ranks(member, centres=c).collect()} for c in (None, known)]
    cores = [sorted(map(tuple, memory.distill_core(member, 0.5, "cluster", "node_id", centres=c).collect())) for c in (None, known)]
    assert ranks[0] == ranks[1] and cores[0] == cores[1]


def test_batches_touch_their_concepts_only(spark, tmp_path):
    import datetime as dt

    root = str(tmp_path / "kept")
    day = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    events = {c * 10 + k: (c, day(k), [1.0, float(k)]) for c in range(40) for k in range(5)}
    centres.take(spark, root, 0, frame(spark, events), frame(spark, events), buckets=16)
    before = {p for p in Path(root).rglob("*.parquet")}
    late = frame(spark, {999: (3, day(9), [2.0, 1.0])})
    # A later event needs no other event: a table that can't be read is never asked.
    told = centres.take(spark, root, 1, spark.read.schema(EVENT).parquet(*[str(p) for p in before]).where("raise_error('read')  is null"), late)
    assert (told["touched"], told["again"], len(told["written"])) == (1, 0, 1)
    manifest = versions.load(spark, root)
    live = {str(p.parent.relative_to(root)) for p in before if str(p.parent.relative_to(root)) in manifest["live"].values()}
    assert len(live) == len(manifest["live"]) - 1
    nothing = frame(spark, events).limit(0)
    assert centres.take(spark, root, 2, nothing, nothing)["written"] == [] and centres.read(spark, root).select("concept_id").distinct().count() == 40
    with pytest.raises(ValueError):
        centres.take(spark, root, 3, nothing, nothing, days=1.0)


def test_unit_sums_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k % 3) if k % 7 else None, rng.normal(size=4).tolist()) for k in range(500)] + [(0, [float("nan"), 0.0, 0.0, 1.0]), (1, None)]
    df = spark.createDataFrame(rows, "g long, vector array<double>")
    one = {r.g: (r.total, r.n) for r in vectors.unit_sums(df.repartition(7), ["g"], "vector").collect()}
    two = {r.g: (r.total, r.n) for r in vectors.unit_sums(df.coalesce(1), ["g"], "vector", groups_at_once=1).collect()}
    assert one == two and set(one) == {None, 0, 1, 2}
    for g, (total, n) in one.items():
        mine = np.array([v for k, v in rows if k == g and v is not None and np.isfinite(v).all()])
        exact = np.rint(mine / np.linalg.norm(mine, axis=1, keepdims=True) * vectors.UNIT).astype(object).sum(axis=0)
        assert abs(np.array([h * 2**32 + x for h, x in zip(total[:4], total[4:])], object) - exact).max() <= len(mine) and n == len(mine) + (g == 0)
    centre = vectors.centroids(df, ["g"], "vector").where("g = 2").first().centroid
    mine = np.array([v for k, v in rows if k == 2])
    mean = (mine / np.linalg.norm(mine, axis=1, keepdims=True)).mean(axis=0)
    assert np.allclose(centre, mean / np.linalg.norm(mean), atol=1e-10)
