"""Memory hierarchy: sessions, episodes, clusters, drift, distillation, forgetting."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import versions
from ..durable import numbered
from ..functions import scores, text, vectors


def sessionise(events: DataFrame, gap_hours: float = 24.0, key: str = "project", ts: str = "ts", event_id: str = "event_id") -> DataFrame:
    """Adds session (from 0 per ``key``): a new one where the gap is larger than ``gap_hours``; undated events are session -1."""
    order = Window.partitionBy(key).orderBy(F.col(ts).asc_nulls_first(), event_id)
    gap = (F.unix_micros(ts) - F.unix_micros(F.lag(ts).over(order))) > int(gap_hours * 3_600_000_000)
    flagged = events.withColumn("__new", F.when(F.col(ts).isNotNull() & F.coalesce(gap, F.lit(False)), 1).otherwise(0))
    return flagged.withColumn("session", F.when(F.col(ts).isNull(), F.lit(-1)).otherwise(F.sum("__new").over(order)).cast("long")).drop("__new")


def episodes(sessioned: DataFrame, key: str = "project", ts: str = "ts") -> DataFrame:
    return sessioned.groupBy(key, "session").agg(F.count("*").alias("n_events"), F.min(ts).alias("time_start"), F.max(ts).alias("time_end"))


def window_index(events: DataFrame, days: float = 30.0, key: str = "concept_id", ts: str = "ts") -> DataFrame:
    """Dated events with idx: which window they fall in, counted from the concept's first event (``__t0``)."""
    first = events.where(F.col(ts).isNotNull()).groupBy(key).agg(F.min(ts).alias("__t0"))
    idx = F.floor((F.unix_micros(ts) - F.unix_micros("__t0")) / int(days * scores.DAY)).cast("long")
    return events.where(F.col(ts).isNotNull()).join(first, key).withColumn("idx", idx)


def drift_windows(events: DataFrame, days: float = 30.0, key: str = "concept_id", ts: str = "ts") -> DataFrame:
    """``key``, idx, window_start, window_end, support; windows are anchored at the concept's first event."""
    size = int(days * scores.DAY)
    rows = window_index(events, days, key, ts).groupBy(key, "idx").agg(F.count("*").alias("support"), F.min("__t0").alias("__t0"))
    start = F.timestamp_micros(F.unix_micros("__t0") + F.col("idx") * size)
    end = F.timestamp_micros(F.unix_micros("__t0") + (F.col("idx") + 1) * size)
    return rows.select(key, "idx", start.alias("window_start"), end.alias("window_end"), "support")


def relearned(windows: DataFrame, key: str = "concept_id") -> DataFrame:
    """``key``, n_windows, support, span_start, span_end, relearned (some window starts after the previous one ended) and, of windows with a drift, overall_drift."""
    order = Window.partitionBy(key).orderBy("idx")
    flagged = windows.withColumn("__gap", F.coalesce(F.col("window_start") > F.lag("window_end").over(order), F.lit(False)))
    most = [F.max("drift").alias("overall_drift")] if "drift" in windows.columns else []
    return flagged.groupBy(key).agg(
        F.count("*").alias("n_windows"), F.sum("support").alias("support"), F.max("__gap").alias("relearned"), F.min("window_start").alias("span_start"), F.max("window_end").alias("span_end"), *most
    )


def drift_metric(vectors_by_window: DataFrame, keys: list[str], idx: str, vector: str) -> DataFrame:
    """``keys``, ``idx``, drift: 1 - cosine with the previous window that isn't empty, at least 0; 0 for the first."""
    return drift_of_centres(vectors.centroids(vectors_by_window, [*keys, idx], vector), keys, idx)


def drift_of_centres(centres: DataFrame, keys: list[str], idx: str) -> DataFrame:
    """``drift_metric`` of centroids that are known (``keys``, ``idx``, centroid)."""
    before = F.lag("centroid").over(Window.partitionBy(*keys).orderBy(idx))
    with_before = centres.withColumn("__before", before)
    drift = F.greatest(F.lit(0.0), 1.0 - vectors.cosine(F.col("centroid"), F.col("__before")))
    return with_before.select(*keys, idx, F.when(F.col("__before").isNull(), 0.0).otherwise(drift).alias("drift"))


def leader_clusters(embeddings: DataFrame, theta: float = 0.80, key: str = "node_id", vector: str = "vector", per: str | None = None) -> DataFrame:
    """``key``, cluster: greedy leader clustering in order of ``key``; clusters of one are dropped.

    A row joins the cluster whose running sum of unit vectors is nearest, if the cosine
    reaches ``theta``; of equal ones the oldest. The pass is sequential by definition, so it runs
    in one task per ``per`` group (a project); without ``per`` all rows go to one task.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        x = np.stack(pdf["__v"].to_numpy()).astype(np.float32)
        n = np.linalg.norm(x, axis=1, keepdims=True)
        x = x / np.where(n > 0, n, 1)
        sums = np.zeros_like(x)
        label, count = np.zeros(len(x), int), 0
        for i, v in enumerate(x):
            best = -1
            if count:
                norms = np.linalg.norm(sums[:count], axis=1)
                cos = sums[:count] @ v / np.where(norms > 0, norms, np.inf)
                k = int(np.argmax(cos))
                if cos[k] >= theta:
                    best = k
            if best < 0:
                best, count = count, count + 1
            sums[best] += v
            label[i] = best
        size = np.bincount(label, minlength=count)
        keep = size[label] > 1
        return pd.DataFrame({"group": pdf["group"].to_numpy()[keep], key: pdf[key].to_numpy()[keep], "cluster": label[keep]})

    group = F.lit("all") if per is None else F.col(per).cast("string")
    rows = embeddings.select(group.alias("group"), F.col(key).cast("long").alias(key), F.col(vector).alias("__v"))
    found = rows.groupBy("group").applyInPandas(run, f"group string, {key} long, cluster long")
    return found if per else found.drop("group")


def distill_core(members: DataFrame, ratio: float = 0.5, group: str = "node_id", item: str = "chunk_id", vector: str = "vector", centres: DataFrame | None = None) -> DataFrame:
    """``group``, core (ascending ids), core_size, full_size: the items nearest to the group's centroid (``centres``: those that are kept)."""
    centre = vectors.centroids(members, [group], vector) if centres is None else centres.select(group, "centroid")
    sized = members.withColumn("full_size", F.count("*").over(Window.partitionBy(group)))
    # Rounded, so that equal cosines tie by id whatever the order of summation.
    near = F.round(F.coalesce(vectors.cosine(F.col(vector), F.col("centroid")), F.lit(-2.0)), 9)
    ranked = sized.join(centre, group, "left").withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy(near.desc(), item)))
    core = ranked.where(F.col("__r") <= scores.core_size(ratio, F.col("full_size")))
    return core.groupBy(group).agg(F.array_sort(F.collect_list(item)).alias("core"), F.count("*").alias("core_size"), F.first("full_size").alias("full_size"))


def forgetting_risk(nodes: DataFrame, now: Column, half_life: float = 30.0, min_support: int = 1) -> DataFrame:
    """Nodes (node_id, centrality, support, last_touch) with importance, staleness, risk and confidence."""
    importance = F.coalesce("centrality", scores.confidence(F.col("support")))
    rows = nodes.where(F.col("support") >= min_support).withColumn("importance", importance).withColumn("staleness", scores.staleness(F.col("last_touch"), now, half_life))
    return rows.withColumn("risk", F.col("importance") * F.col("staleness")).withColumn("confidence", scores.confidence(F.col("support")))


def last_touch(nodes: DataFrame, evidence: DataFrame, chunks: DataFrame, usage: DataFrame | None = None) -> DataFrame:
    """``nodes`` (node_id, time_start, time_end) that have evidence, with support and last_touch: the latest of their use, their span and their sources' times.

    ``evidence``: root_id, chunk_id; ``chunks``: chunk_id, ts; ``usage``: target_kind, target_id, last_event_at, of which nodes' uses count.
    """
    of_chunks = evidence.join(chunks.select("chunk_id", "ts"), "chunk_id").groupBy(F.col("root_id").alias("node_id")).agg(F.count("*").alias("support"), F.max("ts").alias("__content"))
    rows = nodes.join(of_chunks, "node_id").withColumn("__used", F.lit(None).cast("timestamp"))
    if usage is not None:
        used = usage.where("target_kind = 'node'").select(F.col("target_id").alias("node_id"), F.col("last_event_at").cast("timestamp").alias("__used"))
        rows = rows.drop("__used").join(used, "node_id", "left")
    touched = F.greatest("__used", F.col("time_end").cast("timestamp"), F.col("time_start").cast("timestamp"), F.col("__content").cast("timestamp"))
    return rows.withColumn("last_touch", touched).drop("__used", "__content")


def by_risk(risks: DataFrame, top: int | None = None) -> DataFrame:
    """The riskiest first; of equal ones the surer, then the older node."""
    ordered = risks.orderBy(F.desc("risk"), F.desc("confidence"), "node_id")
    return ordered if top is None else ordered.limit(top)


def by_drift(summaries: DataFrame, top: int | None = None, min_support: int = 1) -> DataFrame:
    """Concepts that moved most first; of equal ones the surer, then the older."""
    sure = summaries.where(F.col("support") >= min_support).withColumn("confidence", scores.confidence(F.col("support")))
    ordered = sure.orderBy(F.desc("overall_drift"), F.desc("confidence"), "concept_id")
    return ordered if top is None else ordered.limit(top)


def central_ranks(members: DataFrame, group: str = "cluster", item: str = "node_id", vector: str = "vector", centres: DataFrame | None = None) -> DataFrame:
    """``members`` with place (from 1 per group): nearest to the group's centroid (``centres``: those that are kept) first, then by id, those without a vector last."""
    centre = vectors.centroids(members, [group], vector) if centres is None else centres.select(group, "centroid")
    # Rounded, so that equal cosines tie by id whatever the order of summation.
    near = F.when(F.col(vector).isNotNull(), F.round(vectors.cosine(F.col(vector), F.col("centroid")), 9))
    order = Window.partitionBy(group).orderBy(near.desc_nulls_last(), item)
    return members.join(centre, group, "left").withColumn("place", F.row_number().over(order)).drop("centroid")


def representative_titles(ranked: DataFrame, limit: int = 8, group: str = "cluster", title: str = "title") -> DataFrame:
    """``group``, titles: the most central titles that differ in more than case, in order; blank ones don't count."""
    named = ranked.withColumn("__title", F.trim(title)).where("__title <> ''")
    once = named.withColumn("__n", F.row_number().over(Window.partitionBy(group, F.lower("__title")).orderBy("place"))).where("__n = 1")
    first = once.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy("place"))).where(F.col("__n") <= limit)
    return first.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", "__title"))), lambda s: s["__title"]).alias("titles"))


def episode_nodes(sessioned: DataFrame, key: str = "project", ts: str = "ts", title: str = "title", event_id: str = "event_id", gap_hours: float = 24.0, version: str = "1") -> DataFrame:
    """An episode per session: title, content, n_events, time_start, time_end, members (ascending event ids) and a fingerprint of what it was made from."""
    order = F.struct(F.col(ts).isNull(), F.col(ts), F.col(event_id), F.col(title).alias("title"))
    rows = sessioned.groupBy(key, "session").agg(
        F.count("*").alias("n_events"), F.min(ts).alias("time_start"), F.max(ts).alias("time_end"), F.array_sort(F.collect_list(event_id)).alias("members"), F.array_sort(F.collect_list(order)).alias("__rows")
    )  # an episode's own events
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    made = F.concat_ws("\x1f", F.lit(version), F.lit(str(int(gap_hours * 3600))), F.col(key).cast("string"), F.array_join(F.transform("members", lambda x: x.cast("string")), ","))
    return rows.select(
        key, "session", "n_events", "time_start", "time_end", "members",
        text.episode_title(F.col(key).cast("string"), F.col("n_events"), day("time_start"), day("time_end")).alias("title"),
        text.name_list(F.transform("__rows", lambda r: r["title"])).alias("content"),
        F.sha2(made, 256).alias("fingerprint"),
    )


def concept_nodes(clusters: DataFrame, titles: DataFrame, model: str, theta: float = 0.80, version: str = "1") -> DataFrame:
    """cluster, title, content, members, fingerprint of clustered events (node_id, cluster, vector; ``titles``: node_id, title): named by the most central title."""
    ranked = central_ranks(clusters.join(titles, "node_id", "left"))
    names = representative_titles(ranked)
    rows = ranked.groupBy("cluster").agg(F.array_sort(F.collect_list("node_id")).alias("members"), F.array_sort(F.collect_list(F.struct("node_id", "title"))).alias("__titles"))  # a cluster's own events
    made = F.concat_ws("\x1f", F.lit(version), F.lit(f"{theta:.4f}"), F.lit(model), F.array_join(F.transform("members", lambda x: x.cast("string")), ","))
    base = F.coalesce(F.try_element_at("titles", F.lit(1)), F.lit("Concept"))
    more = F.when(F.size("members") > 1, F.concat(F.lit(" (+"), (F.size("members") - 1).cast("string"), F.lit(" related)"))).otherwise("")
    return rows.join(names, "cluster", "left").select(
        "cluster", F.concat(base, more).alias("title"), text.name_list(F.transform("__titles", lambda r: r["title"])).alias("content"), "members", F.sha2(made, 256).alias("fingerprint")
    )


def embed_pending(rows: DataFrame, stored: DataFrame, provider, key: str, text: str, batch: int = 64) -> DataFrame:
    """Vectors of rows that have none of the provider's model, by its ``embed(list[str])``."""
    missing = rows.join(stored.where(F.col("model") == provider.name), key, "left_anti").select(key, text)
    name, dim = provider.name, provider.dim

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                yield pd.DataFrame({key: part[key].to_numpy(), "model": name, "dim": dim, "vector": [list(map(float, v)) for v in provider.embed(part[text].tolist())]})

    return missing.mapInPandas(run, f"{key} long, model string, dim int, vector array<float>")


def embed_in_batches(rows: DataFrame, stored: DataFrame, provider, key: str, text: str, folder: str, size: int = 50_000) -> DataFrame:
    """``embed_pending`` in numbered batches that stay in ``folder``: a run that died goes on behind the last whole batch.

    The pending rows are written once, in order of ``key``. A batch is whole when its folder has Spark's mark of success. The folder serves one set of rows; a next set takes another.
    """
    spark, plan = rows.sparkSession, versions.load(rows.sparkSession, folder)
    if plan is None:
        pending = numbered(rows.join(stored.where(F.col("model") == provider.name), key, "left_anti").select(key, text), "__n", key)
        pending.withColumn("batch", F.floor((F.col("__n") - 1) / size)).drop("__n").repartition("batch").write.mode("overwrite").partitionBy("batch").parquet(f"{folder}/pending")
        plan = {"model": provider.name, "batches": sorted(int(b.removeprefix("batch=")) for b in versions.folders(spark, f"{folder}/pending"))}
        versions.commit(spark, folder, plan)
    if plan["model"] != provider.name:
        raise ValueError(f"{folder} holds vectors of {plan['model']}")
    schema = f"{key} long, model string, dim int, vector array<float>"
    for b in plan["batches"]:
        if not versions.is_whole(spark, f"{folder}/vectors/batch={b}"):
            pending = spark.read.parquet(f"{folder}/pending/batch={b}").repartition(spark.sparkContext.defaultParallelism)
            embed_pending(pending, spark.createDataFrame([], schema), provider, key, text).write.mode("overwrite").parquet(f"{folder}/vectors/batch={b}")
    return spark.read.schema(schema).parquet(*[f"{folder}/vectors/batch={b}" for b in plan["batches"]]) if plan["batches"] else spark.createDataFrame([], schema)
