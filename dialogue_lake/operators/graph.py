"""Event relations, issue threads, cycles and how decisions evolved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialogue_lake.functions import text as tx
from dialogue_lake.operators import ordered
from dialogue_lake.operators.intervals import union_intervals
from dialogue_lake.operators.lookup import spread_join
from dialogue_lake.session import checkpointed, stored


def number_events(events: DataFrame) -> DataFrame:
    """Accepted events numbered per meeting in time order, with their content terms."""
    rows = events.withColumn("terms", tx.content_terms(F.col("text")))
    return ordered.scan(rows, ["meeting_id"], ["start_ms", "event_id"], ordered.bucket_of("start_ms", 600_000), [ordered.numbered("n")])


def _with_earlier(numbered: DataFrame, window: int) -> DataFrame:
    earlier = F.struct("event_id", "n", "end_ms", "terms", "evidence_ids")
    return ordered.with_preceding(numbered, ["meeting_id"], "n", window, earlier, "_before").withColumn("a", F.explode("_before")).drop("_before")


def relation_candidates(numbered: DataFrame, window: int = 12, gap_ms: int = 120_000, floor: float = 0.15, cap: int = 100) -> tuple[DataFrame, DataFrame]:
    """Pairs of close events worth asking about, and their count per meeting.

    Every pair has its place ``pair_no``. ``within_budget`` marks the first ``cap``, the
    request budget of a meeting; nothing is left out.
    """
    a = F.col("a")
    related = (
        F.arrays_overlap(a["evidence_ids"], F.col("evidence_ids")) | (a["n"] == F.col("n") - 1)
        | (tx.jaccard(a["terms"], F.col("terms")) >= floor))
    pairs = _with_earlier(numbered, window).filter((F.col("start_ms") - a["end_ms"] <= gap_ms) & related).select(
        "meeting_id", a["event_id"].alias("src"), F.col("event_id").alias("dst"), a["n"].alias("src_n"), F.col("n").alias("dst_n"))
    ranked = ordered.scan(pairs, ["meeting_id"], ["dst_n", "src_n"], ordered.bucket_of("dst_n", 4096), [ordered.numbered("pair_no")])
    return ranked.withColumn("within_budget", F.col("pair_no") <= cap), pairs.groupBy("meeting_id").agg(F.count(F.lit(1)).alias("pairs"))


def lexical_links(numbered: DataFrame, window: int = 12, gap_ms: int = 120_000, shared: int = 2) -> DataFrame:
    a = F.col("a")
    alike = F.size(F.array_intersect(a["terms"], F.col("terms"))) >= shared
    return _with_earlier(numbered, window).filter((F.col("start_ms") - a["end_ms"] <= gap_ms) & alike).select(
        "meeting_id", a["event_id"].alias("src"), F.col("event_id").alias("dst"))


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest event id of the connected component of every vertex.

    Each round takes the smallest label among neighbours and then the label of that
    label, which halves the distance still to go. Labels are checkpointed every round.
    """
    both = checkpointed(
        edges.select("meeting_id", "src", "dst").unionByName(edges.select("meeting_id", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = checkpointed(vertices.select("meeting_id", F.col("event_id").alias("v"), F.col("event_id").alias("label")))
    while True:
        offered = both.join(labels.select("meeting_id", F.col("v").alias("src"), "label"), ["meeting_id", "src"]).groupBy(
            "meeting_id", F.col("dst").alias("v")).agg(F.min("label").alias("_offer"))
        lower = labels.join(offered, ["meeting_id", "v"], "left").withColumn("_new", F.least("label", "_offer"))
        lower = checkpointed(lower.select("meeting_id", "v", F.col("label").alias("_old"), F.coalesce("_new", "label").alias("label")))
        roots = lower.select("meeting_id", F.col("v").alias("label"), F.col("label").alias("_root"))
        used = roots.join(lower.select("meeting_id", "label").distinct(), ["meeting_id", "label"], "left_semi")
        jumped = checkpointed(
            spread_join(lower, used, ["meeting_id", "label"], F.col("v"), "inner")
            .select("meeting_id", "v", "_old", F.least("label", "_root").alias("label")))
        moving = not jumped.filter(F.col("_old") != F.col("label")).isEmpty()
        labels = jumped.drop("_old")
        if not moving:
            return labels.select("meeting_id", F.col("v").alias("event_id"), F.col("label").alias("root"))


def issue_threads(numbered: DataFrame, relations: DataFrame) -> DataFrame:
    """Events with their thread, threads numbered by first event; one row per event."""
    edges = relations.select("meeting_id", "src", "dst").unionByName(lexical_links(numbered))
    member = checkpointed(components(numbered, edges).join(
        numbered.select("meeting_id", "event_id", "n", "start_ms", "text"), ["meeting_id", "event_id"]))
    first = member.groupBy("meeting_id", "root").agg(
        F.min("n").alias("first_n"), F.count(F.lit(1)).alias("events"), F.min_by(F.substring("text", 1, 120), "n").alias("title"))
    threads = ordered.scan(first, ["meeting_id"], ["first_n"], ordered.bucket_of("first_n", 4096), [ordered.numbered("thread_no")])
    named = threads.select("meeting_id", "root", F.format_string("issue_%04d", "thread_no").alias("issue_id"), "title", "events")
    return spread_join(member, named, ["meeting_id", "root"], F.col("n"), "inner").select(
        "meeting_id", "issue_id", "event_id", "n", "title", "events")


def cycles(numbered: DataFrame, relations: DataFrame) -> DataFrame:
    """Events on relation cycles with the smallest event number of their cycle.

    A cycle must somewhere go back in time, so only stretches covered by backward
    relations can hold one; everything else is dropped at once. Inside the stretches each
    vertex takes the largest number that can reach it, and the vertices a number's owner
    can be reached from, within its colour, are one strongly connected component. Found
    components are removed and the rest is coloured again until no edge is left. Shortcuts
    of doubled length let both walks cross a long stretch in a few rounds.
    """
    place = numbered.select("meeting_id", "event_id", "n")
    edges = (
        relations.select("meeting_id", "src", "dst")
        .join(place.select("meeting_id", F.col("event_id").alias("src"), F.col("n").alias("a")), ["meeting_id", "src"])
        .join(place.select("meeting_id", F.col("event_id").alias("dst"), F.col("n").alias("b")), ["meeting_id", "dst"])
        .select("meeting_id", "a", "b").filter(F.col("a") != F.col("b")).distinct())
    edges = checkpointed(edges)
    back = edges.filter(F.col("a") > F.col("b")).select("meeting_id", F.col("b").alias("start_ms"), F.col("a").alias("end_ms"))
    stretch = union_intervals(back, ["meeting_id"], width=4096)
    spread = stretch.select("meeting_id", "start_ms", "end_ms", F.explode(F.sequence("start_ms", "end_ms")).alias("n"))
    inside = spread.select("meeting_id", "n", F.col("start_ms").alias("part"))
    live = edges.join(inside.withColumnRenamed("n", "a").withColumnRenamed("part", "_p"), ["meeting_id", "a"]).join(
        inside.withColumnRenamed("n", "b").withColumnRenamed("part", "_q"), ["meeting_id", "b"]).filter(F.col("_p") == F.col("_q"))
    live = _with_shortcuts(
        checkpointed(live.select("meeting_id", "a", "b")), stretch.agg(F.max(F.col("end_ms") - F.col("start_ms"))).first()[0] or 0)
    found = None
    while not live.isEmpty():
        nodes = live.select("meeting_id", F.explode(F.array("a", "b")).alias("v")).distinct()
        colours = _spread_maximum(checkpointed(nodes.withColumn("c", F.col("v"))), live)
        same = (
            live.join(colours.select("meeting_id", F.col("v").alias("a"), F.col("c").alias("_ca")), ["meeting_id", "a"])
            .join(colours.select("meeting_id", F.col("v").alias("b"), F.col("c").alias("_cb")), ["meeting_id", "b"])
            .filter(F.col("_ca") == F.col("_cb")))
        same = stored(same.select("meeting_id", F.col("b").alias("a"), F.col("a").alias("b")))
        # Backwards from the owner of a colour, inside the colour: the owner's mark spreads.
        marks = stored(colours.select("meeting_id", "v", (F.col("v") == F.col("c")).cast("int").alias("c")))
        marks = _spread_maximum(marks, same)
        part = checkpointed(marks.filter("c = 1").select("meeting_id", "v").join(colours, ["meeting_id", "v"]))
        found = part if found is None else checkpointed(found.unionByName(part))
        gone = part.select("meeting_id", "v")
        live = checkpointed(
            live.join(gone.withColumnRenamed("v", "a"), ["meeting_id", "a"], "left_anti")
            .join(gone.withColumnRenamed("v", "b"), ["meeting_id", "b"], "left_anti"))
    if found is None:
        return place.limit(0).withColumn("cycle_n", F.col("n")).withColumn("size", F.col("n"))
    sized = found.groupBy("meeting_id", "c").agg(F.min("v").alias("cycle_n"), F.count(F.lit(1)).alias("size")).filter(F.col("size") > 1)
    return found.join(sized, ["meeting_id", "c"]).select("meeting_id", F.col("v").alias("n"), "cycle_n", "size").join(
        place, ["meeting_id", "n"]).select("meeting_id", "event_id", "n", "cycle_n", "size")


def _with_shortcuts(edges: DataFrame, longest: int) -> DataFrame:
    """Edges and, for every vertex, the ends of walks of 1, 2, 4, ... steps from it and to it.

    A walk takes the edge that leads furthest ahead, or comes from furthest back. The ends
    are reached anyway, so no component changes; there are two more edges a vertex and round.
    """
    ahead = edges.groupBy("meeting_id", F.col("a").alias("v")).agg(F.max("b").alias("w")).withColumn("back", F.lit(False))
    behind = edges.groupBy("meeting_id", F.col("b").alias("v")).agg(F.min("a").alias("w")).withColumn("back", F.lit(True))
    walk = checkpointed(ahead.unionByName(behind))
    steps = 1
    while 2 * steps <= longest and not walk.isEmpty():
        onward = walk.select("meeting_id", F.col("v").alias("w"), F.col("w").alias("_w"), "back")
        walk = checkpointed(walk.join(onward, ["meeting_id", "w", "back"]).select("meeting_id", "v", F.col("_w").alias("w"), "back"))
        edges = edges.unionByName(walk.select(
            "meeting_id", F.when(F.col("back"), F.col("w")).otherwise(F.col("v")).alias("a"),
            F.when(F.col("back"), F.col("v")).otherwise(F.col("w")).alias("b")))
        steps *= 2
    return checkpointed(edges.filter(F.col("a") != F.col("b")).distinct())


def _spread_maximum(colours: DataFrame, edges: DataFrame) -> DataFrame:
    """Largest number that reaches each vertex along the edges."""
    while True:
        offered = edges.join(colours.select("meeting_id", F.col("v").alias("a"), "c"), ["meeting_id", "a"]).groupBy(
            "meeting_id", F.col("b").alias("v")).agg(F.max("c").alias("_offer"))
        grown = checkpointed(colours.join(offered, ["meeting_id", "v"], "left").select(
            "meeting_id", "v", F.col("c").alias("_old"), F.greatest("c", "_offer").alias("c")))
        moving = not grown.filter(F.col("_old") != F.col("c")).isEmpty()
        colours = grown.drop("_old")
        if not moving:
            return colours


def decision_evolution(threads: DataFrame, events: DataFrame, relations: DataFrame) -> DataFrame:
    """The state of every event in its thread, one row per event.

    Rows rather than lists, since a thread may hold a large part of a meeting.
    """
    key = ["meeting_id", "event_id"]
    sources = lambda kinds, name: relations.filter(F.col("relation_type").isin(kinds)).select(
        "meeting_id", F.col("src").alias("event_id")).distinct().withColumn(name, F.lit(True))
    rows = (
        threads.join(events.select(*key, F.col("choice").alias("event_type")), key)
        .join(sources(["SUPERSEDES"], "_old"), key, "left").join(sources(["ACCEPTS", "REJECTS"], "_settled"), key, "left"))
    old, settled = F.coalesce("_old", F.lit(False)), F.coalesce("_settled", F.lit(False))
    kind = F.col("event_type")
    state = (
        F.when(old, "historical").when(kind == "DECISION", "current_decision")
        .when(kind.isin("TASK_ASSIGNMENT", "COMMITMENT"), "task")
        .when((kind == "PROPOSAL") & ~settled, "unresolved_proposal").otherwise("context"))
    return rows.withColumn("state", state).drop("_old", "_settled")


def thread_view(evolution: DataFrame) -> DataFrame:
    """Threads worth showing: those with more than one event."""
    return evolution.filter(F.col("events") > 1)
