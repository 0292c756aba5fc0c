import random

from dialogue_lake.operators import graph as gr
from dialogue_lake.operators import windows as wi


def greedy(regions, cap=15_000, gap=500):
    merged = []
    for s, e, g, p in sorted(regions):
        if merged and s <= merged[-1][1] + gap and max(e, merged[-1][1]) - merged[-1][0] <= cap:
            w = merged[-1]
            merged[-1] = (w[0], max(e, w[1]), w[2] + [g], max(w[3], p))
        else:
            merged.append((s, e, [g], p))
    return merged


def chosen(merged, limit=6, budget=60_000, cap=15_000):
    taken, used, out = [], 0, {}
    for s, e, g, p in sorted(merged, key=lambda w: (-w[3], w[0], w[2])):
        why = ("overlapping_window" if any(s < b and e > a for a, b in taken) else "call_budget" if len(taken) >= limit
               else "audio_budget" if used + e - s > budget else None)
        if why is None:
            taken.append((s, e))
            used += e - s
        out[s, e, tuple(g)] = why
    return out


def test_windows_equal_a_plain_walk(spark):
    random.seed(11)
    rows, want = [], {}
    for meeting in range(3):
        at, regions = 0, []
        for n in range(80):
            at += random.choice([100, 900, 2500, 7000, 12_000])
            regions.append((at, at + random.randint(300, 9000), f"g{n:03d}", random.randint(70, 100) / 100))
        rows += [(meeting, g, p, s, e) for s, e, g, p in regions]
        want.update({(meeting, *k): v for k, v in chosen(greedy(regions)).items()})
    df = spark.createDataFrame(rows, "meeting_id bigint, grounding_id string, priority double, start_ms bigint, end_ms bigint")
    got = wi.select_windows(wi.build_windows(df)).collect()
    assert {(r.meeting_id, r.start_ms, r.end_ms, tuple(r.grounding_ids)): r.reason for r in got} == want


def test_cycles_and_components(spark):
    random.seed(2)
    events = [(m, f"e{n:03d}", n) for m in range(2) for n in range(1, 41)]
    edges = [(m, f"e{random.randint(1, 40):03d}", f"e{random.randint(1, 40):03d}") for m in range(2) for _ in range(45)]
    numbered = spark.createDataFrame(events, "meeting_id bigint, event_id string, n bigint")
    rel = spark.createDataFrame(edges, "meeting_id bigint, src string, dst string")

    def reach(m, start, both):
        seen, stack = set(), [start]
        while stack:
            x = stack.pop()
            for k, a, b in edges:
                for p, q in ((a, b), (b, a)) if both else ((a, b),):
                    if k == m and p == x and q not in seen:
                        seen.add(q)
                        stack.append(q)
        return seen

    forward = {(m, e): reach(m, e, False) for m, e, _ in events}
    want = {}
    for m, e, n in events:
        group = [f for f in forward[m, e] if f != e and e in forward[m, f]]
        if group:
            want[m, e] = (min(int(f[1:]) for f in [*group, e]), len(group) + 1)
    assert {(r.meeting_id, r.event_id): (r.cycle_n, r.size) for r in gr.cycles(numbered, rel).collect()} == want
    roots = {(r.meeting_id, r.event_id): r.root for r in gr.components(numbered, rel).collect()}
    assert roots == {(m, e): min([e, *reach(m, e, True)]) for m, e, _ in events}
