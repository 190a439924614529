"""The closed-form lifecycles against a plain walk through the requests."""

import random
from datetime import timedelta

from seeds import T
from vigilflow import fixed_values as V
from vigilflow.operators import lifecycle as L

REQUEST = "request_id long, alert_id long, target string, requested_at timestamp_ntz"
CASE = "request_id long, incident_id long, target string, requested_at timestamp_ntz, resolution_summary string"


def requests(rng, targets, entities, n):
    return [(i, rng.randrange(entities), rng.choice(targets), T + timedelta(seconds=rng.randrange(60))) for i in range(n)]


def walk(state, rows, table, ok=lambda r: True):
    out = {}
    for r in sorted(rows, key=lambda r: (r[3], r[0])):
        now = state.get(r[1])
        good = now is not None and r[2] in table[now] and ok(r)
        out[r[0]] = (now, good)
        if good:
            state[r[1]] = r[2]
    return out


def test_alerts(spark):
    rng = random.Random(1)
    start = {i: rng.choice(V.ALERT_STATUSES) for i in range(40)}
    rows = requests(rng, ["NEW", "ACKNOWLEDGED", "RESOLVED"], 45, 400)
    alerts = spark.createDataFrame([(i, s, None, None) for i, s in start.items()], "id long, status string, acknowledged_at timestamp_ntz, resolved_at timestamp_ntz")
    df = spark.createDataFrame(rows, REQUEST).repartition(7)
    judged = L.alert_transitions(df, alerts)
    wanted_state = dict(start)
    wanted = walk(wanted_state, rows, V.ALERT_TRANSITIONS)
    assert {r.request_id: (r.status_before, r.accepted) for r in judged.collect()} == wanted
    assert {r.id: r.status for r in L.alert_state(alerts, judged).collect()} == wanted_state


def test_incidents(spark):
    rng = random.Random(2)
    start = {i: rng.choice(V.INCIDENT_STATUSES) for i in range(60)}
    rows = [(*r, rng.choice([None, " ok ", "fixed it"])) for r in requests(rng, V.INCIDENT_STATUSES, 65, 900)]
    cases = spark.createDataFrame(list(start.items()), "id long, status string")
    judged = L.incident_transitions(spark.createDataFrame(rows, CASE).repartition(5), cases)
    enough = lambda r: r[2] != "RESOLVED" or len((r[4] or "").strip()) >= 5
    wanted = walk(dict(start), rows, V.INCIDENT_TRANSITIONS, enough)
    assert {r.request_id: (r.status_before, r.accepted) for r in judged.collect()} == wanted


def test_reasons(spark):
    cases = spark.createDataFrame([(1, "OPEN")], "id long, status string")
    rows = [(1, 1, "INVESTIGATING", T, None), (2, 1, "resolved", T, "abc"), (3, 1, "OPEN", T, None), (4, 1, "RESOLVED", T, "all done"), (5, 1, "CONTAINED", T, None), (6, 9, "OPEN", T, None)]
    got = {r.request_id: r.reason for r in L.incident_transitions(spark.createDataFrame(rows, CASE), cases).collect()}
    assert got == {1: "invalid transition", 2: "resolution summary required", 3: "already in this status", 4: None, 5: "terminal status", 6: "incident not found"}
