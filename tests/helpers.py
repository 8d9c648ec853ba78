"""Small logs, and a plain replay of a log in Python to compare with."""

import datetime as dt
import random
from functools import reduce

from pyspark.sql import functions as F

from tidegraph.schema import CHANGELOG
from tidegraph.storage import stored

EPOCH = dt.datetime(1970, 1, 1)


def at(seconds):
    return EPOCH + dt.timedelta(seconds=seconds)


def vertex(seq, seconds, action, id_, **attributes):
    return (seq, at(seconds), action, "VERTEX", id_, None, None, attributes)


def edge(seq, seconds, action, id_, src, dst, **attributes):
    return (seq, at(seconds), action, "EDGE", id_, src, dst, attributes)


def log_of(spark, entries):
    return stored(spark.createDataFrame(entries, CHANGELOG).coalesce(2), "test-log")


def replay(entries, t, mode="merge"):
    """State at t as {(type, id): (src, dst, attributes)}."""
    state = {}
    for _, ts, action, kind, id_, src, dst, attributes in sorted(entries, key=lambda e: (e[1], e[0])):
        if ts > t:
            continue
        key = (kind, id_)
        if action == "DELETE":
            state.pop(key, None)
        elif action == "CREATE":
            state[key] = (src, dst, dict(attributes))
        elif key in state:
            old = state[key]
            merged = {**old[2], **attributes} if mode == "merge" else dict(attributes)
            state[key] = (old[0], old[1], merged)
    return state


def as_state(rows):
    rows = rows if isinstance(rows, list) else rows.collect()
    found = {(r["entity_type"], r["id"]): (r["src"], r["dst"], dict(r["attributes"])) for r in rows}
    assert len(found) == len(rows), "an entity appears twice"
    return found


def labelled(frames):
    """Rows of several DataFrames by label, found in one job."""
    frames = list(frames)
    tagged = [df.withColumn("__label", F.lit(i)) for i, (_, df) in enumerate(frames)]
    rows = reduce(lambda a, b: a.unionByName(b), tagged).collect()
    return [(label, [r for r in rows if r["__label"] == i]) for i, (label, _) in enumerate(frames)]


def lives(entries):
    """{(type, id): [(src, dst, from, to), ...]}; an open life ends at None."""
    found = {}
    for _, ts, action, kind, id_, src, dst, _a in sorted(entries, key=lambda e: (e[1], e[0])):
        mine = found.setdefault((kind, id_), [])
        if action in ("CREATE", "DELETE") and mine and mine[-1][3] is None:
            mine[-1] = (*mine[-1][:3], ts)
        if action == "CREATE":
            mine.append((src, dst, ts, None))
    return found


def neighbours(entries, v, start, stop):
    hit = set()
    for (kind, _), spans in lives(entries).items():
        for src, dst, lo, hi in spans:
            if kind == "EDGE" and v in (src, dst) and lo <= stop and (hi is None or hi >= start):
                hit.add(src if dst == v else dst)
    return hit


def activated(entries, start, stop):
    return {k for k, spans in lives(entries).items() if spans and start <= spans[0][2] <= stop}


def net_created(entries, start, stop):
    last = {}
    for _, ts, action, kind, id_, *_ in sorted(entries, key=lambda e: (e[1], e[0])):
        if start <= ts <= stop and action != "UPDATE":
            last[kind, id_] = action
    return {k for k, action in last.items() if action == "CREATE"}


def random_log(seed, entities=6, per_entity=12, span=20):
    """Ties, several lives, partial maps, updates of the dead; mostly one busy entity."""
    rnd = random.Random(seed)
    raw = []
    for i in range(entities):
        kind = "VERTEX" if i % 2 else "EDGE"
        ends = (rnd.randrange(4), rnd.randrange(4)) if kind == "EDGE" else (None, None)
        n = per_entity * 4 if i == 0 else per_entity
        times = sorted(rnd.randrange(span) for _ in range(n))
        alive = False
        for ts in times:
            if not alive:
                action = "CREATE" if rnd.random() < 0.9 else rnd.choice(["UPDATE", "DELETE"])
            else:
                action = rnd.choices(["UPDATE", "DELETE", "CREATE"], [8, 2, 0.5])[0]
            alive = action == "CREATE" or (alive and action == "UPDATE")
            attributes = {} if action == "DELETE" else {
                k: str(rnd.randrange(9)) for k in "abc" if rnd.random() < 0.5
            }
            raw.append((at(ts), action, kind, i, *ends, attributes))
    # Positions follow each entity's own order, as a log written in time would.
    raw.sort(key=lambda e: e[0])
    return [(seq, *e) for seq, e in enumerate(raw)]
