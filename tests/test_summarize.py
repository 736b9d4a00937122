"""Map-reduce summaries against a plain version that goes through one session at a time."""

import hashlib
import json
import random

from tallyspark.operators import summarize as S

THRESHOLD, CHUNK = 900, 300


def summarizer():
    def call(phase, text):
        """A summary that tells what it was made of, shorter than that."""
        found = json.loads(text)
        if any("poison" in json.dumps(x) for x in found["items"]):
            raise RuntimeError("no summary")
        wide = "wide" in text
        return json.dumps({"phase": phase, "of": hashlib.sha256(text.encode()).hexdigest()[:12], "pad": ("wide" if wide else "x") * (175 if wide else 10 + len(found["items"]) % 7 * 5)})

    return call  # a function in a function goes to the workers as it is


call = summarizer()


def packed(sizes, cap):
    groups, used = [], 0
    for i, n in enumerate(sizes):
        if not groups or used + n > cap:
            groups.append([])
            used = 0
        groups[-1].append(i)
        used += n
    return groups


def plain(events, meta, previous):
    calls = 0

    def ask(phase, items, position, count, carry):
        nonlocal calls
        text = S.request(phase, meta, ",".join(items), position, count, carry)
        calls += 1
        if len(text.encode()) > THRESHOLD:
            raise ValueError(S.TOO_LARGE)
        try:
            return call(phase, text)
        except RuntimeError:
            raise ValueError(S.FAILED) from None

    try:
        chunks = packed([len(e.encode()) + 1 for e in events], CHUNK)
        if len(chunks) == 1:
            return ask("complete", events, 1, 1, previous), None, calls
        summaries, carry = [], None
        for i, c in enumerate(chunks):
            carry = ask("chunk", [events[j] for j in c], i + 1, len(chunks), carry)
            summaries.append(carry)
        while True:
            n = len(summaries)
            room = lambda p, n=n: len(S.request("reduce", meta, "", 0, 0, p)) - 2 + 2 * len(str(n))
            sizes = [len(x.encode()) + 1 for x in summaries]
            if room(previous) + sum(sizes) - 1 <= THRESHOLD:
                return ask("reduce", summaries, 1, n, previous), None, calls
            groups = packed(sizes, max(THRESHOLD - room(None), 0))
            if len(groups) >= n:
                return None, S.TOO_LARGE, calls
            found, error = [], None
            for i, g in enumerate(groups):
                try:
                    found.append(ask("reduce", [summaries[j] for j in g], i + 1, n, None))
                except ValueError as e:
                    error = str(e)
            if error:
                raise ValueError(error)
            summaries = found
    except ValueError as e:
        return None, str(e), calls


def test_summaries(spark, tmp_path):
    rng, rows, sessions = random.Random(7), [], []
    for i, n in enumerate([1, 2, 5, 12, 40, 120, 300, 6, 30, 4, 9]):
        events = [json.dumps({"i": j, "text": rng.choice("aé日") * rng.randint(0, 60)}, ensure_ascii=False) for j in range(n)]
        if i == 7:
            events[3] = json.dumps({"text": "poison"})
        if i == 8:
            events = [json.dumps({"text": "wide" + "y" * 100})] * n
        if i == 9:
            events[2] = json.dumps({"text": "z" * 2000})
        meta, previous = json.dumps({"session": i}), rng.choice([None, '{"former":1}'])
        sessions.append((str(i), meta, previous, events))
        rows += [(str(i), j, e) for j, e in enumerate(events)]
    rng.shuffle(rows)
    rows += [(None, 1, "{}"), ("0", 99, None)]
    frame = spark.createDataFrame(rows, "session_id string, seq long, event string").repartition(3)
    known = spark.createDataFrame([s[:3] for s in sessions] + [("empty", "{}", None)], "session_id string, meta string, previous string")
    got = {r["session_id"]: (r["summary"], r["error"], r["calls"]) for r in S.summarize(frame, known, call, str(tmp_path / "levels"), THRESHOLD, CHUNK).collect()}
    want = {s: plain(events, meta, previous) for s, meta, previous, events in sessions}
    assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in want.items()}
    assert {k: v[2] for k, v in got.items() if v[1] is None} == {k: v[2] for k, v in want.items() if v[1] is None}
    assert {v[1] for v in got.values()} == {None, S.TOO_LARGE, S.FAILED} and got["6"][2] > 100
