"""Choice of the enrichment path against a plain replay of one analysis after the other."""

import random

from riftscan.operators import report

RISKS = "analysis_id string, id string, explanation string, recommendation string, more int"
PENDING = "Pending AI response..."


def replay(risks, setting, said, direct):
    named, key = setting
    if named or not key:
        if all(i is not None and said.get(i) is not None for i, *_ in risks):
            return [("service", said[i], report.FOLLOW_TEXT) for i, *_ in risks]
    if not key:
        return [("none", *(report.NO_SERVICE if named else report.NOTHING_SET))] * len(risks)
    if not direct:
        return [("direct failed", *report.NO_KEY_ANSWER) if (e or "").startswith("Pending AI response") else ("direct failed", e, r) for _, e, r in risks]
    by_id = {}
    for i, e, r in direct:
        by_id[i] = (e, r)
    return [("direct", by_id.get(i, ("", ""))[0] or e, by_id.get(i, ("", ""))[1] or r) for i, e, r in risks]


def test_replay(spark):
    rng = random.Random(7)
    risks, settings, service, direct, want = [], [], [], [], []
    for n in range(120):
        a = f"a{n}"
        rows = [(f"r{k}" if rng.random() > 0.02 else None, rng.choice([PENDING, "text", "", None]), rng.choice([PENDING, "fix"])) for k in range(rng.randrange(1, 5))]
        setting = (rng.random() < 0.5, rng.random() < 0.5)
        said = {f"r{k}": rng.choice(["s1", "s2", ""]) if rng.random() < 0.85 else None for k in range(5)}
        answers = [(f"r{rng.randrange(6)}", rng.choice(["d", "", "e"]), rng.choice(["f", ""])) for _ in range(rng.randrange(5))] if rng.random() < 0.7 else []
        if n % 10 == 9:
            setting = (False, False)  # has no row
        else:
            settings.append((a, *setting))
        risks += [(a, *r, 1) for r in rows]
        service += [(a, i, e) for i, e in said.items()] + [(a, None, "x")]
        direct += [(a, *x, k) for k, x in enumerate(answers)]
        want += [(a, r[0], *w) for r, w in zip(rows, replay(rows, setting, said, answers))]
    direct.append(("unknown", "r1", "x", "y", 0))
    got = report.enrich_by_path(
        spark.createDataFrame(risks, RISKS),
        spark.createDataFrame(settings, "analysis_id string, has_service boolean, has_key boolean"),
        spark.createDataFrame(service, "analysis_id string, id string, explanation string"),
        spark.createDataFrame(direct, "analysis_id string, id string, explanation string, recommendation string, seq int"),
    )
    assert got.columns == ["analysis_id", "id", "explanation", "recommendation", "more", "path"]
    assert sorted(map(str, ((r["analysis_id"], r["id"], r["path"], r["explanation"], r["recommendation"]) for r in got.collect()))) == sorted(map(str, want))
    assert {w[2] for w in want} == {"service", "none", "direct failed", "direct"}


def test_no_risks(spark):
    empty = [spark.createDataFrame([], s) for s in (RISKS, "analysis_id string, has_service boolean, has_key boolean", "analysis_id string, id string, explanation string", "analysis_id string, id string, explanation string, recommendation string, seq int")]
    assert report.enrich_by_path(*empty).collect() == []
