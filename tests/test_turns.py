import pytest
from pyspark.sql import functions as F

from credence.operators import contexts, field, turns

KIND = "session_id string, turn_idx int, role string, text string, is_meta boolean, tool_uses array<struct<name:string,tool_use_id:string,input_summary:string>>, tool_results array<struct<tool_use_id:string,output_summary:string,is_error:boolean>>"


def test_regions_in_order(spark):
    use, bad = lambda n, s="": (n, "u", s), [("u", "x", True)]
    cases = [
        (("user", "<command-message>x</command-message><command-name>/Morning</command-name>", True, [], []), ("pipeline_run", "slash_command=/morning")),
        (("user", "/odd thing", True, [], []), ("UNCLASSIFIED", "unknown_slash_command=/odd")),
        (("user", "<system-reminder>deploy it</system-reminder>", True, [], []), ("UNCLASSIFIED", "system_reminder")),
        (("user", "ship it!", False, [], bad), ("deploy_readiness", "user_deploy_intent")), (("user", "that is wrong", False, [], bad), ("failure_diagnosis", "user_correction")),
        (("user", "go", False, [], bad), ("failure_diagnosis", "tool_error_in_result")), (("user", None, None, None, None), ("UNCLASSIFIED", "user_default")),
        (("assistant", "debugging", False, [use("Bash", "curl x"), use("WebFetch")], []), ("data_fetch", "tool_name=WebFetch")), (("assistant", "", False, [use("Bash", "ls"), use("Bash", "curl x && git push")], []), ("deploy_readiness", r"bash_pattern=deploy_readiness:\bgit push\b")),
        (("assistant", "error", False, [use("Write", "file=/Report.md")], []), ("report_generation", "write_report_artifact")), (("assistant", "Let me check", False, [use("Read", "file=x")], []), ("failure_diagnosis", "assistant_diagnosis_text")),
        (("assistant", "ok", False, [use("Read", "file=x"), use("Read", "file=y")], []), ("validation", "read_only_inspection")), (("assistant", "ok", False, [use("Read", "file=x"), use("Edit", "file=y.py")], []), ("UNCLASSIFIED", "assistant_default")),
    ]
    df = spark.createDataFrame([("s", i, *row) for i, (row, _) in enumerate(cases)], KIND)
    assert [tuple(r[0]) for r in df.orderBy("turn_idx").select(turns.region()).collect()] == [want for _, want in cases]


def test_schema_audit_and_mode(spark):
    df = spark.createDataFrame([("a", 1)], "belief_id string, prompt_hint int")
    got = {(r.field, r.fault) for r in contexts.audit_schema(df, ["belief_id", "claim"]).collect()}
    assert got == {("claim", "missing"), ("prompt_hint", "forbidden")} and contexts.audit_schema(df, ["belief_id"], []).count() == 0
    assert [r[0] for r in contexts.with_mode(spark.createDataFrame([("b",), ("a",), (None,), (None,), (None,)], "variant string")).collect()] == ["a"]


def test_token_cut(spark):
    df = spark.createDataFrame([("a b c d e",), ("a b",), (None,)], "out string")
    got = [(r.out, r.was_cut) for r in contexts.cut_tokens(df, "out", 3, str.split, " ".join).collect()]
    assert got == [("a b c\n[+2 tokens elided]", True), ("a b", False), (None, False)]


def test_warrants_keep_their_quirks(spark):
    read = lambda j: spark.createDataFrame([(j,)], "j string").select(contexts.warrant_from_json(F.col("j")).alias("w")).first().w
    head = '{"schema_version":"warrant-v0.1","warrant_type":'
    w = read(head + '"decaying","confidence":0.0,"relaxation_half_life_seconds":60}')
    assert (w.initial_confidence, w.confidence, w.half_life_seconds, w.coverage_status, w.support_n) == (1.0, 0.0, 60.0, "UNCLASSIFIED", 0)
    w = read(head + '"invariant"}')
    assert (w.validation_status, w.evidence_refs, w.initial_confidence) == ("UNKNOWN", [], None)
    for bad, why in ((head + '"decaying"}', "requires relaxation"), (head + '"odd"}', "invalid warrant_type"), ('{"warrant_type":"invariant"}', "unsupported schema_version")):
        with pytest.raises(Exception, match=why):
            read(bad)


def test_cohort_in_words(spark):
    cohorts = spark.createDataFrame([(1, ["a", "b", "c", "d", "e", "f", "z"]), (2, ["z"]), (3, ["a", "b", "c"])], "question_id int, cohort array<string>")
    snapshot = spark.createDataFrame([(x, "up" if x in "abc" else "down") for x in "abcdef"], "actor string, state_class string")
    prior = spark.createDataFrame([("a", "down"), ("b", "down"), ("c", "up"), ("d", "down"), ("e", "down")], "actor string, prior_class string")
    got = {r.question_id: r for r in field.cohort_state(cohorts, snapshot, prior, ["down"]).collect()}
    assert got[1].missing == ["z"] and got[1].cohesion == "cohort no longer one coherent class — down and up both visible"
    assert (got[1].transitions, got[1].n_emerging, got[1].n_repeating, got[1].n_tension, got[1].pressure, got[1].split_ready) == (2, 1, 1, 1, 45, True)
    assert got[2].cohesion == "no cohort members found in current snapshot" and got[2].pressure == 0 and got[2].in_snapshot == []
    assert got[3].cohesion == "cohort behaving as one coherent class" and got[3].n_emerging == 1
    s = spark.createDataFrame([("word " * 40,), ("a\nb",), (None,)], "t string").select(field.short_words(F.col("t"))).collect()
    assert len(s[0][0]) <= 130 and s[0][0].endswith("word…") and s[1][0] == "a b" and s[2][0] == ""


def test_regions_end_words_as_the_sql_does(spark):
    """Letters of other scripts stand beside a word, and the signs that fold to k and s are these letters."""
    import duckdb

    from credence.operators import replay
    from credence.plans.replay import SQL_REGION

    texts = ["noé l", "éyes", "OK", "yeſ", "oKé", "oKa", "I can't", "cannót", "cannot́", "teſtü", "测test测", "tests_", "please", "pleaſeß", "checK", "dıd", "fİx", "what?", "", None]
    rows = [(i, role, t) for i, (role, t) in enumerate((r, t) for r in ("user", "assistant", "system", None) for t in texts)]
    d = spark.createDataFrame(rows, "id int, role string, text string")
    got = {r.id: r.region for r in d.select("id", replay.classify_turn(F.col("role"), F.col("text"))["region"].alias("region")).collect()}
    c = duckdb.connect()
    c.sql("CREATE TABLE t (id INT, role VARCHAR, text VARCHAR)")
    c.executemany("INSERT INTO t VALUES (?, ?, ?)", rows)
    assert got == dict(c.sql(f"SELECT id, {SQL_REGION} FROM t").fetchall())


def test_density_compares_blocks_and_joins_no_pairs(spark, monkeypatch):
    """Windows over several slots and blocks, against plain sums; events meet in blocks, not as rows of a join."""
    import datetime as dt
    import random

    monkeypatch.setattr(field, "BLOCK", 3)
    rng, start = random.Random(3), dt.date(2024, 1, 1)
    rows = [(rng.choice("abc"), start + dt.timedelta(rng.choice([0, 1, 2, 5, 6, 7, 11, 30])), [rng.gauss(0, 1) for _ in range(4)], rng.randrange(3)) for _ in range(60)]
    rows += [("a", start, [0.0] * 4, 1), rows[0]]
    days, least = 3, 0.2
    out = field.density(spark.createDataFrame(rows, "actor string, date date, embedding array<float>, r int"), days, least, "r")
    plan = out._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "zip_with(u" not in plan
    units = [(a, d, [x / sum(y * y for y in v) ** 0.5 for x in v], r) for a, d, v, r in rows if any(v)]
    want = {}
    for actor, day in {(a, d) for a, d, _, _ in units}:
        field_ = [x for x in units if 0 <= (day - x[1]).days <= days]
        own = [x for x in field_ if x[0] == actor]
        sims = [(sum(p * q for p, q in zip(x[2], y[2])), y[3]) for x in own for y in field_ if y[0] != actor]
        s, ws = sum(v for v, _ in sims if v > least), sum(v * r for v, r in sims if v > least)
        want[actor, day] = (len(own), s / len(own) / len(field_), ws / len(own) / len(field_))
    got = {(r.actor, r.day): (r.n, r.density, r.weighted) for r in out.collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and all(abs(x - y) < 1e-5 for x, y in zip(got[k][1:], want[k][1:])) for k in want)


def test_every_retirement_of_a_day_counts(spark, tmp_path):
    """Two retirements of one expectation on a day are two, and the days' rows give the rate."""
    import datetime as dt

    from credence.plans.field import field_mortality

    rows = [(i, dt.datetime(2024, 1, day, 1), 1, kind, 1.0, '{"k": 1}') for i, (day, kind) in enumerate([(1, "view"), (1, "error"), (1, "error"), (2, "view"), (8, "error"), (9, "click")])]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    got = {r.as_of.day: (r.mortality, r.rate) for r in field_mortality(spark, str(tmp_path)).collect()}
    assert got == {1: (2, 0.666667), 2: (2, 1.0), 8: (3, 1.8), 9: (1, 1.0)}


def test_a_warrant_is_parsed_once(spark):
    d = spark.createDataFrame([('{"schema_version":"warrant-v0.1","warrant_type":"invariant"}',)], "j string").select(contexts.warrant_from_json(F.col("j")).alias("w")).select("w.warrant_type", "w.validation_status", "w.initial_confidence")
    assert tuple(d.first()) == ("invariant", "UNKNOWN", None)
    assert d._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
