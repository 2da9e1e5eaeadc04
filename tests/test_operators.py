"""Operators against brute force, on fixtures with hot keys, ties, nulls and gaps."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from keepsight.operators import events as ev
from keepsight.operators import inventory as inv
from keepsight.operators import quality as q
from keepsight.operators import redaction, retention, schedule, verify
from keepsight.operators.order_stats import with_places
from keepsight.operators import runs as ops
from keepsight.operators.mapping import map_with_errors
from keepsight.operators.skew import salted_join

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def history():
    """Runs where one source holds most rows, many in one hour, some at one instant."""
    rng = random.Random(3)
    rows = []
    for i in range(600):
        source = "hot" if rng.random() < 0.7 else rng.choice(["a", "b", None])
        minute = rng.randint(0, 40) if rng.random() < 0.4 else rng.randint(0, 60 * 24 * 20)
        start = T0 + dt.timedelta(minutes=minute)
        rows.append(
            (i, source, start, start + dt.timedelta(minutes=rng.randint(1, 30)),
             rng.choice(["success", "partial", "failure"]), rng.randint(0, 50), rng.randint(0, 9000))
        )
    return rows


RUNS = "run_id long, source string, started_at timestamp, finished_at timestamp, status string, files long, bytes long"


def ordered(rows):
    out = {}
    for row in sorted(rows, key=lambda r: (r[2], r[0])):
        out.setdefault(row[1], []).append(row)
    return out


@pytest.mark.parametrize("chunk", ["minute", "hour", "month"])
def test_baseline_is_the_last_earlier_success(spark, history, chunk):
    expected = {}
    for rows in ordered(history).values():
        last = None
        for row in rows:
            expected[row[0]] = last
            last = row[0] if row[4] == "success" else last
    got = ops.baseline_asof(spark.createDataFrame(history, RUNS), chunk).collect()
    assert {r["run_id"]: r["baseline_run_id"] for r in got} == expected


@pytest.mark.parametrize("chunk", ["minute", "day"])
def test_overlap_sees_runs_from_earlier_chunks(spark, history, chunk):
    expected = {}
    for rows in ordered(history).values():
        busy = None
        for row in rows:
            if busy and busy > row[2]:
                expected[row[0]] = busy
            busy = max(busy or row[3], row[3])
    df = spark.createDataFrame(history, RUNS).withColumnRenamed("source", "repo")
    got = ops.overlapping_runs(df, chunk=chunk).collect()
    assert {r["run_id"]: r["busy_until"] for r in got} == expected


@pytest.mark.parametrize("block_rows", [7, 100_000])
def test_progress_frame_crosses_chunks_and_blocks(spark, history, block_rows):
    expected = {}
    for rows in ordered(history).values():
        for i, row in enumerate(rows):
            first = rows[max(0, i - 4)]
            seconds = (row[2] - first[2]).total_seconds()
            expected[row[0]] = round((row[0] - first[0]) / seconds, 2) if seconds > 0 else None
    df = spark.createDataFrame(history, RUNS).select(
        F.col("source").alias("run_id"), F.col("run_id").alias("event_id"),
        F.col("started_at").alias("ts"), F.col("run_id").alias("bytes_done"),
        F.lit(1000).cast("long").alias("total_bytes"),
    )
    got = ops.progress_eta(df, 4, block_rows=block_rows).collect()
    assert {r["event_id"]: r["rate"] for r in got} == pytest.approx(expected, abs=0.011)


def test_cursor_moves_only_on_success_and_frozen_shards_show(spark, history):
    df = spark.createDataFrame(history, RUNS).select(
        F.col("source").alias("repo"), "run_id", F.col("started_at").alias("ts"),
        (F.col("status") == "success").alias("ok"),
    )
    due, streaks = {}, []
    for repo, rows in ordered(history).items():
        passed = failed = 0
        for row in rows:
            due[row[0]] = passed % 5 + 1
            if row[4] == "success":
                if failed >= 3:
                    streaks.append((repo, passed % 5 + 1, failed))
                passed, failed = passed + 1, 0
            else:
                failed += 1
        if failed >= 3:
            streaks.append((repo, passed % 5 + 1, failed))
    got = verify.verify_cursor(df, 5).collect()
    assert {r["run_id"]: r["shard_due"] for r in got} == due
    frozen = verify.frozen_shard(df, 5, 3).collect()
    key = lambda t: (str(t[0]), *t[1:])
    assert sorted(((r["repo"], r["shard"], r["streak"]) for r in frozen), key=key) == sorted(streaks, key=key)


def brute_retention(rows, policy):
    reasons = {}
    groups = {}
    for sid, host, ts in rows:
        groups.setdefault(host, []).append((ts, sid))
    rules = {
        "daily": (policy.keep_daily, lambda t: t.date()),
        "weekly": (policy.keep_weekly, lambda t: t.isocalendar()[:2]),
        "monthly": (policy.keep_monthly, lambda t: (t.year, t.month)),
        "yearly": (policy.keep_yearly, lambda t: t.year),
    }
    for members in groups.values():
        members.sort(reverse=True)
        for _, sid in members[: policy.keep_last]:
            reasons.setdefault(sid, set()).add("last")
        for name, (keep, bucket) in rules.items():
            seen = []
            for ts, sid in members:
                if bucket(ts) not in seen:
                    seen.append(bucket(ts))
                    if len(seen) <= keep:
                        reasons.setdefault(sid, set()).add(name)
    return {sid: sorted(reasons.get(sid, ())) for sid, _, _ in rows}


@pytest.mark.parametrize(
    "policy",
    [
        retention.RetentionPolicy(),
        retention.RetentionPolicy(1, 0, 5, 0, 2),
        retention.RetentionPolicy(0, 3, 0, 2, 0),
        retention.RetentionPolicy(4, 0, 0, 0, 0),
    ],
)
def test_retention_plan(spark, policy):
    rng = random.Random(11)
    edges = [dt.datetime(2020, 12, 31, 23), dt.datetime(2021, 1, 1), dt.datetime(2021, 1, 3), dt.datetime(2021, 1, 4)]
    rows = [
        (i, "hot" if i % 3 else rng.choice(["x", None]),
         edges[i % 4] if i % 7 == 0 else T0 - dt.timedelta(hours=rng.randint(0, 24 * 900)))
        for i in range(300)
    ]
    df = spark.createDataFrame(rows, "snapshot_id long, host string, ts timestamp")
    got = retention.retention_plan(df, policy, ["host"]).collect()
    assert {r["snapshot_id"]: r["reasons"] for r in got} == brute_retention(rows, policy)
    assert all(r["keep"] == bool(r["reasons"]) for r in got)


def test_retention_days_follow_the_policy_zone(spark):
    rows = [(1, "h", dt.datetime(2024, 1, 1, 23)), (2, "h", dt.datetime(2024, 1, 2, 1))]
    df = spark.createDataFrame(rows, "snapshot_id long, host string, ts timestamp")
    policy = lambda zone: retention.RetentionPolicy(0, 5, 0, 0, 0, zone)
    kept = lambda zone: retention.retention_plan(df, policy(zone), ["host"]).filter("keep").count()
    assert (kept("UTC"), kept("America/New_York")) == (2, 1)


def test_unsafe_policy_gets_no_plan(spark):
    df = spark.createDataFrame([(1, "h", T0)], "snapshot_id long, host string, ts timestamp")
    with pytest.raises(ValueError, match="single snapshot"):
        retention.retention_plan(df, retention.RetentionPolicy(1, 0, 0, 0, 0), ["host"])


def test_salted_join_equals_join(spark):
    left = spark.range(500).selectExpr("id", "if(id % 3 = 0, 'hot', cast(id % 7 as string)) AS k")
    right = spark.createDataFrame([("hot", 1), ("1", 2), ("9", 3)], "k string, v int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert sorted(salted_join(left, right, ["k"], how, ["id"]).collect(), key=str) == sorted(
            left.join(right, "k", how).select(*salted_join(left, right, ["k"], how, ["id"]).columns).collect(), key=str
        )
    with pytest.raises(ValueError):
        salted_join(left, right, ["k"], "full", ["id"])


def test_values_read_in_one_pass_equal_values_by_path(spark):
    texts = ['{"a":{"b":1,"c":null},"d":"x"}', '{"a":[1],"d":{"b":2}}', '{"a":null}', "[1]", "3", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("doc", F.try_parse_json("t"))
    paths = ["a", "a.b", "a.c", "d", "d.b", "a[0]"]
    read = q.with_values(F.col("doc"), paths, lambda v: F.array(*[F.to_json(v[p]) for p in paths]))
    by_path = F.array(*[F.to_json(q.value_at(F.col("doc"), p)) for p in paths])
    rows = df.select(read.alias("x"), by_path.alias("y")).collect()
    assert [r["x"] for r in rows] == [r["y"] for r in rows]


def test_salted_join_never_gathers_the_repeated_side(spark):
    left = spark.range(500).selectExpr("id", "id % 7 AS k")
    joined = salted_join(left, spark.range(9).selectExpr("id AS k", "id AS v"), ["k"], "left", ["id"])
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.filter("v = k").count() == 500


def test_missed_runs_at_the_edges_of_the_tolerance(spark):
    fire = dt.datetime(2024, 1, 1, 2)
    expected = spark.createDataFrame([(j, fire) for j in "abcde"], "job string, fire_at timestamp")
    minute = dt.timedelta(minutes=1)
    late = dt.timedelta(microseconds=1)
    runs = spark.createDataFrame(
        [("a", fire), ("b", fire + 90 * minute), ("c", fire + 90 * minute + late), ("d", fire - late),
         ("e", fire - late), ("e", fire + 45 * minute)],
        "job string, started_at timestamp",
    )
    missed = schedule.missed_runs(expected, runs, 90).collect()
    assert sorted(r["job"] for r in missed) == ["c", "d"]


def test_schedules_honour_their_zone_and_refusals_are_listed(spark):
    rows = [("u", "0 2 * * *", None), ("n", "0 2 * * *", "America/New_York"), ("bad", "0 0 1 * 1", None)]
    df = spark.createDataFrame(rows, "job string, cron string, timezone string")
    fired = schedule.expected_runs(df, T0, T0 + dt.timedelta(days=1)).collect()
    assert {(r["job"], r["fire_at"].hour) for r in fired} == {("u", 2), ("n", 7)}
    assert [(r["job"], r["reason"]) for r in schedule.schedule_errors(df).collect()] == [("bad", "day_and_weekday")]


def test_shards_are_spread_and_stable(spark):
    ids = spark.range(2000).withColumn("key", F.col("id").cast("string"))
    for method in ("sha256", "xxhash64"):
        counts = verify.verify_shards(ids, "key", 8, method).groupBy("shard").count().collect()
        assert sorted(r["shard"] for r in counts) == list(range(1, 9))
        assert min(r["count"] for r in counts) > 180


def test_pack_plan_reproduces_the_projection(spark):
    totals = spark.createDataFrame([("s", 1, 4 * 1024**4)], "source string, files long, bytes long")
    got = {r["pack_mib"]: r for r in ops.pack_plan(totals, connections=5).collect()}
    assert [got[m]["objects"] for m in (16, 64, 128)] == [262144, 65536, 32768]
    assert [got[m]["metadata_days"] for m in (16, 64, 128)] == [18.2, 4.6, 2.3]
    assert got[16]["transfer_days"] == 10.2 and got[128]["temp_bytes"] == 768 * 1024**2
    assert [got[m]["bottleneck"] for m in (16, 64, 128)] == ["metadata", "bandwidth", "bandwidth"]


def test_verdicts(spark):
    ratio = ops.dedup_stats(spark.createDataFrame(
        [("r", 21474836480, 10737418240, 8589934592)],
        "run_id string, total_bytes_processed long, data_added long, data_added_packed long",
    )).first()["ratio"]
    assert ratio == 0.4
    pairs = spark.createDataFrame(
        [(1, "interrupted", None, 10000), (1, "resume", 2496, None), (2, "interrupted", None, 0),
         (2, "resume", 5, None), (3, "interrupted", 100, 900), (3, "resume", 49, None),
         (4, "interrupted", 100, 0), (4, "resume", 50, None), (5, "interrupted", 1000, None)],
        "pair_id int, role string, data_added long, bytes_done long",
    )
    got = {r["pair_id"]: (r["reupload_pct"], r["verdict"]) for r in ops.resume_cost(pairs).collect()}
    # 24.96 is shown as 25.0, which is no longer under 25
    assert got == {1: (25.0, "WARN"), 2: (None, "WARN"), 3: (49.0, "WARN"), 4: (50.0, "FAIL"), 5: (0.0, "PASS")}
    checks = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 0)], "run_id int, exit_code int")
    errors = spark.createDataFrame([(2, "3"), (4, "0")], "run_id int, value string")
    got = {r["run_id"]: (r["errors"], r["verdict"]) for r in ops.integrity_verdict(checks, errors).collect()}
    assert got == {1: (0, "PASS"), 2: (3, "FAIL"), 3: (None, "FAIL"), 4: (0, "PASS")}


def test_rank_handles_ties_and_negative_totals(spark):
    totals = {f"s{i}": v for i, v in enumerate([5, 5, 0, 0, 0, -3, -40, 7, 12345, 12399, 5])}
    df = spark.createDataFrame(list(totals.items()), "source string, bytes long")
    for row in ops.rank_sources(df).collect():
        mine = totals[row["source"]]
        assert row["rank"] == 1 + sum(v > mine for v in totals.values())
        assert row["running"] == sum(v for v in totals.values() if v >= mine)
        assert row["percent_rank"] == (row["rank"] - 1) / (len(totals) - 1)


@pytest.mark.parametrize("n,tiles", [(1, 10), (3, 10), (10, 3), (2000, 7)])
def test_places_and_tiles_of_near_equal_totals(spark, n, tiles):
    """A narrow band of values is spread over the ranges, so no task has twice its share."""
    values = [(f"s{i:05}", 10**12 + i % 997) for i in range(n)]
    got = {r["source"]: r for r in ops.rank_sources(spark.createDataFrame(values, "source string, bytes long"), tiles=tiles).collect()}
    order = sorted(values, key=lambda v: (-v[1], v[0]))
    sizes = [n // tiles + (k < n % tiles) for k in range(tiles)]
    want = [k + 1 for k, size in enumerate(sizes) for _ in range(size)]
    assert [got[s]["tile"] for s, _ in order] == want
    placed = with_places(spark.createDataFrame(values, "source string, bytes long"), [F.desc("bytes"), F.col("source")], ["bytes"])
    rows = sorted(placed.collect(), key=lambda r: r["_place"])
    assert [r["source"] for r in rows] == [s for s, _ in order] and [r["_place"] for r in rows] == list(range(1, n + 1))
    assert rows[-1]["_upto_bytes"] == rows[0]["_all_bytes"] == sum(v for _, v in values)
    if n >= 2000:
        dealt = placed.withColumn("_task", F.spark_partition_id()).groupBy("_task").count().collect()
        assert max(r["count"] for r in dealt) < n / 2


def test_sources_without_a_total(spark):
    df = spark.createDataFrame([("a", None), ("b", 3), (None, 3)], "source string, bytes long")
    got = {r["source"]: (r["rank"], r["tile"], r["running"]) for r in ops.rank_sources(df).collect()}
    assert got == {None: (1, 1, 6), "b": (1, 2, 6), "a": (3, 3, 6)}


def test_tokens_that_cannot_be_read_are_null(spark):
    tokens = ["a.eyJleHAiOjE3MDQwNjcyMDB9.c", "a.!!.c", "a", "a.eyJ4IjoxfQ.c", "a.A.c", None]
    df = spark.createDataFrame([(t,) for t in tokens], "t string")
    got = [r["hours_left"] for r in ev.token_expiry_audit(df, "t", F.lit(T0 - dt.timedelta(hours=5))).collect()]
    assert got == [5, None, None, None, None, None]


def test_marker_files_and_protected_paths(spark):
    paths = ["/.x", "/a/.nobackup", "/a/f", "/a/b/c/f", "/ab/f", "/d/e/.nobackup", "/d/f", "/d/e/g/h"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert sorted(r["path"] for r in inv.exclude_if_present(df).collect()) == ["/.x", "/ab/f", "/d/f"]
    sources = spark.createDataFrame([("root", "/"), ("st", "/state/"), ("s", "/sta"), ("c", "/cache")], "name string, path string")
    guarded = spark.createDataFrame([("conf", "/state/rc.conf"), ("tmp", "/cache")], "label string, protected_path string")
    got = {(r["name"], r["label"]) for r in inv.protected_path_check(sources, guarded).collect()}
    assert got == {("root", "conf"), ("root", "tmp"), ("st", "conf")}


def folded(text, secrets):
    """One usable value after another, longest first."""
    for value in sorted({s for s in secrets if len(s) >= 8 and s not in "[redacted]"}, key=lambda v: (-len(v), v)):
        text = text and text.replace(value, "[redacted]")
    return text


@pytest.mark.parametrize("many,block", [(10, 1 << 25), (501, 1 << 25), (501, 5000), (100_000, 1 << 25)])
def test_any_number_of_secrets_equals_the_fold(spark, many, block):
    rng = random.Random(many)
    words = ["abandon", "ability", "äble", "zoo", "horse", "cörrect", "battery", "staple"]
    secrets = [" ".join(rng.choices(words, k=6)) for _ in range(20)]
    secrets += ["abc-defgh", "x-y-z-w-v", "........x", "battery-staple", "hunter2hunter2", "eyJhbGci" + "Q" * 9, "eyJhbGci" + "Z" * 9]
    # values that arise only beside a marker, or from two of them
    secrets += ["a[redacted]b", "[redacted][redacted]", "zz [redac", "ted] qq ww", "短い秘密の言葉です"]
    hot = [f"sk-live-{k:07}" for k in range(many)]
    texts = [
        (i, " ".join(rng.choices(words, k=20)) + rng.choice(["", "x", " a", "zz "]) + rng.choice(secrets + hot[:9])
         + rng.choice(["y", "", "b", " qq ww"]) + rng.choice(["", rng.choice(hot)]))
        for i in range(300)
    ] + [(900, ""), (901, None), (902, "no secret here"), (903, "ahunter2hunter2b"), (904, "短い秘密の言葉ですhunter2hunter2")]
    df = spark.createDataFrame(texts, "id long, text string")
    table = spark.createDataFrame([(s,) for s in secrets + hot] + [("short",), ("redacted",)], "value string")
    rows = redaction.redact(df, ["text"], table, block_bytes=block).collect()
    assert {r["id"]: r["text"] for r in rows} == {i: folded(x, secrets + hot) for i, x in texts}
    reasons = {r["value"]: r["reason"] for r in redaction.rejected_secrets(table).collect()}
    assert reasons == {"short": "too_short", "redacted": "inside_marker"}


def test_credential_scan_reaches_into_arrays_and_to_any_depth(spark):
    docs = {
        1: '{"a":{"password":"x"},"secrets":{"provider":"env"},"tokens":["a","b"],"l":[{"API-key":1,"api_key":null}]}',
        2: '{"a":' * 10 + '{"token":1}' + "}" * 10, 3: "not json", 4: '{"secret":{}, "credential":[]}', 5: "[]",
        6: '{"a":' * 990 + '{"token":1}' + "}" * 990, 7: "[" * 970 + '{"token":[],"b":{"my_secret":false}}' + "]" * 970,
        8: '{"a":' * 8 + '{"token":{}}' + "}" * 8, 9: '{"a":' * 8 + '"x"' + "}" * 8, 10: '{"a":' * 7 + '{"password":2}' + "}" * 7,
    }
    df = spark.createDataFrame(list(docs.items()), "id long, j string")
    got = {(r["id"], r["path"], r["rule"]) for r in q.credential_key_scan(df, "j", "id").collect()}
    assert got == {
        (1, "a.password", "credential"), (1, "l[0].api_key", "credential"),
        (2, ".".join([*"a" * 10, "token"]), "credential"),
        (6, ".".join([*"a" * 990, "token"]), "credential"), (7, "[0]" * 970 + ".b.my_secret", "credential"),
        (10, ".".join([*"a" * 7, "password"]), "credential"),
    }
    parsed = df.withColumn("v", F.try_parse_json("j"))
    assert {(r["id"], r["path"], r["rule"]) for r in q.credential_key_scan(parsed, "v", "id").collect()} == got


MINIMAL = '{{"repo":{{"path":"r"{repo}}},"source":[{{"name":"photos","path":"/data/photos","min_files":1000,"min_bytes":"10G","max_shrink_pct":50{source}}}{more}]{top}}}'
CASES = [
    ({}, set()),
    ({"top": ',"retention":{"keep_dayly":3}'}, {("retention.keep_dayly", "unknown_key")}),
    ({"repo": ',"pack_size_mib":3'}, {("repo.pack_size_mib", "min")}),
    ({"repo": ',"pack_size_mib":129'}, {("repo.pack_size_mib", "max")}),
    ({"repo": ',"connections":2.5'}, {("repo.connections", "type")}),
    ({"repo": ',"connections":0'}, {("repo.connections", "min")}),
    ({"repo": ',"connections":2.0'}, set()),
    ({"repo": ',"backend":"s3"'}, {("repo.backend", "enum")}),
    ({"repo": ',"rclone_config":"/dev/null"'}, {("repo.rclone_config", "pattern")}),
    ({"repo": ',"cache_dir":"/data/photos/cache"'}, {("source", "protected_path")}),
    ({"more": ',{"name":"photos","path":"/other","min_files":0,"min_bytes":1,"max_shrink_pct":0}'}, {("source", "unique")}),
    ({"more": ',{"name":"bad name","path":"rel","min_files":-1,"min_bytes":"1GB","max_shrink_pct":101}'},
     {("source[1].name", "pattern"), ("source[1].path", "pattern"), ("source[1].min_files", "min"),
      ("source[1].min_bytes", "type"), ("source[1].max_shrink_pct", "max")}),
    ({"more": ',{"name":"x","path":"/x"}'},
     {("source[1].min_files", "required"), ("source[1].min_bytes", "required"), ("source[1].max_shrink_pct", "required")}),
    ({"source": ',"tags":["a",1]'}, {("source[0].tags", "type")}),
    ({"source": ',"tags":[]'}, set()),
    ({"source": ',"one_file_system":"yes"'}, {("source[0].one_file_system", "type")}),
    ({"top": ',"schema_version":2'}, {("schema_version", "schema_version")}),
    ({"top": ',"secrets":{"provider":"command"}'}, {("secrets.command", "conditional_required")}),
    ({"top": ',"secrets":{"retry_delay":5}'}, {("secrets.retry_delay", "type")}),
    ({"top": ',"retention":{"keep_last":1,"keep_daily":0,"keep_weekly":0,"keep_monthly":0,"keep_yearly":0}'},
     {("retention", "retention_safe")}),
    ({"top": ',"retention":{"keep_last":2,"keep_daily":0,"keep_weekly":0,"keep_monthly":0,"keep_yearly":0}'}, set()),
    ({"top": ',"bandwidth":{"timetable":"08:00,fast","window_stop":"7:30"}'},
     {("bandwidth.timetable", "type"), ("bandwidth.window_stop", "pattern")}),
    ({"top": ',"limits":[]'}, {("limits", "type")}),
    ({"top": ',"reports":{"dir":" "}'}, {("reports.dir", "type")}),
    ({"repo": ',"password":"x"'}, {("repo.password", "unknown_key"), ("repo.password", "credential")}),
    ({"top": ',"secrets":{"provider":"env","api_key":"x"}'}, {("secrets.api_key", "unknown_key"), ("secrets.api_key", "credential")}),
    ({"top": ',"secrets":{"provider":"env","variable":"RESTIC_PASSWORD"}'}, set()),
    ({"source": ',"tags":["a",{"token":null}]'}, {("source[0].tags", "type"), ("source[0].tags[1].token", "credential")}),
    ({"repo": ',"cache_dir":' + '{"a":' * 900 + '{"secret":1}' + "}" * 900},
     {("repo.cache_dir", "type"), ("repo.cache_dir." + "a." * 900 + "secret", "credential")}),
]


def test_config_documents(spark):
    docs = [
        (i, MINIMAL.format(**{"repo": "", "source": "", "more": "", "top": "", **overlay}))
        for i, (overlay, _) in enumerate(CASES)
    ]
    docs += [(100, "{}"), (101, '{"repo":{"path":"r"},"source":[]}')]
    docs += [(102, "[]"), (103, '"{}"'), (104, "not json"), (105, None), (106, "null"), (107, '[{"token":1}]')]
    df = spark.createDataFrame(docs, "doc_id long, j string").withColumn("doc", F.try_parse_json("j"))
    found = {}
    for r in q.validate_config(df).collect():
        found.setdefault(r["doc_id"], set()).add((r["path"], r["rule"]))
    for i, (overlay, expected) in enumerate(CASES):
        assert found.get(i, set()) == expected, overlay
    assert found[100] == {("repo.path", "required"), ("source", "required")}
    assert found[101] == {("source", "type")}
    assert all(found[i] == {("config", "type")} for i in range(102, 108))


def test_map_with_errors_isolates_rows(spark):
    df = spark.range(10).repartition(3)

    def fn(row):
        if row["id"] % 2:
            raise RuntimeError(f"odd {row['id']}")
        return row["id"] * 10

    got = {r["id"]: (r["success"], r["value"], r["error"]) for r in map_with_errors(df, fn, "long", "id").collect()}
    assert got == {i: (False, None, f"odd {i}") if i % 2 else (True, i * 10, None) for i in range(10)}


def test_map_with_errors_keeps_values_exact(spark):
    big = 2**53 + 1
    df = spark.createDataFrame([(1, big), (2, None), (3, 5)], "id long, n long").coalesce(1)
    seen = lambda row: {5: "text"}.get(row["n"], row["n"])
    got = {r["id"]: (r["success"], r["value"]) for r in map_with_errors(df, seen, "long", "id").collect()}
    assert got == {1: (True, big), 2: (True, None), 3: (False, None)}


def test_retention_keeps_equal_ids_of_hosts_apart(spark):
    rows = [("A", "s1", "2024-01-01 00:00:00"), ("A", "s2", "2024-01-02 00:00:00"), ("B", "s1", "2024-01-05 00:00:00")]
    df = spark.createDataFrame(rows, "host string, snapshot_id string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = retention.retention_plan(df, retention.RetentionPolicy(0, 1, 0, 0, 0), ["host"]).collect()
    assert sorted((r["host"], r["snapshot_id"], r["keep"]) for r in got) == [("A", "s1", False), ("A", "s2", True), ("B", "s1", True)]


def test_schema_version_is_compared_by_type(spark):
    docs = [(1, '{"schema_version":1}'), (2, '{"schema_version":"1"}'), (3, "{}"), (4, '{"schema_version":2}')]
    df = spark.createDataFrame(docs, "doc_id long, j string").select("doc_id", F.parse_json("j").alias("doc"))
    assert sorted(r["doc_id"] for r in q.check_schema_version(df).collect()) == [2, 4]


def test_globs_by_table_match_globs_by_dict(spark):
    rng = random.Random(4)
    globs = {
        "a": ["d1/**", "d2/*.log", "**/x?", "d1/{e,f}/[a-c]*", "top", "d2/e/"], "b": ["**"], "none": [],
        "many": [f"d{k % 3}/f{k}.*" for k in range(300)], "c": ["d1/e/*", "d*/e/y1", "\\*lit"],
    }
    names = ["x1", "y1", "top", "a.log", "bz", "*lit", "line\nbreak"] + [f"f{k}.txt" for k in range(0, 400, 7)]
    rows = [
        (rng.choice([*globs, "other", None]), "/".join([*rng.choice([[], ["d1"], ["d2"], ["d1", "e"], ["", "d0"], ["d0"]]), rng.choice(names)]))
        for _ in range(3000)
    ]
    rows += [("a", None), ("b", "same"), ("c", "same"), ("c", "same"), ("a", ""), (None, None)]
    files = spark.createDataFrame(rows, "source string, path string")
    table = spark.createDataFrame(
        [(s, g) for s, gs in globs.items() for g in gs] + [("a", None), (None, "**"), ("b", "**")], "source string, pattern string"
    )
    want = inv.glob_filter_by_source(files, "path", globs)
    got = inv.glob_filter_by_table(files, table)
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
    assert inv.glob_filter_by_table(files, table.limit(0)).count() == len(rows)


def test_stored_sketches_merge_upwards(spark):
    rows = spark.range(200_000).selectExpr(
        "CASE WHEN id % 10 < 9 THEN 'hot' ELSE 'cold' END AS source", "id % 7 AS day", "CAST(id % 5000 AS STRING) AS content"
    )
    rows = rows.union(spark.createDataFrame([("empty", 0, None)], rows.schema))
    daily = inv.content_sketches(rows, ["source", "day"], "content")
    exact = {"hot": 4500, "cold": 500, "empty": 0}
    for r in inv.merged_content(daily, ["source"]).collect():
        assert abs(r["approx_contents"] - exact[r["source"]]) <= 0.04 * exact[r["source"]], r
    assert inv.merged_content(daily.limit(0), ["source"]).count() == 0


def test_summaries_of_sketches_match_exact_ranks(spark):
    rng = random.Random(8)
    rows = [(rng.choice("ab"), rng.choice(["x", None]), rng.choice(["success", "failure"]), rng.randint(0, 10**6), 1) for _ in range(20_000)]
    rows += [("idle", "x", "failure", None, None)]
    reports = spark.createDataFrame(rows, "mode string, code string, status string, duration_ms bigint, failed_files int")
    sketches = ops.run_sketches(reports, ["mode", "code"])
    found = ops.summary_of(sketches, ["mode", "code"]).collect()
    assert len(found) == 5 + 3 + 2 + 1
    for r in found:
        part = [x for x in rows if (r["level"] & 2 or x[0] == r["mode"]) and (r["level"] & 1 or x[1] == r["code"])]
        known = sorted(x[3] for x in part if x[3] is not None)
        assert r["runs"] == len(part)
        for name, q_ in (("duration_p50_ms", 0.5), ("duration_p95_ms", 0.95)):
            if not known:
                assert r[name] is None
            else:
                assert abs(sum(x <= r[name] for x in known) / len(known) - q_) < 0.02
    some = ops.summary_of(sketches, ["mode", "code"], [["mode"], []])
    assert sorted(r["level"] for r in some.collect()) == [1, 1, 1, 3]
