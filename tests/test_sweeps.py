"""Sweeps, greedy rounds, indexes and upkeep against plain algorithms."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.operators import graph, greedy, ivfpq, keywords, lookup, sweep, upkeep, vector
from lodestrata.streaming import jobs


@pytest.fixture
def many_partitions(spark):
    """Few rows in many partitions, so that keys span them."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_as_of_over_nested_and_overlapping_versions(spark, many_partitions):
    r = random.Random(2)
    key = lambda: "hot" if r.random() < 0.5 else r.choice("abc")
    versions = [(i, key(), s := r.randrange(60), None if r.random() < 0.1 else s + r.randrange(-1, 25), f"v{i}") for i in range(400)]
    probes = [(p, key(), r.randrange(-2, 80)) for p in range(300)] + [(900, "hot", None), (901, None, 3), (902, "z", 3), (5, "hot", 7)]
    h = spark.createDataFrame(versions, "id bigint, name string, t_valid_from int, t_valid_to int, what string").repartition(3)
    p = spark.createDataFrame(probes, "p int, name string, at int").repartition(3)
    got = sorted((tuple(x) for x in lookup.as_of_join(p, h, "name").select("p", "name", "at", "id", "what").collect()), key=repr)
    want = []
    for n, k, at in probes:
        fit = [v for v in versions if at is not None and v[1] == k and v[2] <= at and (v[3] is None or v[3] > at)]
        best = max(fit, key=lambda v: (v[2], v[0]), default=None)
        want.append((n, k, at, best and best[0], best and best[4]))
    assert got == sorted(want, key=repr)
    assert lookup.as_of_join(p, h.where("false"), "name").where("id IS NOT NULL").isEmpty()


def test_as_of_by_times_and_dates(spark):
    h = spark.createDataFrame([(1, "k", datetime(2024, 1, 1), None), (2, "k", datetime(2024, 1, 5), datetime(2024, 1, 7))], "id bigint, key string, t_valid_from timestamp_ntz, t_valid_to timestamp_ntz")
    p = spark.createDataFrame([("k", datetime(2024, 1, 6)), ("k", datetime(2024, 1, 8))], "key string, at timestamp_ntz")
    assert sorted(r["id"] for r in lookup.as_of_join(p, h, "key").collect()) == [1, 2]
    day = lambda d, *c: d.select(*[F.col(x).cast("date").alias(x) if x.startswith(("t_", "at")) else x for x in d.columns])
    assert sorted(r["id"] for r in lookup.as_of_join(day(p), day(h), "key").collect()) == [1, 2]


def test_overlap_of_a_hot_file(spark, many_partitions):
    r = random.Random(3)
    file = lambda: "hot" if r.random() < 0.6 else r.choice(["a", "b", None])
    edits = [(file(), lo := r.randrange(3000), lo + r.randrange(-2, 4)) for _ in range(300)] + [("a", None, 4), ("hot", 5, 5), ("hot", 5, 5)]
    asked = [(k, file(), lo := r.randrange(3000), lo + r.randrange(-2, 9)) for k in range(500)] + [(900, "hot", None, 3), (901, "hot", 5, 5)]
    e = spark.createDataFrame(edits, "file_path string, lo int, hi int")
    b = spark.createDataFrame(asked, "bonus_id bigint, file_path string, line_lo int, line_hi int")
    got = {x["bonus_id"]: x["touched"] for x in lookup.edit_overlap(b, e).collect()}
    for k, f, lo, hi in asked:
        want = None not in (f, lo) and lo <= hi and any(f == g and None not in (x, y) and x <= y and max(lo, x) <= min(hi, y) for g, x, y in edits)
        assert got[k] == want, (k, f, lo, hi)


def test_running_max_spans_partitions(spark, many_partitions):
    rows = [(k % 2, k, (k * 37) % 101) for k in range(200)]
    got = sweep.running_max(spark.createDataFrame(rows, "k int, at int, v int"), ["k"], ["at"], "v", "m").collect()
    for x in got:
        assert x["m"] == max(v for k, at, v in rows if k == x["k"] and at <= x["at"])


def serial(items, threshold):
    leaders, out = [], {}
    for group, place, words in sorted(items, key=lambda x: x[1]):
        w = set(words)
        first = next((p for g, p, v in leaders if w and g == group and len(w & v) >= threshold * len(w | v)), None)
        if first is None:
            leaders.append((group, place, w))
        out[place] = place if first is None else first
    return out


@pytest.mark.parametrize("head,threshold", [(64, 0.9), (4, 0.75)])
def test_greedy_rounds_equal_the_serial_order(spark, head, threshold):
    r = random.Random(7)
    words = [f"w{k}" for k in range(14)]
    items = [("hot" if r.random() < 0.5 else r.choice("ab"), k, sorted(r.sample(words, r.choice([0, 3, 9, 10, 11])))) for k in range(80)]
    base = [f"x{k}" for k in range(20)]
    items += [("hot", 500 + k, sorted([*base[:k % 20], *base[k % 20 + 1 :], f"y{k}"])) for k in range(40)]  # near copies that form chains
    df = spark.createDataFrame(items, "group string, place bigint, words array<string>").repartition(4)
    got = {x["place"]: x["leader"] for x in greedy.first_leaders(df, threshold, head).collect()}
    assert got == serial(items, threshold)


@pytest.mark.parametrize("threshold", [0.9, 0.75])
def test_only_similar_sets_meet(spark, threshold):
    r = random.Random(3)
    words = [f"w{k}" for k in range(60)]
    sets = {k: set(r.sample(words, r.randint(1, 45))) for k in range(600)}  # common words all of them
    near = {1000 + k: {*r.sample(sorted(v), max(1, round(len(v) * 0.95))), f"y{k}"} for k, v in sets.items() if k % 4 == 0}
    sets |= near
    df = spark.createDataFrame([("g", k, sorted(v)) for k, v in sets.items()], "group string, place bigint, words array<string>").repartition(5)
    lists = {}
    for row in greedy.shared(greedy.signatures(df, threshold, "place"), "place").collect():
        lists.setdefault(row["key"], []).append(row["place"])
    met = {(a, b) for v in lists.values() for a in v for b in v if a < b}
    similar = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}
    assert similar and similar <= met
    assert threshold < 0.9 or len(met) < 0.05 * len(sets) ** 2 / 2  # by common words nearly all of them met


def test_clusters_keep_null_and_repeated_ids(spark):
    rows = [(None, "a b", "s", 1), (1, "a b", "s", 2), (1, "c d", "s", 3), (1, "c d", "s", 4), (2, None, None, 5), (3, "", None, 6)]
    got = jobs.cluster_observations(spark.createDataFrame(rows, "id bigint, raw_text string, related_symbol string, created_at bigint"))
    assert sorted((r["created_at"], r["leader"]) for r in got.collect() if r["leader"] is not None) == [(3, 1), (4, 1), (5, 2), (6, 3)]
    assert got.count() == 6


@pytest.mark.parametrize("how", [{}, {"group": 3}, {"sent": 5}])
def test_keywords(spark, how):
    texts = [(1, "she sells sea shells"), (1, "he"), (2, ""), (3, None), (4, "été 😀 sea"), (5, "sea shells " * 50)]
    words = ["she", "he", "hells", "sea", "été", "😀", "zzz", "", None, "sea", "sea sh"]
    found = keywords.containing(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([(w,) for w in words], "word string"), **how)
    want = sorted((i, w) for i, t in texts if t is not None for w in set(words) - {None} if w in t)
    assert sorted(tuple(r) for r in found.collect()) == want


def test_many_keywords_send_no_texts(spark):
    r = random.Random(4)
    text = lambda: "".join(r.choice("abcdefghijkl ") for _ in range(20_000))
    texts = spark.createDataFrame([(k, text()) for k in range(20)], "id int, text string")
    words = spark.createDataFrame([("".join(r.choice("abcdefghijkl") for _ in range(3)),) for _ in range(90)], "word string")
    store = spark.sparkContext._jsc.sc().statusStore()
    before = sum(x.shuffleWriteBytes() for x in _stages(store, spark))
    assert keywords.containing(texts, words, group=10).count() > 200
    assert sum(x.shuffleWriteBytes() for x in _stages(store, spark)) - before < 100_000


def test_like_many(spark):
    names = [(1, "PaymentGateway", "pay::PaymentGateway"), (2, "gate", None), (3, None, "x::GATE_way"), (4, "ab", "b"), (5, "", ""), (6, "été", "100%")]
    patterns = ["%gate%", "GATE", "%::%way", "a_", "%b%", "%", "_", "%tE%", "", "%pay%gate%", "%nothing%", "p_y%"]
    df = spark.createDataFrame(names, "id int, name string, qualified_name string")
    got = sorted(tuple(r) for r in keywords.like_many(df, spark.createDataFrame([(p,) for p in patterns], "pattern string"), "id", "name", "qualified_name").collect())
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE n(id int, name varchar, q varchar); CREATE TABLE p(pattern varchar)")
    con.executemany("INSERT INTO n VALUES (?, ?, ?)", names)
    con.executemany("INSERT INTO p VALUES (?)", [(p,) for p in patterns])
    want = con.execute("SELECT pattern, id FROM p JOIN n ON lower(name) LIKE lower(pattern) OR lower(q) LIKE lower(pattern)").fetchall()
    assert got == sorted(want)


def test_index_recall_and_round_trip(spark, tmp_path):
    r = np.random.default_rng(4)
    centres = r.normal(size=(12, 32))
    x = (centres[r.integers(12, size=3000)] + 0.5 * r.normal(size=(3000, 32))).astype(np.float32)
    rows = [(k, v) for k, v in enumerate(x.tolist())] + [(9000, None), (9001, [float("nan")] * 32), (9002, [None] * 32)]
    index = ivfpq.build(spark.createDataFrame(rows, "id bigint, embedding array<float>"))
    assert index.codes.count() == 3000 and len(index.centres) == 55
    index.write(f"{tmp_path}/index")
    index = ivfpq.IvfPq.read(spark, f"{tmp_path}/index")
    asked = spark.createDataFrame([(k, x[k].tolist()) for k in range(0, 3000, 50)], "query_id bigint, v array<float>")
    routed = ivfpq.routed(index, asked, 0.2).join(index.codes, "cell").count()
    assert routed <= 0.3 * 60 * 3000  # rows read, of those that a scan reads
    got = {}
    for row in ivfpq.search(index, asked, 10, probe=0.2).orderBy("query_id", "rank").collect():
        got.setdefault(row["query_id"], []).append((row["id"], row["distance"]))
    hits = 0
    for q, found in got.items():
        d = ((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1)
        hits += len(set(np.argsort(d, kind="stable")[:10].tolist()) & {i for i, _ in found})
        assert found[0] == (q, 0.0) and [d for _, d in found] == sorted(d for _, d in found)
    assert len(got) == 60 and hits / 600 >= 0.9
    with pytest.raises(vector.VectorError, match="dim_mismatch"):
        ivfpq.build(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id bigint, embedding array<float>"))


def test_decay_rules(spark):
    s = "kind string, importance double, since_day int, dead_day int, access_count int, resolved_day int"
    rows = [("entity", 0.1, 0, 95, 9, None), ("entity", 0.06, 0, 90, 9, None), ("entity", 0.12, 80, None, 9, None), ("decision", 0.31, 0, None, 0, None), ("observation", 0.2, 80, None, 2, None), ("observation", 0.2, 80, None, 3, None), ("issue", 0.5, 0, None, 0, 93), ("issue", 0.5, 0, None, 0, 92), ("issue", 0.5, 0, None, 0, None), ("other", 0.01, 0, None, 0, 1), (None, None, None, None, None, None)]
    got = [(r["kind"], None if r["importance"] is None else round(r["importance"], 6), r["flagged"]) for r in upkeep.compact(spark.createDataFrame(rows, s), F.col("kind"), F.lit(100)).collect()]
    want = [("entity", round(0.1 * 0.9**5, 6), False), ("entity", round(0.12 * 0.99**20, 6), True), ("decision", 0.3, False), ("observation", round(0.2 * 0.95**20, 6), False), ("issue", 0.5, False), ("issue", 0.5, False), ("other", 0.01, False), (None, None, False)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_import_twice_changes_nothing(spark):
    s = "id bigint, qualified_name string, file_path string, value string, authority string, confidence double"
    mine = spark.createDataFrame([(1, "a", "f", "v1", "kg", 0.5), (2, "b", "f", "v2", "kg", 0.5), (7, None, "f", "v3", "kg", 0.5), (8, "a", "f", "dup", "kg", 0.1)], s)
    theirs = spark.createDataFrame([(10, "a", "f", "w1", "lsp_ast", 0.1), (11, "b", "f", "w2", "kg", 0.9), (12, "c", "f", "w3", "text", 0.9), (13, None, "f", "w4", "text", 0.9), (14, "c", "f", "w5", "text", 0.9)], s)
    edges = spark.createDataFrame([(100, 1, 2, "calls")], "id bigint, source_id bigint, target_id bigint, kind string")
    new = spark.createDataFrame([(10, 11, "calls"), (12, 10, "calls"), (14, 10, "calls"), (99, 10, "calls")], "source_id bigint, target_id bigint, kind string")
    once, ids = upkeep.merge_entities(mine, theirs)
    first = sorted((tuple(r) for r in once.collect()), key=repr)
    assert {r[0]: r[3] for r in first} == {1: "w1", 2: "v2", 7: "v3", 8: "dup", 9: "w3"}
    assert {tuple(r) for r in ids.collect()} == {(10, 1), (11, 2), (12, 9), (13, 7), (14, 9)}
    linked = upkeep.merge_relations(edges, new, ids)
    assert sorted(tuple(r) for r in linked.collect()) == [(100, 1, 2, "calls"), (101, 9, 1, "calls")]
    again, ids = upkeep.merge_entities(once, theirs)
    assert sorted((tuple(r) for r in again.collect()), key=repr) == first
    assert sorted(tuple(r) for r in upkeep.merge_relations(linked, new, ids).collect()) == sorted(tuple(r) for r in linked.collect())


def test_propagation_stops_at_equal_values(spark):
    values = spark.createDataFrame([("i1", 1), ("i2", 5), ("i3", 3), ("a", 5), ("b", 3), ("top", 5)], "node string, value int")
    edges = spark.createDataFrame([("i1", "a", 1), ("i2", "a", 1), ("i3", "b", 1), ("a", "top", 2), ("b", "top", 2)], "source string, target string, level int")
    run = lambda c: sorted((r["node"], r["level"], r["old"], r["value"]) for r in upkeep.propagate(values, edges, spark.createDataFrame(c, "node string, value int"), F.max, 2).collect())
    assert run([("i1", 2)]) == [("a", 1, 5, 5), ("i1", 0, 1, 2)]  # nothing beyond a is recomputed
    assert run([("i1", 1)]) == []
    assert run([("i3", 9), ("i1", 2)]) == [("a", 1, 5, 5), ("b", 1, 3, 9), ("i1", 0, 1, 2), ("i3", 0, 3, 9), ("top", 2, 5, 9)]


def test_sketches_keep_their_rank_error(spark):
    r = np.random.default_rng(1)
    rows = [("t", datetime(2024, 1, 1) + timedelta(days=int(k % 40)), float(v), True) for k, v in enumerate(r.exponential(size=8000))]
    days = upkeep.daily_sketches(spark.createDataFrame(rows, "tool string, at timestamp, elapsed_ms double, hit boolean"))
    assert days.count() == 40
    got = upkeep.latency_over(days, F.lit("2024-01-01").cast("date"), F.lit("2024-01-20").cast("date")).first()
    exact = np.sort([v for _, at, v, _ in rows if at < datetime(2024, 1, 21)])
    assert got["calls"] == len(exact) and got["hit_rate"] == 1.0
    for q, name in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99")):
        assert abs(np.searchsorted(exact, got[name]) / len(exact) - q) < 0.015


def test_ignore_files(spark):
    rules = [("", 0, "*.log"), ("", 1, "!keep.log"), ("", 2, "build/"), ("", 3, "/top.txt"), ("", 4, "docs/**/x"), ("", 5, ""), ("", 6, "#c"), ("sub", 0, "!a.log"), ("sub", 1, "deep"), ("sub/deep", 0, "!in.rs"), ("", 7, "we?rd[1]")]
    paths = ["a.log", "keep.log", "sub/a.log", "sub/b.log", "build", "build/x", "src/build/keep.log", "top.txt", "sub/top.txt", "docs/x", "docs/a/b/x", "docs/a/xy", "sub/deep/in.rs", "sub/deeper", "we_rd[1]", "we_rd1"]
    got = upkeep.ignored_paths(spark.createDataFrame([(p,) for p in [*paths, "a.log"]], "path string"), spark.createDataFrame(rules, "folder string, pos int, pattern string"))
    assert sorted(r["path"] for r in got.collect()) == sorted(["a.log", "sub/b.log", "build/x", "src/build/keep.log", "top.txt", "docs/x", "docs/a/b/x", "sub/deep/in.rs", "we_rd[1]"])


def test_live_sessions_restart_and_expire(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    begin = datetime(2024, 1, 1)
    calls = [("a", 0, "f1"), ("a", 5, "f2"), ("b", 1, "f1"), ("a", 3, None)], [("a", 12, "f1"), ("b", 40, "f3"), ("c", 90, "f9")], [("a", 100, "f7"), ("c", 200, "f9")]
    src, out, last = f"{tmp_path}/in", f"{tmp_path}/cp", {}
    for number, rows in enumerate(calls):  # a run a batch, each from the checkpoint of the one before
        spark.createDataFrame([(s, begin + timedelta(minutes=m), f) for s, m, f in rows], "session_id string, at timestamp, file string").coalesce(1).write.parquet(f"{src}/n={number}")
        stream = spark.readStream.schema("session_id string, at timestamp, file string").parquet(f"{src}/*")
        seen = []
        q = jobs.live_sessions(stream, "30 minutes", "1 minute").writeStream.outputMode("update").option("checkpointLocation", out).foreachBatch(lambda b, _, seen=seen: seen.extend(b.collect()))
        q.trigger(availableNow=True).start().awaitTermination()
        for r in seen:
            last.setdefault((r["session_id"], r["created_at"]), []).append((r["calls"], r["files"], r["expired"]))
    at = lambda m: begin + timedelta(minutes=m)
    assert last["a", at(0)][-1] == (4, "f1,f2", True)  # 12 minutes in is the same session, 100 a new one
    assert last["a", at(100)][0] == (1, "f7", False)
    assert last["b", at(1)][0] == (1, "f1", False)


def test_promotion_marks_what_it_took(spark, tmp_path):
    hot = spark.createDataFrame([(k, f"p{k % 3}", "x") for k in range(20)], "id bigint, pattern_hash string, pattern string")
    run = lambda rows: jobs.promotion_loop(rows, f"{tmp_path}/out", lambda b: jobs.promote_conventions(b, 1), batch=8)
    assert run(hot) == 3 and run(hot) == 0
    warm = spark.read.parquet(f"{tmp_path}/out/warm")
    assert warm.agg(F.sum("n")).first()[0] == 20 and spark.read.parquet(f"{tmp_path}/out/marks").select("id").distinct().count() == 20
    assert run(hot.unionByName(spark.createDataFrame([(77, "new", "y")], hot.schema))) == 1


def test_promotion_of_unrelated_rows_with_common_words(spark):
    r = random.Random(5)
    words = [f"w{k}" for k in range(40)]
    rows = [(k, " ".join(r.sample(words, 20)), "s", k) for k in range(200)]
    rows += [(1000 + k, rows[k][1] + " " + rows[k][1][:2], "s", 1000 + k) for k in range(0, 200, 10)]  # a word more at most
    df = spark.createDataFrame(rows, "id bigint, raw_text string, related_symbol string, created_at bigint")
    led = serial([("s", i, t.split()) for i, t, _, _ in rows], 0.9)
    got = {x["leader"]: (x["n"], x["last_at"]) for x in jobs.promote_observations(jobs.cluster_observations(df)).collect()}
    assert got == {a: (list(led.values()).count(a), max(k for k, b in led.items() if b == a)) for a in set(led.values())}


def test_promotion_sends_texts_once(spark):
    """Beyond broadcast sizes: the same rows as the plain form, with less sent."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(40))
    texts = [" ".join(word() for _ in range(60)) for _ in range(150)]
    rows = [(k, texts[k % 150] + (" tail" if k % 7 == 0 else ""), "s", k) for k in range(200)] + [(3, texts[3], "s", 3), (3, texts[3], "t", 3), (None, "", None, 1), (900, None, "s", 2)]
    df = spark.createDataFrame(rows, "id bigint, raw_text string, related_symbol string, created_at bigint")
    store = spark.sparkContext._jsc.sc().statusStore()
    sent = lambda: sum(x.shuffleWriteBytes() for x in _stages(store, spark))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for some in (spark.createDataFrame(rows[:150], df.schema), df):
            at, out = [sent()], []
            for form in (lambda d: jobs.promote_observations(jobs.cluster_observations(d)), jobs.promoted_clusters):
                out.append(sorted((tuple(x) for x in form(some).collect()), key=repr))
                at.append(sent())
            assert out[0] == out[1]
            assert some is df or at[2] - at[1] < at[1] - at[0], at
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def _stages(store, spark):
    """All stages so far, as the status store has them."""
    it = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None).iterator()
    while it.hasNext():
        yield it.next()


def test_rank_rounds_send_no_table_to_the_driver(spark):
    n = 100_000
    nodes = spark.range(n).select(F.col("id").alias("node"), F.lit(1.0).alias("mass"))
    edges = spark.range(n).select(F.col("id").alias("source"), F.pmod(F.xxhash64("id"), F.lit(n)).alias("target"))
    store = spark.sparkContext._jsc.sc().statusStore()
    before = sum(x.resultSize() for x in _stages(store, spark))
    out = graph.personalized_page_rank(nodes, edges, rounds=2).agg(F.count("*"), F.sum("rank")).first()
    assert out[0] == n and abs(out[1] - 1) < 1e-6
    assert sum(x.resultSize() for x in _stages(store, spark)) - before < 1_000_000
