"""Hand-computed cases: every tie-break, null and quirk that the tables don't hold."""

import random
from collections import deque
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.functions import paths, reasons, text
from lodestrata.operators import context, fusion, graph, lookup, merge, snapshots, vector
from lodestrata.streaming import jobs
from oracle import assert_same

HITS = "source string, rank int, file_path string, start_line int, end_line int, snippet string"


def rows(df):
    return [tuple(r) for r in df.collect()]


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_rrf_closed_form_and_order(spark):
    h = spark.createDataFrame([("probe", 1, "a/z", 1, 2, "p"), ("ripgrep", 1, "a/z", 1, 2, "r"), ("codedb", 1, "a-b/c", 1, 2, "x"), ("zoekt", 1, "a/c", 1, 2, "y")], HITS)
    got = fusion.fuse_rrf(h).orderBy(*fusion.fused_order()).collect()
    assert [r["file_path"] for r in got] == ["a/z", "a/c", "a-b/c"]
    assert got[0]["fused_score"] == pytest.approx(2 / 61 + 1.5 / 61, abs=1e-12)
    assert got[0]["contributing"] == ["probe", "ripgrep"] and got[0]["snippet"] == "p"


def test_rrf_does_not_depend_on_input_order(spark):
    base = [(s, k % 7 + 1, f"f{k % 3}", k % 2, 5, f"s{k}") for k, s in enumerate(["probe", "ripgrep", "lancedb", "zoekt"] * 6)]
    base = list({(b[0], b[1], b[2], b[3]): b for b in base}.values())
    results = []
    for seed in range(3):
        random.Random(seed).shuffle(base)
        results.append(sorted(rows(fusion.fuse_rrf(spark.createDataFrame(base, HITS).repartition(3)))))
    assert results[0] == results[1] == results[2]


def test_cross_group_drops_unavailable_and_weightless(spark):
    h = spark.createDataFrame([("G1", "available", 1, "f", 1, 1, "a"), ("G2", "errored", 1, "f", 1, 1, "b"), ("G6", "available", 1, "g", 1, 1, "c")], "grp string, status string, rank int, file_path string, start_line int, end_line int, snippet string")
    got = fusion.fuse_cross_group(h, "find_definition").collect()
    assert [(r["file_path"], r["contributing"]) for r in got] == [("f", ["G1"])]


def test_conflicts(spark):
    c = [("one", 0, "v", "text", 0.1), ("tie", 0, "a", "kg", 0.5), ("tie", 1, "b", "kg", 0.9), ("win", 0, "x", "text", 0.9), ("win", 1, "y", "scip", 0.2), ("win", 2, "y", "scip", 0.2), ("null", 0, None, "kg", 0.3), ("null", 1, "q", "kg", 0.1)]
    got = {r["key"]: r for r in fusion.resolve_conflicts(spark.createDataFrame(c, "key string, pos int, value string, authority string, confidence double")).collect()}
    assert got["one"]["value"] == "v" and got["win"]["value"] == "y" and got["win"]["authority"] == "scip"
    assert not got["tie"]["resolved"] and got["tie"]["reason"] == "tied at tier kg" and got["tie"]["candidates"] == 2
    assert not got["null"]["resolved"]


def test_facts_take_two_stages(spark):
    f = [("a", "e", "x", 0.9, 1), ("b", "e", "x", 0.1, 9), ("c", "e", "y", 0.2, 5)]
    r = merge.merge_facts(spark.createDataFrame(f, "source_id string, entity string, fact string, confidence double, observed bigint")).first()
    assert (r["fact"], r["conflict_count"], r["agreement_count"]) == ("y", 1, 1)  # x enters with its best, which is older


def test_issue_order_puts_missing_lines_last(spark):
    i = [("t", "f", None, "lint", "high", "m", None, None, 0), ("t", "f", 3, "lint", "high", "m", "R", None, 1), ("u", "f", 3, "lint", "critical", "n", None, "fx", 2)]
    got = merge.merge_issues(spark.createDataFrame(i, "source_tool string, file_path string, line_start int, category string, severity string, message string, rule_id string, fix string, pos int")).orderBy(*merge.issue_order()).collect()
    assert [r["line_start"] for r in got] == [3, None] and got[0]["message"] == "n" and got[0]["tools"] == "t,u" and got[0]["severity"] == "critical"


def test_like_folds_ascii_only(spark):
    e = spark.createDataFrame([(1, "ABC"), (2, "É"), (3, "a\\b"), (4, "a_b")], "id int, name string")
    ask = lambda q: {r["id"] for r in e.where(text.like_ascii(F.col("name"), q)).collect()}
    assert ask("%abc%") == {1} and ask("%é%") == set() and ask("%a\\b%") == {3} and ask("a_b") == {3, 4}


def test_upsert_keeps_content_and_appends_null_keys(spark):
    s = "id bigint, qualified_name string, file_path string, t_valid_from bigint, signature string, t_last_verified bigint, access_count bigint"
    old = spark.createDataFrame([(1, "q", "f", 0, "old", 0, 4), (2, "r", None, 0, "n", 0, 0)], s)
    new = spark.createDataFrame([(8, "q", "f", 0, "new", 0, 0), (9, "r", None, 0, "n", 0, 0)], s)
    got = {r["id"]: r for r in snapshots.upsert_entities(old, new, F.lit(7).cast("bigint")).collect()}
    assert set(got) == {1, 2, 9}
    assert (got[1]["signature"], got[1]["t_last_verified"], got[1]["access_count"]) == ("old", 7, 5)
    fresh = {r["id"]: r for r in snapshots.upsert_entities(old, new, F.lit(7).cast("bigint"), refresh=True).collect()}
    assert fresh[1]["signature"] == "new"


def test_diagnostics_touch_reopen_resolve(spark):
    s = "id bigint, file_path string, line_start int, category string, severity string, message string, first_seen int, last_seen int, resolved boolean"
    old = spark.createDataFrame([(1, "f", None, "c", "s", "m", 1, 1, True), (2, "f", 2, "c", "s", "gone", 1, 1, False), (3, "g", 2, "c", "s", "m", 1, 1, False), (4, "h", 1, "c", "s", "m", 1, 1, False)], s)
    rep = spark.createDataFrame([("f", None, "c", "s", "m"), ("f", 5, "c", "s", "new")], "file_path string, line_start int, category string, severity string, message string")
    files = spark.createDataFrame([("f",), ("g",)], "file_path string")
    out = snapshots.merge_diagnostics(old, rep, files, 9)
    got = {(r["file_path"], r["line_start"], r["message"]): (r["first_seen"], r["last_seen"], r["resolved"]) for r in out.collect()}
    assert got == {("f", None, "m"): (1, 9, False), ("f", 2, "gone"): (1, 1, True), ("f", 5, "new"): (9, 9, False), ("g", 2, "m"): (1, 1, True), ("h", 1, "m"): (1, 1, False)}
    again = snapshots.merge_diagnostics(out, rep, files, 9)
    assert sorted(map(str, again.collect())) == sorted(map(str, out.collect()))


def test_versions_commit_fork_and_refuse(spark, tmp_path):
    t = snapshots.VersionedTable(spark, f"file://{tmp_path}/t")
    assert t.read("x int").count() == 0
    t.commit(spark.createDataFrame([(1,)], "x int"))
    t.commit(t.read().unionByName(spark.createDataFrame([(2,)], "x int")))
    assert sorted(r["x"] for r in t.read().collect()) == [1, 2]
    assert t.fork(f"file://{tmp_path}/u").read().count() == 2
    t.archive("t-1")
    assert t.versions() == []
    with pytest.raises(ValueError):
        snapshots.check_version(10, 9)


def test_as_of_join_bounds(spark):
    h = spark.createDataFrame([(1, "k", 0, 5), (2, "k", 5, 8), (3, "k", None, None)], "id bigint, key string, t_valid_from int, t_valid_to int")
    p = spark.createDataFrame([("k", 4), ("k", 5), ("k", 8), ("k", -1), ("z", 1)], "key string, at int")
    got = {(r["key"], r["at"]): r["id"] for r in lookup.as_of_join(p, h, "key").collect()}
    assert got == {("k", 4): 1, ("k", 5): 2, ("k", 8): None, ("k", -1): None, ("z", 1): None}


def test_search_merge_respects_the_cap(spark):
    s = spark.createDataFrame([("f", 1, "s1", 0), ("f", 2, "s2", 1)], "file string, line int, preview string, pos int")
    x = spark.createDataFrame([("f", 1, "t1", 0), ("g", 1, "t2", 1), ("f", 2, "t3", 2)], "file string, line int, preview string, pos int")
    got = {(r["file"], r["line"]): (r["source"], r["preview"]) for r in lookup.merge_search(s, x, 3).collect()}
    assert got == {("f", 1): ("both", "t1"), ("f", 2): ("symbol", "s2"), ("g", 1): ("text", "t2")}  # the last text hit comes after the cap


def test_symbols_resolve_by_any_tail(spark):
    e = spark.createDataFrame([(1, "f", "m::C::f", 1), (2, "f", "n::f", 2), (3, "É", "n::É", 1), (4, "g", None, None), (5, "g", None, None)], "id bigint, name string, qualified_name string, t_ingested_at int")
    ask = spark.createDataFrame([("c::F",), ("f",), ("n::f",), ("é",), ("g",), ("%",)], "symbol string")
    got = {r["symbol"]: (r["id"], r["parent_module"]) for r in lookup.resolve_symbols(e, ask).collect()}
    assert got == {"c::F": (1, "m::C"), "f": (2, "n"), "n::f": (2, "n"), "g": (5, None)}
    for symbol, (key, _) in got.items():
        assert lookup.resolve_symbol(e, symbol).first()["id"] == key


def _queue_bfs(edges, seeds, depth):
    adj = {}
    for s, t, k, w, pos in sorted(edges, key=lambda e: (e[0], e[1], e[4])):
        if s != t:
            adj.setdefault(s, []).append((t, w, (s, t, pos)))
            adj.setdefault(t, []).append((s, w, (s, t, pos)))
    out, q = {}, deque()
    for s in seeds:
        if s not in out:
            out[s] = (0, 1.0)
            q.append(s)
    while q:
        n = q.popleft()
        if out[n][0] == depth:
            continue
        for m, w, _ in sorted(adj.get(n, []), key=lambda x: x[2]):
            if m not in out:
                out[m] = (out[n][0] + 1, out[n][1] * w)
                q.append(m)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_blast_radius_is_queue_order(spark, seed):
    r = random.Random(seed)
    edges = [(f"n{r.randrange(12)}", f"n{r.randrange(12)}", "calls", r.choice([0.5, 0.25, 0.9]), k) for k in range(18)]
    e = spark.createDataFrame(edges, "source string, target string, edge_kind string, coupling double, pos int")
    s = spark.createDataFrame([("n3", 0), ("n1", 1), ("lonely", 2), ("n3", 3)], "node string, pos int")
    got = {x["node"]: (x["depth"], round(x["weight"], 9)) for x in graph.blast_radius(e, s, 3).collect()}
    want = {n: (d, round(w, 9)) for n, (d, w) in _queue_bfs(edges, ["n3", "n1", "lonely"], 3).items()}
    assert got == want


def test_page_rank_with_dangling_and_parallel_edges(spark):
    nodes, edges = ["a", "b", "c", "d"], [("a", "b"), ("a", "b"), ("a", "c"), ("b", "c"), ("c", "c"), ("x", "a")]
    n, p = 4, {"a": 50 / 53, "b": 1 / 53, "c": 1 / 53, "d": 1 / 53}
    rank, out = dict.fromkeys(nodes, 1 / n), {"a": ["b", "b", "c"], "b": ["c"]}
    for _ in range(100):
        lost = sum(rank[x] for x in nodes if x not in out)
        new = {x: 0.15 * p[x] + 0.85 * lost / n + 0.85 * sum(rank[u] / len(v) * v.count(x) for u, v in out.items()) for x in nodes}
        moved, rank = sum(abs(new[x] - rank[x]) for x in nodes), new
        if moved < 1e-6:
            break
    df = graph.personalized_page_rank(spark.createDataFrame([(x, 50.0 if x == "a" else 1.0) for x in nodes], "node string, mass double"), spark.createDataFrame(edges, "source string, target string"))
    got = {r["node"]: r["rank"] for r in df.collect()}
    assert got == pytest.approx(rank, abs=1e-7)


def test_budget_stops_at_the_first_overshoot(spark):
    df = spark.createDataFrame([(1, 5), (2, 9), (3, 1)], "id int, tokens int")
    assert [r["id"] for r in graph.fit_to_budget(df, "tokens", [F.asc("id")], 10).collect()] == [1]


def test_bytes_are_cut_between_characters(spark):
    for s in ("é" * 9, "a€b€", "x😀y😀", "plain ascii", "", "ß"):
        for cap in range(1, 14):
            raw = s.encode()[:cap]
            assert one(spark, text.cut_bytes(F.lit(s), cap)) == raw.decode(errors="ignore")


def test_lines_and_signatures(spark):
    assert one(spark, text.slice_lines(F.lit("a\nb\nc\n"), F.lit(2), F.lit(9))) == "b\nc"
    assert one(spark, text.slice_lines(F.lit("a\nb"), F.lit(0), F.lit(1))) is None
    assert one(spark, text.slice_lines(F.lit("a\nb"), F.lit(3), F.lit(4))) is None
    assert one(spark, text.signature(F.lit("  fn a(\n  x: u8\n) -> u8 {\n}"))) == "fn a( x: u8 ) -> u8"
    assert one(spark, text.first_lines(F.lit(" \n\n"))) == " \n\n"
    assert one(spark, text.signature_chunk(F.lit("fn a()"), F.lit("Does.\nMore.\n\nRest."))) == "fn a()\n\nDoes.\nMore."


def test_unicode_spaces_part_words(spark):
    assert one(spark, text.words(F.lit("a b  c"))) == ["a", "b", "c"]
    assert one(spark, text.jaccard(F.lit(""), F.lit(" "))) == 0.0


def test_smart_case(spark):
    assert one(spark, text.smart_case(F.lit("ABC"), "abc")) and not one(spark, text.smart_case(F.lit("abc"), "Abc"))
    assert one(spark, text.smart_case(F.lit("xB"), r"\Sb"))  # an escaped class is no upper-case letter
    assert not one(spark, text.smart_case(F.lit("x\x00abc"), "abc"))


def test_reasons(spark):
    r = F.lit("I DON'T know tokio internals!! unsure about: x; unfamiliar with sql")
    assert one(spark, reasons.gaps(r)) == ["tokio internals", "sql"]
    assert one(spark, reasons.domains(F.lit("Rust, sql (rust) git."))) == ["rust", "sql", "git"]
    assert one(spark, reasons.intent(F.lit("open a pr"))) == "review" and one(spark, reasons.intent(F.lit("print"))) == "understand"
    assert one(spark, reasons.action(F.lit("my address"))) == "edit"
    assert one(spark, reasons.query_type(F.lit("remember"), F.lit("lint"))) == "remember" and one(spark, reasons.query_type(F.lit(None).cast("string"), F.lit(None).cast("string"))) == "understand_code"


def test_paths(spark):
    p = spark.createDataFrame([("a-b/c",), ("a/z",)], "p string")
    assert [r["p"] for r in p.orderBy(paths.component_order("p")).collect()] == ["a/z", "a-b/c"]
    assert one(spark, paths.normalise(F.lit("a//b/./c/"))) == "a/b/c"
    assert one(spark, paths.extension(F.lit("x/.bashrc"))) is None and one(spark, paths.extension(F.lit("X.PY"))) == "py"
    assert one(spark, paths.language(F.lit("a.pyi"), paths.INGEST_LANGUAGES)) is None


def test_codes(spark):
    assert one(spark, F.struct(*text.decode_range(F.array(F.lit(-3), F.lit(0), F.lit(4), F.lit(1))))) == (1, 5)
    assert one(spark, F.struct(*text.decode_range(F.array(F.lit(7))))) == (0, 0)
    assert one(spark, text.role_names(F.lit(9))) == "definition,read_access"
    assert one(spark, text.expires_at(F.lit((1 << 63) - 1), F.lit(5))) == (1 << 63) - 1


def test_feedback(spark):
    b = [("s", 1, "pitfall", None, None, None, "Lock"), ("s", 2, "quality_issue", "f", 1, 3, None), ("s", 3, "test", "t", None, None, None), ("s", 4, "convention", None, None, None, None), ("z", 5, "test", "t", None, None, None)]
    got = context.analyze_feedback(
        spark.createDataFrame(b, "session_id string, bonus_id int, bonus_type string, file_path string, line_lo int, line_hi int, keyword string"),
        spark.createDataFrame([("s", "a deadLOCK", ["x"])], "session_id string, reason string, files array<string>"),
        spark.createDataFrame([("s", "f", 3, 9, "body"), ("s", "t", 1, 1, "")], "session_id string, file_path string, lo int, hi int, content string"),
    )
    assert {r["bonus_id"]: (r["signal"], r["delta"]) for r in got.collect()} == {1: ("used", 0.1), 2: ("fixed", 0.1), 3: ("used", 0.05), 4: ("ignored", -0.01), 5: ("ignored", -0.01)}


def test_vectors(spark):
    c = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "id bigint, embedding array<float>")
    got = vector.find_similar(c, [0.0, 1.0], 2).collect()
    assert [(r["id"], r["distance"], r["similarity"]) for r in got] == [(1, 0.0, 1.0), (3, 0.0, 1.0)]
    with pytest.raises(vector.VectorError):
        vector.find_similar(c, [1.0], 2)
    with pytest.raises(vector.VectorError):
        vector.check_dimension(8)
    q = spark.createDataFrame([(7, [1.0, 0.1])], "query_id bigint, v array<float>")
    assert [r["id"] for r in vector.knn_join(q, c, 2, shard_bytes=16).orderBy("rank").collect()] == [2, 1]


def _leaders(items, t):
    out, leaders = {}, []
    for i, s, words in items:
        w = set(words.split())
        for li, ls, lw in leaders:
            if ls == s and w | lw and len(w & lw) / len(w | lw) >= t:
                out[i] = li
                break
        else:
            leaders.append((i, s, w))
            out[i] = i
    return out


def test_clusters_follow_order(spark):
    r = random.Random(5)
    vocabulary = [f"w{k}" for k in range(14)]
    items = [(k, r.choice(["x", "y", None]), " ".join(r.sample(vocabulary, r.choice([0, 3, 10, 11])))) for k in range(200)]
    df = spark.createDataFrame([(i, t, s, i) for i, s, t in items], "id bigint, raw_text string, related_symbol string, created_at bigint").repartition(5)
    for threshold in (0.9, 0.7):
        got = {r["id"]: r["leader"] for r in jobs.cluster_observations(df, threshold).collect()}
        assert got == _leaders(items, threshold)
    tie = spark.createDataFrame([(1, "ab", None, 3, 1), (2, "é", None, 4, 1)], "id bigint, raw_text string, related_symbol string, created_at bigint, leader bigint")
    assert jobs.promote_observations(tie).first()["summary"] == "é"


def test_promotion_streams_once(spark, tmp_path):
    src = f"{tmp_path}/in"
    spark.createDataFrame([(k, f"p{k % 2}", "x") for k in range(5)], "id bigint, pattern_hash string, pattern string").write.parquet(src)
    stream = spark.readStream.schema("id bigint, pattern_hash string, pattern string").parquet(src)
    for _ in range(2):
        jobs.promotion(stream, jobs.promote_conventions, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert [(r["pattern_hash"], r["n"]) for r in got] == [("p0", 3)]


def test_debounce_streams(spark, tmp_path):
    src = f"{tmp_path}/in"
    rows_ = [("a", "created", datetime(2024, 1, 1, 0, 0, 0)), ("a", "modified", datetime(2024, 1, 1, 0, 0, 0, 50_000)), ("a", "removed", datetime(2024, 1, 1, 0, 0, 5))]
    spark.createDataFrame(rows_, "path string, kind string, at timestamp").write.parquet(src)
    assert sorted((r["kind"], r["n"]) for r in jobs.debounce(spark.read.parquet(src)).collect()) == [("modified", 2), ("removed", 1)]
    stream = jobs.debounce(spark.readStream.schema("path string, kind string, at timestamp").parquet(src), late="1 second")
    stream.writeStream.format("memory").queryName("debounced").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert spark.sql("select kind, n from debounced").collect() == [("modified", 2)]


def test_lifecycle(spark):
    log = [("p", 1, "register"), ("p", 2, "load"), ("p", 3, "wake"), ("p", 4, "activate"), ("p", 5, "idle")]
    r = jobs.fold_lifecycle(spark.createDataFrame(log, "plugin string, at int, event string")).first()
    assert (r["state"], r["illegal"], r["events"]) == ("idle", 1, 5)


def test_early_cutoff(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "key int, value string")
    new = spark.createDataFrame([(1, "a"), (2, "c"), (3, None), (4, "d")], "key int, value string")
    assert sorted(rows(vector.early_cutoff(old, new))) == [(2, "changed"), (4, "added")]


@pytest.mark.parametrize(
    "events,state,illegal",
    [
        ("register stop", "stopped", 0),
        ("register fail", "error", 0),
        ("fail stop", "error", 1),
        ("register load activate idle call", "loading", 0),
        ("register load activate idle load activate", "active", 0),
        ("stop stop register", "stopped", 1),
        ("register call idle register", "registered", 1),
        ("activate", "discovered", 1),
    ],
)
def test_lifecycle_rules(spark, events, state, illegal):
    log = [("p", k, e) for k, e in enumerate(events.split())]
    r = jobs.fold_lifecycle(spark.createDataFrame(log, "plugin string, at int, event string")).first()
    assert (r["state"], r["illegal"]) == (state, illegal)


def test_reaping_includes_the_end_of_the_grace_period(spark):
    df = spark.createDataFrame([(10,), (11,)], "at int").select("at", jobs.reapable(F.col("at"), F.lit(70), 60).alias("gone"))
    assert [r["gone"] for r in df.orderBy("at").collect()] == [True, False]


def test_two_writers_of_one_version(spark, tmp_path):
    a, b = (snapshots.VersionedTable(spark, f"file://{tmp_path}/t") for _ in range(2))
    a.commit(spark.range(1))
    seen = b.versions()
    b.versions = lambda: seen
    a.commit(spark.range(2))
    with pytest.raises(FileExistsError):
        b.commit(spark.range(3))
    assert a.read().count() == 2 and len(a.versions()) == 2


def test_knn_join_with_ties_in_bulk(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(3000, 40)), 1)
    x[1000:2200] = x[0]  # more equal rows than are asked for
    rows = [(k, [float(a) for a in v]) for k, v in enumerate(x)]
    c = spark.createDataFrame([*rows, (5000, None), (5001, [float("nan")] * 40)], "id bigint, embedding array<double>")
    q = c.where("id % 50 = 0").selectExpr("id AS query_id", "embedding AS v")
    got = {(r["query_id"], r["rank"]): (r["id"], r["distance"]) for r in vector.knn_join(q, c, 7, shard_bytes=100_000, at_once=11).collect()}
    want = {}
    for k in range(0, 3000, 50):
        d = ((x - x[k]) ** 2).sum(axis=1)
        for n, i in enumerate(np.lexsort((np.arange(3000), d))[:7]):
            want[k, n + 1] = (i, d[i])
    assert {k: i for k, (i, _) in got.items()} == {k: i for k, (i, _) in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 1e-9 for k in want)
    assert vector.knn_join(q.limit(0), c, 2).count() == 0 and vector.knn_join(q, c.limit(0), 2).count() == 0
    short = spark.createDataFrame([(1, [1.0])], "query_id bigint, v array<double>")
    with pytest.raises(vector.VectorError):
        vector.knn_join(short, c, 2)


def test_drop_overlaps_is_greedy(spark):
    cols = "file_path string, start_line int, end_line int, rank int, note string"
    # b goes for a; c overlaps b enough but a too little, and b is gone, so c stays
    rows = [("f", 1, 20, 1, "a"), ("f", 4, 23, 2, "b"), ("f", 7, 26, 3, "c"), ("f", 1, 20, 4, "again"), ("g", 4, 23, 9, "d"), (None, 1, 20, 5, "e"), ("f", 1, 20, None, "f"), ("f", 9, 2, 1, "g")]
    got = context.drop_overlaps(spark.createDataFrame(rows, cols))
    assert sorted(r["note"] for r in got.collect()) == ["a", "c", "d", "e", "f", "g"]
    rng = np.random.default_rng(2)
    many = [("h", int(s), int(s + n), k, "") for k, (s, n) in enumerate(zip(rng.integers(-50, 300, 900), rng.integers(0, 60, 900), strict=True))]
    kept = []
    for r in many:
        if all((min(r[2], o[2]) - max(r[1], o[1]) + 1) / (max(r[2], o[2]) - min(r[1], o[1]) + 1) <= 0.7 for o in kept):
            kept.append(r)
    assert sorted(r["rank"] for r in context.drop_overlaps(spark.createDataFrame(many, cols)).collect()) == [r[3] for r in kept]


def test_utc_text_beyond_four_digits(spark):
    seconds = [0, 86399, 253402300799, 253402300800, 518400000000]
    got = spark.createDataFrame([(k,) for k in seconds], "s bigint").select("s", text.utc_text(F.col("s")).alias("at")).collect()
    import duckdb

    want = duckdb.connect().execute("SELECT s, strftime(make_timestamp(s * 1000000), '%Y-%m-%d %H:%M:%S') FROM (SELECT unnest(?) AS s)", [seconds]).fetchall()
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_equal_places_of_text_hits(spark, tmp_path):
    import duckdb

    from lodestrata.plans import registry

    con = duckdb.connect()
    con.execute("SET threads = 1")
    # ids 100,003 apart have equal places in the query's order
    con.execute(f"COPY (SELECT (k % 4) * 100003 + k // 4 AS p_partkey, 'n' || k AS p_name, 'B' AS p_brand, 'T' AS p_type, CAST(8 + k // 40 AS INT) AS p_size, 1.0::DOUBLE AS p_retailprice FROM range(400) t(k) ORDER BY 1) TO '{tmp_path}/part.parquet'")
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    assert assert_same(registry.queries()["J08_merge_search"](spark, str(tmp_path)), con, registry.oracle_sql()["J08_merge_search"]) > 0
