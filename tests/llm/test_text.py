"""WARC round trips and pseudonyms."""

import base64
import gzip
import hashlib
import io
import random
import re
from datetime import date

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cases import corpus, prose
from lodestrata.llm import pii, warc

PAGES = [
    (1, "http://a/x y\r\nEvil: 1", "<p>one</p>"), (2, "http://b", "<p>one</p>"), (0, "http://c", "<p>one</p>"), (3, None, None), (4, "http://d", ""), (5, "http://e", "é€😀\r\n\r\nWARC/1.1\r\n"),
    (None, "http://f", "<p>one</p>"), (None, "http://g", "only null"), (7, "http://h", "same"), (7, "http://h", "same"), (9, "http://i", prose(1, 50_000)),
]


def b32(s):
    return base64.b32encode(hashlib.sha1(s).digest()).decode()


@pytest.mark.parametrize("kw", [{}, {"shard_bytes": 600, "roll_bytes": 300}, {"min_revisit_bytes": 5}])
def test_warc(spark, kw):
    df = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").repartition(4)
    a = warc.archive(df, **kw)
    got = warc.read_archive(a).collect()
    assert len(got) == len(PAGES)
    firsts = {}
    for i, _, h in PAGES:
        firsts.setdefault(h or "", []).append(i)
    want = []
    for i, _, h in PAGES:
        raw = (h or "").encode()
        first = min((x for x in firsts[h or ""] if x is not None), default=None)
        revisit = i != first and len(raw) >= kw.get("min_revisit_bytes", 0)
        want.append((str(i), len(raw), b32(raw), "revisit" if revisit else "response", str(first if revisit else None), None if revisit else raw))
    assert sorted(map(str, [(str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"]), None if r["payload"] is None else bytes(r["payload"])) for r in got])) == sorted(map(str, want))
    files = a.manifest.collect()
    if "roll_bytes" in kw:
        assert len(files) > 4
    for f in files:  # the manifest says what the files hold
        path = a.folder.removeprefix("file://") + "/" + f["file"]
        raw = open(path, "rb").read()
        assert len(raw) == f["bytes"] and hashlib.sha256(raw).hexdigest() == f["sha256"]
        heads = [h for h, _ in warc.records(io.BytesIO(raw))]
        assert len(heads) == f["records"] and all("Evil" not in h for h in heads)
        assert gzip.decompress(raw).startswith(b"WARC/1.1\r\n")


def test_archives_are_the_same_however_the_table_is_partitioned(spark):
    df = spark.createDataFrame([(k, f"http://h/{k}", prose(k % 7, 60)) for k in range(60)], "page_id bigint, url string, html string")
    one, two = (warc.archive(x, shard_bytes=3_000, roll_bytes=2_000).manifest.orderBy("file").collect() for x in (df.repartition(1), df.repartition(7, "html")))
    assert one == two and len(one) > 5


def test_empty_archive(spark):
    a = warc.archive(spark.createDataFrame([], "page_id bigint, url string, html string"))
    assert a.manifest.count() == 0 and warc.read_archive(a).count() == 0


def test_shard_bounds_split_heavy_ranges(spark):
    rows = [(k, 10) for k in range(0, 1000)] + [(10**15 + k, 10) for k in range(5)]
    b = warc.shard_bounds(spark.createDataFrame(rows, "key bigint, bytes bigint"), 500)
    sizes = np.bincount(np.searchsorted(b, [k for k, _ in rows], side="right")) * 10
    assert sizes.max() <= 1000 and len(sizes) >= 20


P = pii.Permuter(b"key")


def test_permutations_are_permutations():
    for n in (2, 3, 10, 97, 256, 1000):
        assert sorted(P.permute(k, n, "t") for k in range(n)) == list(range(n))
    assert P.permute(5, 1000, "a") != P.permute(5, 1000, "b") or P.permute(6, 1000, "a") != P.permute(6, 1000, "b")
    assert pii.Permuter(b"other").permute(5, 10**9, "t") != P.permute(5, 10**9, "t")


def swap(text):
    return pii.pseudonymise(text, P)[0]


def test_formats_and_validity_survive():
    r = random.Random(2)
    seen = {}
    for _ in range(200):
        body = str(r.randrange(10**14, 10**15))
        card = body + str(pii.luhn(body))
        new = swap(card)
        assert new != card and len(new) == len(card) and pii.luhn(new[:-1]) == int(new[-1]) and new[0] == card[0]
        assert seen.setdefault(new, card) == card
        spaced = " ".join(card[k : k + 4] for k in range(0, 16, 4))
        assert swap(spaced).replace(" ", "") == new  # the same value in another format
    assert swap("4111111111111112") == "4111111111111112"  # no check digit
    for text in ("2024-02-29", "29/02/2024", "02/29/2024", "1.3.1999"):
        new = swap(text)
        assert new != text and re.sub(r"\d+", "9", new) == re.sub(r"\d+", "9", text)
    y, m, d = map(int, swap("2024-02-29").split("-"))
    date(y, m, d)
    assert swap("2023-02-29") == "2023-02-29" and swap("300.1.1.1") == "300.1.1.1"
    iban = swap("DE89 3704 0044 0532 0130 00")
    plain = iban.replace(" ", "")
    assert iban[:2] == "DE" and pii._mod97(plain[4:] + plain[:4]) == 1 and [len(x) for x in iban.split(" ")] == [4, 4, 4, 4, 4, 2]
    assert re.fullmatch(r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}", swap("+1 (706) 555-3138")) and swap("(706) 555-3138")[1:4] == swap("+1 (706) 555-3138")[4:7]
    assert re.fullmatch(r"[a-z]{4}\.\d\d@mail2\.example\.com", swap("that.92@mail2.example.com"))
    assert re.fullmatch(r"[0-9a-f]{40}", swap("24be64439e3e49cf46b2d7c90f3602a3d0b907ff"))
    assert pii._ssn_valid(int(swap("123-45-6789").replace("-", ""))) and swap("000-12-3456") == "000-12-3456"


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab1@.- +()/0123456789é\n", max_size=60))
def test_any_text_passes(text):
    new, counts = pii.pseudonymise(text, P)
    assert len(new) == len(text) and [c.isdigit() for c in new] == [c.isdigit() for c in text]
    assert pii.pseudonymise(text, P) == (new, counts)


def test_pseudonymised_table(spark, docs, empty):
    odd = docs.withColumn("n_email", F.lit("mine"))
    got = pii.pseudonymise_documents(odd, "k")
    assert got.count() == len(corpus()) and got.columns.count("n_email") == 1
    assert got.where("text IS NULL AND n_values = 0").count() == 2
    rows = spark.createDataFrame([(1, "call +1 (706) 555-3138"), (2, "+1 (706) 555-3138 again"), (3, None)], "doc_id bigint, text string")
    a, b, c = pii.pseudonymise_documents(rows, "k").orderBy("doc_id").collect()
    assert a["text"][5:] == b["text"][:17] != "+1 (706) 555-3138" and a["n_phone"] == 1 and c["text"] is None
    assert pii.pseudonymise_documents(empty, "k").count() == 0


def test_warc_records_of_hot_keys_and_repeats(spark):
    from pyspark.sql import functions as F

    rows = [(None, "u", "x" * 300)] * 40 + [(7, f"v{k % 5}", "y" * 200) for k in range(40)] + [(k, "w", f"{k}" * 50) for k in range(20)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3).withColumn("number", F.lit("mine")).withColumn("SHA", F.lit(1))
    a = warc.archive(df, shard_bytes=3_000, roll_bytes=700)
    files = a.manifest.collect()
    assert sum(f["records"] for f in files) == len(rows) and max(f["seq"] for f in files) > 0
    assert len({f["shard"] for f in files}) > 8
    heads = []
    for f in files:
        fs, root = warc._filesystem(a.folder)
        with fs.open_input_stream(f"{root}/{f['file']}", compression=None) as stream:
            heads += [h for h, _ in warc.records(stream)]
    assert len({h["WARC-Record-ID"] for h in heads}) == len(rows)
    ids = {h["WARC-Record-ID"]: h["WARC-Type"] for h in heads}
    assert all(ids[h["WARC-Refers-To"]] == "response" for h in heads if h["WARC-Type"] == "revisit")
    got = warc.read_archive(a).groupBy("page_id", "record_type").count().collect()
    assert {(r["page_id"], r["record_type"]): r["count"] for r in got if r["page_id"] in (None, 7)} == {(None, "response"): 40, (7, "response"): 41}


def test_pseudonyms_beside_clashing_columns(spark):
    df = spark.createDataFrame([(1, "mail a.b@example.com", "mine", 3)], "doc_id int, text string, N_EMAIL string, n_Values int")
    got = pii.pseudonymise_documents(df, "key")
    assert [c.lower() for c in got.columns].count("n_email") == 1 and got.columns[:2] == ["doc_id", "text"]
    assert got.first()["n_email"] == 1
