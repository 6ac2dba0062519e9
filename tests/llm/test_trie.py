"""The prefix trie against a plain one built over whole tuples of turns."""

import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lodestrata.llm import prefixtrie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def plain(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
            convs.setdefault(c, []).append((turn is not None, turn or 0, tie, (role, text)))
    own = {c: [t[3] for t in sorted(v)] for c, v in convs.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    out = []
    for path, cs in members.items():
        kids = [p for p in members if len(p) == len(path) + 1 and p[: len(path)] == path]
        below = [p for p in members if p[: len(path)] == path]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in members)]
        saved = sum((len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p in below if p)
        ends = ",".join(str(c) for c in sorted(cs) if rebuilt[c] == path)
        out.append((min(cs), len(path), min(members[path[:-1]]) if path else None, len(cs), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(spark, rows, **how):
    df = prefixtrie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(3), **how)
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def odd():
    """Nulls in every column, ties, repeated rows, empty and long texts, a long chain, and a third of all conversations alike."""
    rows = [(None, 0, "user", "lost"), (0, None, "user", "first of all"), (0, 1, None, "x y"), (0, 2, "user", None), (0, 3, "user", ""), (1, 0, "user", "a b"), (1, 0, "user", "a b"), (1, 0, "user", "a c"), (2, 5, None, None)]
    rows += [(40, k, "user", f"t{k}") for k in range(60)] + [(45, k, "user", f"t{k}") for k in range(60)] + [(100, 0, "user", "word " * 5000)]
    for c in range(60, 90):
        rows += [(c, k, "user", f"same {k}") for k in range(5)]
    for c in range(200, 260):
        rows += [(c, k, ("user", "bot")[k % 2], f"q{(c * 7 + k * k) % (2 + k)} w") for k in range(c % 6 + 1)]
    return rows


@pytest.mark.parametrize("limit", [prefixtrie.SUBTRIE_NODES, 5, 1])
def test_matches_a_plain_trie(spark, limit):
    rows = odd() if limit > 1 else [r for r in odd() if r[0] not in (40, 45)]
    assert got(spark, rows, subtrie_nodes=limit) == plain(rows)


def test_turnless_and_absent_bases(spark):
    # some take more turns than they have from conversations that are absent, and are left without any
    rows = [(c, 0, "user", f"t{c % 3}") for c in range(23, 42) if c != 40]
    assert got(spark, rows) == plain(rows)
    assert any(r[1] == 0 and r[7] != hashlib.sha256(b"").hexdigest() for r in plain(rows))


def test_negative_ids_go_to_the_conversation_nearer_zero(spark):
    rows = [(-40, 0, "user", "base"), (-40, 1, "bot", "more"), (-41, 0, "user", "own"), (-41, 1, "user", "next")]
    h = zlib.crc32(b"-41") % 4
    path = ["base", "more"][:h] + ["own", "next"][h:]
    assert max(r[1] for r in got(spark, rows) if r[0] == -41 or h == 0) == len(path)


def test_empty_and_clashing_columns(spark):
    assert got(spark, []) == []
    rows = [r for r in odd() if r[0] not in (40, 45)]
    df = spark.createDataFrame(rows, SCHEMA).select(F.lit(1).alias("node"), F.lit("k").alias("key"), F.lit(2).alias("block"), F.col("turn").alias("TURN"), F.col("text").alias("Text"), "role", "conv_id", F.lit(3).alias("words"))
    assert sorted((tuple(r) for r in prefixtrie.prefix_trie(df).collect()), key=repr) == plain(rows)
