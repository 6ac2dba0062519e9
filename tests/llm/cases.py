"""Small corpora and plain reference algorithms."""

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def near(text, k):
    """The text with one word changed, far from its ends."""
    words = text.split(" ")
    words[len(words) // 2 + k] = f"changed{k}"
    return " ".join(words)


def prose(seed, n):
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice(["an", "th", "er", "in", "ou", "re", "ti"]) for _ in range(r.randint(1, 4))) for _ in range(n))


def corpus():
    """Nulls in every column, empty and long texts, ties, repeated rows, exact and near copies."""
    long_ = prose(1, 30_000)
    base = [prose(100 + k, 80 + 20 * k) for k in range(12)]
    rows = [(k, t, "en", f"s{k % 3}", len(t)) for k, t in enumerate(base)]
    rows += [(50, base[3], "en", "s1", 0), (51, base[3], "fr", None, None), (3, base[3], "en", "s0", 0)]
    rows += [(60 + k, near(prose(7, 900), k), "en", "s0", 0) for k in range(4)]
    rows += [(70, None, None, None, None), (71, "", "en", "s2", 0), (72, " \t\n", "en", "s2", 0), (None, base[5], "en", "s0", 1), (None, None, None, "s1", 1)]
    rows += [(80, long_, "en", "s0", 1), (81, "one", "en", "s0", 1), (82, "ONE", "en", "s9", 1), (82, "ONE", "en", "s9", 1), (83, "é €  😀 x", "en", "s9", 1)]
    return rows


def spread(pairs):
    """Least label per node over links, by plain search."""
    adj = {}
    for a, b in pairs:
        adj.setdefault(a, set()).add(b)
        adj.setdefault(b, set()).add(a)
    out = {}
    for n in sorted(adj):
        if n not in out:
            todo = [n]
            while todo:
                x = todo.pop()
                if x not in out:
                    out[x] = n
                    todo += adj[x]
    return out
