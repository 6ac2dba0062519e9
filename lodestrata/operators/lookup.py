"""Point, as-of and relational lookups over entities and relations.

Each lookup has a single-key form (a filter and a top row) and, where it is used for
many keys, a batched form that joins once instead of looking up in a loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.paths import normalise
from lodestrata.functions.text import ascii_lower, like_ascii, parent_module
from lodestrata.operators.sweep import stabbed, touched
from lodestrata.session import stored

#: Rows of a counted table that are sent to every task.
SENT_ROWS = 50_000


def _newest() -> list[Column]:
    return [F.desc_nulls_last("t_ingested_at"), F.desc("id")]


def entity_by_id(entities: DataFrame, key: int) -> DataFrame:
    return entities.where(F.col("id") == key).limit(1)


def entity_by_qualified_name(entities: DataFrame, name: str, file_path: str | None = None) -> DataFrame:
    found = entities.where(F.col("qualified_name") == name)
    if file_path is not None:
        found = found.where(F.col("file_path") == file_path)
    return found.orderBy(*_newest()).limit(1)


def latest_versions(entities: DataFrame, *keys: str) -> DataFrame:
    """The most recently ingested row per key; the larger id in a tie. One aggregation, no sort."""
    row = F.struct(*[F.col(c) for c in entities.columns])
    best = F.struct(F.coalesce("t_ingested_at", F.lit(None)), F.col("id"))
    return entities.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.max_by(row, best).alias("r")).select("r.*")


def entities_by_file(entities: DataFrame, file_path: str) -> DataFrame:
    return entities.where(F.col("file_path") == file_path).orderBy(F.asc_nulls_first("start_line"), "id")


def search_by_name(entities: DataFrame, query: str, limit: int = 50) -> DataFrame:
    hit = like_ascii(F.col("name"), f"%{query}%") | like_ascii(F.col("qualified_name"), f"%{query}%")
    return entities.where(hit).orderBy(*_newest()).limit(limit)


def resolve_symbol(entities: DataFrame, symbol: str, file_path: str | None = None) -> DataFrame:
    hit = (F.col("name") == symbol) | (F.col("qualified_name") == symbol) | like_ascii(F.col("qualified_name"), f"%::{symbol}")
    found = entities.where(hit)
    if file_path is not None:
        found = found.where(F.col("file_path") == file_path)
    return found.orderBy(*_newest()).limit(1).withColumn("parent_module", parent_module(F.col("qualified_name")))


def resolve_symbols(entities: DataFrame, wanted: DataFrame) -> DataFrame:
    """resolve_symbol for every ``wanted(symbol)`` as equi-joins on all that a row can be asked by.

    Unlike the single form, ``%`` and ``_`` in a symbol stand for themselves.
    """
    parts = F.split("qualified_name", "::")
    tails = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda k: ascii_lower(F.array_join(F.slice(parts, k, F.size(parts)), "::")))
    keys = F.array_distinct(F.array_compact(F.array(F.col("name"), F.col("qualified_name"))))
    exact = entities.select("id", "t_ingested_at", F.explode(keys).alias("symbol"))
    loose = entities.where(F.contains("qualified_name", F.lit("::"))).select("id", "t_ingested_at", F.explode(tails).alias("_tail"))
    asked = wanted.select("symbol").distinct()
    hits = asked.join(exact, "symbol").select("symbol", "id", "t_ingested_at")
    hits = hits.unionByName(asked.join(loose, ascii_lower(F.col("symbol")) == F.col("_tail")).select("symbol", "id", "t_ingested_at"))
    best = hits.groupBy("symbol").agg(F.max(F.struct("t_ingested_at", "id")).alias("b")).select("symbol", F.col("b.id").alias("id"))
    return best.join(entities, "id").withColumn("parent_module", parent_module(F.col("qualified_name")))


def valid_at(at: Column) -> Column:
    return (F.col("t_valid_from") <= at) & (F.col("t_valid_to").isNull() | (F.col("t_valid_to") > at))


def entity_as_of(history: DataFrame, key_col: str, key, at) -> DataFrame:
    return history.where((F.col(key_col) == key) & valid_at(F.lit(at))).orderBy(F.desc("t_valid_from"), F.desc("id")).limit(1)


def _ticks(df: DataFrame, column: str) -> Column:
    """A time as a number: microseconds, days of a date, or itself."""
    kind = df.schema[column].dataType.typeName()
    if kind.startswith("timestamp"):
        return F.unix_micros(F.col(column).cast("timestamp"))
    return F.unix_date(column) if kind == "date" else F.col(column).cast("bigint")


def as_of_join(probes: DataFrame, history: DataFrame, key: str, at: str = "at") -> DataFrame:
    """For each probe the version of ``history(key, id, t_valid_from, t_valid_to, ...)`` valid at its time, or nulls.

    As ``entity_as_of`` for many: versions may nest and overlap, the last to start wins,
    then the larger id; ids are unique. Versions and probes are swept together in one
    range sort, so there is no range join and a key's rows may lie in many partitions.
    """
    cols = [c for c in history.columns if c not in probes.columns]
    asked = stored(probes.withColumn("_probe", F.monotonically_increasing_id()), "probes")
    versions = history.select(F.col(key).alias("key"), _ticks(history, "t_valid_from").alias("since"), _ticks(history, "t_valid_to").alias("until"), F.col("id").cast("bigint").alias("version"))
    hits = stabbed(asked.select(F.col(key).alias("key"), _ticks(probes, at).alias("at"), F.col("_probe").alias("probe")), versions)
    hits = hits.select(F.col("probe").alias("_probe"), F.col("version").alias("_version"))
    found = history.select(F.col("id").cast("bigint").alias("_version"), *cols)
    return asked.join(hits, "_probe", "left").join(found, "_version", "left").select(*probes.columns, *cols)


def relations_by(relations: DataFrame, end: str, key: int) -> DataFrame:
    return relations.where(F.col(end) == key).orderBy("id")


def callers(entities: DataFrame, relations: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per ``calls`` edge into ``targets(target_id)``; edges from unknown entities are dropped."""
    edges = relations.where("kind = 'calls'").join(targets.select("target_id").distinct(), "target_id", "left_semi")
    source = entities.select(F.col("id").alias("source_id"), F.coalesce("qualified_name", "name").alias("caller"), "file_path", "start_line")
    return edges.select(F.col("id").alias("edge_id"), "target_id", "source_id").join(source, "source_id")


def edges_of(entities: DataFrame, relations: DataFrame, ids: DataFrame, cap: int = 50) -> DataFrame:
    """Edges out of and into ``ids(id)`` with their peers, at most ``cap`` a node and direction, by kind and peer name.

    ``total`` counts a node's edges in that direction before the cap; it is an aggregation
    of its own, so that a hub's edges are cut to ``cap`` before they are shuffled.
    """
    peer = entities.select(F.col("id").alias("peer_id"), F.coalesce("qualified_name", "name").alias("peer"))
    sides = []
    for mine, other, direction in (("source_id", "target_id", "out"), ("target_id", "source_id", "in")):
        own = relations.join(ids.select(F.col("id").alias(mine)).distinct(), mine, "left_semi")
        sides.append(own.select(F.col(mine).alias("id"), F.col(other).alias("peer_id"), F.col("id").alias("edge_id"), "kind", F.lit(direction).alias("direction")))
    both = sides[0].unionByName(sides[1]).join(peer, "peer_id")
    totals = both.groupBy("id", "direction").agg(F.count("*").alias("total"))
    per = Window.partitionBy("id", "direction").orderBy("kind", "peer", "edge_id")
    top = both.withColumn("n", F.row_number().over(per)).where(F.col("n") <= cap)
    return top.join(totals, ["id", "direction"])


def match_stored(symbols: DataFrame, stored: DataFrame) -> DataFrame:
    """Parsed symbols with the first stored entity of their name and line, or a null id."""
    first = stored.groupBy("name", "start_line").agg(F.min("id").alias("stored_id"))
    return symbols.join(first, ["name", "start_line"], "left")


def session_dedup(candidates: DataFrame, in_context: DataFrame) -> DataFrame:
    """Candidates whose session doesn't hold their file yet; sessions without files pass everything."""
    have = in_context.select(F.col("session_id").alias("_s"), normalise(F.col("file_path")).alias("_f")).distinct()
    return candidates.join(have, (F.col("session_id") == F.col("_s")) & (normalise(F.col("file_path")) == F.col("_f")), "left_anti")


def edit_overlap(bonuses: DataFrame, edits: DataFrame) -> DataFrame:
    """Bonuses with a flag: some edit of the same file touches their lines."""
    asked = bonuses.select("bonus_id", "file_path", F.col("line_lo").alias("lo"), F.col("line_hi").alias("hi"))
    found = touched(asked, edits, ["file_path"], "bonus_id").withColumn("_hit", F.lit(True))
    return bonuses.join(found, "bonus_id", "left").withColumn("touched", F.coalesce("_hit", F.lit(False))).drop("_hit")


def merge_search(symbols: DataFrame, texts: DataFrame, cap: int) -> DataFrame:
    """Symbol hits first, then text hits, one row per (file, line), at most ``cap``.

    A text hit on a symbol's place, or on an earlier text hit's, makes it ``both`` and
    brings its own preview; only text hits that come before the cap is reached count.
    """
    rows = symbols.select("file", "line", "preview", F.lit("symbol").alias("source"), F.lit(0).alias("_side"), "pos")
    rows = rows.unionByName(texts.select("file", "line", "preview", F.lit("text").alias("source"), F.lit(1).alias("_side"), "pos"))
    firsts = rows.groupBy("file", "line").agg(F.min(F.struct("_side", "pos")).alias("at"))
    top = firsts.orderBy("at", "file", "line").limit(cap)
    full = top.agg(F.count("*").alias("n"), F.max("at").alias("last")).first()
    places = top.select("file", "line")
    kept = rows.join(F.broadcast(places) if full["n"] <= SENT_ROWS else places, ["file", "line"])
    if full["n"] >= cap:  # the cap is reached: later text hits change nothing
        kept = kept.where(F.struct("_side", "pos") <= F.struct(F.lit(full["last"]["_side"]).alias("_side"), F.lit(full["last"]["pos"]).alias("pos")))
    out = kept.groupBy("file", "line").agg(
        F.min(F.struct("_side", "pos", "preview")).alias("first"),
        F.count(F.when(F.col("_side") == 1, 1)).alias("texts"),
        F.max_by("preview", F.when(F.col("_side") == 1, F.col("pos"))).alias("last_text"),
    )
    both = (F.col("first._side") == 0) & (F.col("texts") > 0) | (F.col("texts") > 1)
    return out.select(
        "file", "line",
        F.when(both, F.lit("both")).when(F.col("first._side") == 0, F.lit("symbol")).otherwise(F.lit("text")).alias("source"),
        F.when(both, F.col("last_text")).otherwise(F.col("first.preview")).alias("preview"),
    )


def attach_bonuses(hits: DataFrame, categories: dict[str, DataFrame], threshold: float = 0.1) -> DataFrame:
    """Hits with a sorted array per bonus category (``file_path, text`` each), null below the threshold; no hit is lost."""
    out = hits
    for name, rows in categories.items():
        grouped = rows.groupBy("file_path").agg(F.array_sort(F.collect_set("text")).alias(name))
        out = out.join(grouped, "file_path", "left").withColumn(name, F.when(F.col("score") >= threshold, F.col(name)))
    return out


def call_hierarchy(root: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(root, peers array<struct<name,file,line>>, direction)`` to peer entities and edges.

    ``incoming`` edges run peer to root, ``outgoing`` root to peer, both ``calls``;
    ``supertypes`` root to peer, ``inherits``. Rows without peers give nothing.
    """
    e = root.select("root", "direction", F.explode("peers").alias("p"))
    key = F.concat(F.col("p.file"), F.lit("::"), F.col("p.name"), F.lit("@"), F.col("p.line").cast("string"))
    entities = e.select(key.alias("qualified_name"), F.col("p.name").alias("name"), F.col("p.file").alias("file_path"), F.col("p.line").alias("start_line")).distinct()
    incoming = F.col("direction") == "incoming"
    edges = e.select(
        F.when(incoming, key).otherwise(F.col("root")).alias("source"),
        F.when(incoming, F.col("root")).otherwise(key).alias("target"),
        F.when(F.col("direction") == "supertypes", F.lit("inherits")).otherwise(F.lit("calls")).alias("kind"),
    )
    return entities, edges


def file_entities(entities: DataFrame, *spellings: str) -> DataFrame:
    """Entities stored under any spelling of a file's path, once each."""
    return entities.where(F.col("file_path").isin(*spellings)).dropDuplicates(["id"])


def occurrence_fields(occurrences: DataFrame) -> DataFrame:
    """``(symbol, kind, role, file_path, start_line, end_line, pos)`` to a row a field, as field fusion reads them."""
    names = ("symbol", "kind", "role")
    pairs = F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).cast("string").alias("value")) for n in names])
    out = occurrences.select(F.lit("scip").alias("source"), "pos", "file_path", "start_line", "end_line", F.explode(pairs).alias("f"))
    return out.select("source", "pos", "file_path", "start_line", "end_line", "f.field", "f.value")


def export_edges(entities: DataFrame, relations: DataFrame, form: str) -> DataFrame:
    """``(id, line)`` of the relations between stored entities as ``dot``, ``json`` or ``csv`` lines."""
    name = F.coalesce("qualified_name", "name")
    named = relations.join(entities.select(F.col("id").alias("source_id"), name.alias("source")), "source_id").join(entities.select(F.col("id").alias("target_id"), name.alias("target")), "target_id")
    row = F.struct("id", "source", "target", "kind", "weight")
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(c, r'(["\\\\])', r"\\$1"), F.lit('"'))
    forms = {"dot": F.concat(quoted("source"), F.lit(" -> "), quoted("target"), F.lit(" [label="), quoted("kind"), F.lit("];")), "json": F.to_json(row), "csv": F.to_csv(row)}
    if form not in forms:
        raise ValueError(f"{form!r} is none of {sorted(forms)}")
    return named.select("id", forms[form].alias("line"))
