"""Mixing sources to target weights: DataFrame and SQL functions only.

Every document has a priority (a keyed md5 prefix of its id, source, text and, among rows
equal in these, its number), so the documents of a source in priority order are a fixed
random permutation and equal priority ranges are random blocks. A source's word target is
met by whole passes over its blocks and one partial pass over blocks in permuted order,
cut inside a single block by refining that block's priority range twice. Where a document
that is too large stops the cut, further rounds go on over the untaken documents that
still fit. The resulting exact block quotas are split down a binary tree
over the output shards: at each node the left half's count of every source is a
hypergeometric draw given what the sources before it took (inverse distribution
function, uniform keyed by node and source). A shard then takes its disjoint range of
each source's permuted draws and shuffles locally.

The number of shards grows with the corpus (``SHARD_WORDS`` words each) and blocks a
source are at least sixteen times the shards, so quotas stay fine-grained at any size.
Side tables have a row a source, or a row a source and block that holds documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.scratch import dealt, near, numbered, place, shielded, table, unshielded

PRIORITY_BITS = 60
BLOCK_BITS = (6, 18)
FINE_BITS = 10
#: Rounds of the partial pass.
ROUNDS = 5
SHARD_WORDS = 4_000_000
LEVELS = (2, 18)
MAX_COPIES = 3
WEIGHTS = (1, 2, 3)
WORD = r"[^ \t-\r]+"


def keyed(*parts: Column | str) -> Column:
    """A 60-bit number from the md5 of the parts."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


@dataclass
class Mix:
    """``sources``: source, source_size, target, passes; ``draws``: source, block, cuts (one per draw of the block: epoch, shard, rounds).

    ``rounds`` are the (most, cut) of the partial pass: a document of at most ``most`` words
    is drawn up to the priority ``cut``. A whole pass has none.
    """

    sources: DataFrame
    draws: DataFrame
    seed: str
    levels: int
    bits: int

    def draws_of(self, sized: DataFrame) -> DataFrame:
        """``sized(source_key, prio, size, ...)`` with its source's size and target, and ``cuts``: an entry a copy that the mix takes."""
        plan = self.sources.join(self.draws, "source_key").select("source_key", "block", "source_size", "target", "cuts")
        out = sized.withColumn("block", _block(F.col("prio"), self.bits)).join(near(table(plan, "mix-plan")), ["source_key", "block"], "left")
        return out.withColumn("cuts", F.expr("filter(cuts, c -> c.rounds IS NULL OR exists(c.rounds, r -> size <= r.most AND prio <= r.cut))"))


def source_key(source: Column) -> Column:
    """Sorts by code point with null last, and joins null with null."""
    return F.coalesce(F.concat(F.lit("0"), source.cast("string")), F.lit("1"))


def _prioritised(rows: DataFrame, seed: str, id_: str, text: str) -> DataFrame:
    """``rows(source_key, ...)`` with ``prio``; rows that are equal in id, source and text are drawn one by one."""
    rows = rows.withColumn("body", F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    rows = numbered(rows.withColumn("who", F.coalesce(F.col(id_).cast("string"), F.lit(""))), "source_key", "body", "who")
    return rows.withColumn("prio", keyed(seed, F.col("who"), F.col("source_key"), F.col("body"), F.col("number"))).drop("body", "who", "number")


def _block(prio: Column, bits: int) -> Column:
    return F.shiftright(prio, PRIORITY_BITS - bits).cast("int")


def _grain(words: int) -> tuple[int, int]:
    """(levels of the shard tree, bits of a block number) for a corpus of so many words."""
    levels = min(LEVELS[1], max(LEVELS[0], (words // SHARD_WORDS).bit_length()))
    return levels, min(BLOCK_BITS[1], max(BLOCK_BITS[0], levels + 4))


def _targets(sized: DataFrame) -> DataFrame:
    """Water level: weights in proportion, no source above MAX_COPIES times its size."""
    per = table(sized.groupBy("source_key").agg(F.sum("size").alias("source_size")), "mix-sources")
    cycle = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), ((F.row_number().over(Window.orderBy("source_key")) - 1) % len(WEIGHTS) + 1).cast("int"))
    big = "decimal(38,0)"
    per = per.withColumn("w", cycle)
    by_cap = Window.orderBy((F.col("source_size") * 6 / F.col("w")).cast(big), "source_key")
    upto, every = by_cap.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    cap = (F.col("source_size") * MAX_COPIES).cast(big)
    per = per.withColumn("all", F.sum("source_size").over(every)).withColumn("weights", F.sum("w").over(every))
    rest = F.col("all").cast(big) - F.coalesce(F.sum(cap).over(upto), F.lit(0).cast(big))
    weights = F.col("weights") - F.coalesce(F.sum("w").over(upto), F.lit(0))
    per = per.withColumn("full", cap * weights <= rest * F.col("w"))
    open_rest = F.col("all") - F.sum(F.when(F.col("full"), F.col("source_size") * MAX_COPIES).otherwise(0)).over(every)
    open_w = F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(every)
    share = F.when(F.col("full"), (F.col("source_size") * MAX_COPIES).cast("double")).otherwise(open_rest.cast("double") * F.col("w") / open_w)
    per = per.withColumn("target", F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(share))
    passes = F.when(F.col("source_size") == 0, 0).otherwise(F.least(F.floor(F.col("target") / F.greatest("source_size", F.lit(1))), F.lit(MAX_COPIES)))
    return per.select("source_key", "source_size", "target", passes.cast("int").alias("passes"))


def _cut(sized: DataFrame, sources: DataFrame, seed: str, bits: int) -> DataFrame:
    """``rounds`` of (most, cut) per source and occupied block: what the partial pass takes of it.

    In a round a source's open documents of at most ``most`` words, what is still short, are
    taken in block and priority order until the next one doesn't fit. Rounds after the
    first are for sources that are short by more than a thousandth of their target; they
    end when nothing that fits is left, after ROUNDS at the latest.
    """
    docs = sized.withColumn("block", _block(F.col("prio"), bits))
    order = Window.partitionBy("source_key").orderBy(keyed(seed, "block", F.col("source_key"), F.col("block")), "block")
    in_order = Window.partitionBy("source_key").rowsBetween(Window.unboundedPreceding, 0)
    fine, low = PRIORITY_BITS - bits - FINE_BITS, PRIORITY_BITS - bits
    short = sources.select("source_key", "target", (F.col("target") - F.col("passes") * F.col("source_size")).alias("short"))
    taken = table(docs.select("source_key", "block").distinct().withColumn("rounds", F.expr("CAST(array() AS ARRAY<STRUCT<most: DOUBLE, cut: BIGINT>>)")), "mix-taken")
    for _ in range(ROUNDS):
        fits = docs.join(near(short.drop("target")), "source_key").where("size > 0 AND size <= short").join(near(taken), ["source_key", "block"])
        fits = fits.where("NOT exists(rounds, r -> size <= r.most AND prio <= r.cut)").select("source_key", "block", "prio", "size", "short")
        blocks = fits.groupBy("source_key", "block", "short").agg(F.sum("size").alias("n"))
        blocks = blocks.withColumn("room", F.col("short") - F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("n"))
        blocks = table(blocks, "mix-blocks")
        if blocks.isEmpty():
            break
        edge = blocks.where("room > 0 AND room < n").select("source_key", "block", "room")
        inside = fits.join(near(edge), ["source_key", "block"]).withColumn("fine", F.shiftright("prio", fine))
        inside = table(inside.select("source_key", "block", "room", "prio", "size", "fine"), "mix-edge")
        parts = inside.groupBy("source_key", "block", "room", "fine").agg(F.sum("size").alias("n"))
        parts = parts.withColumn("room", F.col("room") - F.sum("n").over(in_order.orderBy("fine")) + F.col("n"))
        at = parts.where("room >= 0").groupBy("source_key", "block").agg(F.max_by(F.struct("fine", "room"), F.col("fine")).alias("e"))
        at = at.select("source_key", "block", F.col("e.fine").alias("fine"), F.col("e.room").alias("room"))
        last = inside.drop("room").join(at, ["source_key", "block", "fine"]).withColumn("upto", F.sum("size").over(in_order.orderBy("prio")))
        last = last.groupBy("source_key", "block", "fine").agg(F.max(F.when(F.col("upto") <= F.col("room"), F.col("prio"))).alias("cut"))
        last = last.select("source_key", "block", F.coalesce("cut", F.shiftleft("fine", fine) - 1).alias("cut"))
        whole = F.when(F.col("room") >= F.col("n"), F.lit(1 << PRIORITY_BITS)).when(F.col("room") <= 0, F.lit(-1))
        now = blocks.join(last, ["source_key", "block"], "left").select("source_key", "block", "short", F.coalesce(whole, "cut", F.shiftleft(F.col("block").cast("bigint"), low) - 1).alias("cut"))
        now = table(now, "mix-cuts")
        got = fits.drop("short").join(near(now), ["source_key", "block"]).where("prio <= cut").groupBy("source_key").agg(F.sum("size").alias("got"))
        step = F.when(F.col("cut").isNull(), F.col("rounds")).otherwise(F.concat("rounds", F.array(F.struct(F.col("short").cast("double").alias("most"), "cut"))))
        taken = table(taken.join(now, ["source_key", "block"], "left").select("source_key", "block", step.alias("rounds")), "mix-taken")
        short = table(short.join(got, "source_key", "left").select("source_key", "target", (F.col("short") - F.coalesce("got", F.lit(0))).alias("short")).where("short * 1000 > target"), "mix-short")
        if short.isEmpty():
            break
    return taken


def _hyper(all_: str, own: str, want: str, u: str) -> str:
    """SQL for a draw of how many of ``want`` blocks, out of ``all_``, are among the source's ``own``; ``u`` is uniform."""
    ratio = f"ln((({own} - k) * CAST({want} - k AS DOUBLE)) / ((k + 1) * CAST({all_} - {own} - {want} + k + 1 AS DOUBLE)))"
    lo, hi = f"greatest(0L, {want} - ({all_} - {own}))", f"least({want}, {own})"
    mass = (
        f"aggregate(sequence({lo}, {hi}), named_struct('lw', 0D, 'top', 0D, 'sum', 0D), (a, k) -> named_struct("
        f"'lw', a.lw + IF(k < {hi}, {ratio}, 0D), 'top', greatest(a.top, a.lw), 'sum', a.sum * exp(a.top - greatest(a.top, a.lw)) + exp(a.lw - greatest(a.top, a.lw))), "
        "a -> named_struct('top', a.top, 'sum', a.sum))"
    )
    walk = (
        f"aggregate(sequence({lo}, {hi}), named_struct('lw', 0D, 'cum', 0D, 'at', {lo}, 'm', {mass}), (a, k) -> named_struct("
        f"'lw', a.lw + IF(k < {hi}, {ratio}, 0D), 'cum', a.cum + exp(a.lw - a.m.top), 'at', IF(a.cum <= {u} * a.m.sum, k, a.at), 'm', a.m), a -> a.at)"
    )
    return walk


def split_quotas(quotas: DataFrame, levels: int, seed: str) -> DataFrame:
    """``(source_key, q)`` split exactly over ``2**levels`` shards: ``(source_key, shard, q)``.

    All sources of a node sit in one row's array: as many entries as there are sources.
    """
    nodes = quotas.agg(F.array_sort(F.collect_list(F.struct("source_key", F.col("q").cast("bigint").alias("q")))).alias("qs")).withColumn("node", F.lit(0).cast("bigint"))
    for level in range(levels):
        nodes = nodes.withColumn("total", F.expr("aggregate(qs, 0L, (a, x) -> a + x.q)"))
        nodes = nodes.withColumn("want", F.expr(f"shiftright(total + CAST(pmod(xxhash64(node, {level}, '{seed}'), 2) AS BIGINT), 1)"))
        u = f"(CAST(shiftrightunsigned(xxhash64(x.source_key, node, {level}, '{seed}'), 11) AS DOUBLE) / 9007199254740992D)"
        took = _hyper("s.total", "x.q", "s.want", u)
        nodes = nodes.withColumn(
            "left",
            F.expr(
                "aggregate(qs, named_struct('total', total, 'want', want, 'out', CAST(array() AS ARRAY<BIGINT>)), (s, x) -> "
                f"element_at(transform(array({took}), t -> named_struct('total', s.total - x.q, 'want', s.want - t, 'out', concat(s.out, array(t)))), 1), s -> s.out)"
            ),
        )
        kids = F.expr("array(named_struct('node', node * 2, 'qs', zip_with(qs, left, (x, t) -> named_struct('source_key', x.source_key, 'q', t))), named_struct('node', node * 2 + 1, 'qs', zip_with(qs, left, (x, t) -> named_struct('source_key', x.source_key, 'q', x.q - t))))")
        nodes = table(nodes.select(F.explode(kids).alias("k")).select("k.qs", "k.node"), "mix-tree")
    return nodes.select(F.col("node").cast("int").alias("shard"), F.explode("qs").alias("x")).select("x.source_key", "shard", "x.q")


def _sized(docs: DataFrame, source: str, text: str) -> DataFrame:
    return docs.withColumn("source_key", source_key(F.col(source))).withColumn("size", word_count(F.col(text)))


def _plan(sized: DataFrame, seed: str) -> Mix:
    """The plan for ``sized(source_key, size, prio)``, a written table."""
    sources = table(_targets(sized), "mix-targets")
    levels, bits = _grain(int(sources.agg(F.sum("source_size")).first()[0] or 0))
    cuts = _cut(sized, sources, seed, bits)
    every = F.transform(
        F.sequence(F.lit(0), F.col("passes")),
        lambda e: F.struct(e.alias("epoch"), F.when(e == F.col("passes"), F.col("rounds")).alias("rounds")),
    )
    drawn = sources.select("source_key", "passes").join(cuts, "source_key").select("source_key", "block", F.explode(every).alias("d"))
    drawn = drawn.select("source_key", "block", "d.*").where("rounds IS NULL OR exists(rounds, r -> r.cut >= 0)")
    order = Window.partitionBy("source_key").orderBy("epoch", keyed(seed, "order", F.col("source_key"), F.col("epoch"), F.col("block")), "block")
    drawn = table(drawn.withColumn("at", F.row_number().over(order)), "mix-draws")
    shards = split_quotas(drawn.groupBy("source_key").agg(F.count("*").alias("q")), levels, seed)
    upto = Window.partitionBy("source_key").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    ranges = shards.withColumn("to", F.sum("q").over(upto)).select("source_key", F.col("shard"), (F.col("to") - F.col("q")).alias("from"), "to")
    placed = drawn.join(ranges, "source_key").where("at > from AND at <= to")
    draws = placed.groupBy("source_key", "block").agg(F.array_sort(F.collect_list(F.struct("epoch", "shard", "rounds"))).alias("cuts"))
    grid = cuts.select("source_key", "block").join(draws, ["source_key", "block"], "left")
    return Mix(sources, table(grid, "mix-grid"), seed, levels, bits)


def mix_takes(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: str = "mix") -> DataFrame:
    """``doc_id, size, source_size, target, taken`` per input row.

    Size is the number of words of the whole text (null text: 0). Targets share the total
    of all sizes by the weights 1, 2, 3 over sources in code point order (null last); none
    exceeds three times its source's size. ``taken`` is the size times the number of copies
    drawn (0 to 3). A source falls short of its target by less than a thousandth or than
    its smallest untaken document, unless ROUNDS rounds of passing over too large ones leave more. Repeated rows
    and ids, null ids among them, are drawn one by one. Other columns aren't read. An empty
    table gives an empty table; a corpus without words has targets and takes of zero.
    Reruns give the same rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("s"), F.col(text_col).alias("t"))
    sized = table(_prioritised(_sized(rows, "s", "t"), seed, "doc_id", "t").drop("s", "t"), "mix-sizes")
    out = _plan(sized.select("source_key", "size", "prio"), seed).draws_of(sized)
    copies = F.coalesce(F.size("cuts"), F.lit(0))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: str = "mix") -> DataFrame:
    """The mixed corpus: each document as often as it is drawn, dealt to its shards and shuffled there.

    Returns the columns of ``docs``, whatever their names; documents that the mix doesn't take are absent. A document
    without words is taken as often as its block is. For the rest see ``mix_takes``.
    """
    source, text = place(docs, source_col), place(docs, text_col)
    rows = _prioritised(_sized(shielded(docs), source, text), seed, place(docs, id_col), text)
    mix = _plan(table(rows.select("source_key", "size", "prio"), "mix-sizes"), seed)
    taken = mix.draws_of(rows).withColumn("draw", F.explode("cuts"))
    taken = taken.withColumn("shard", F.col("draw.shard")).withColumn("order", keyed(seed, "shuffle", F.col("prio"), F.col("draw.epoch")))
    taken = taken.withColumn("dealt", dealt(docs.sparkSession, "shard", 1 << mix.levels))
    shuffled = taken.select(*[c for c in rows.columns if c.startswith("in_")], "shard", "order", "dealt").repartition(1 << mix.levels, "dealt")
    return unshielded(shuffled.sortWithinPartitions("shard", "order"), docs.columns)
