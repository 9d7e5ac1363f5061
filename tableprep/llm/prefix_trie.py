"""Trie of conversation prefixes, with subtree totals by parallel tree contraction.

Turns are put in order by one range sort, which cuts a long conversation into slices; a
slice counts its turns on its own, and a table with one row per (conversation, slice)
carries the counts. A prefix is known by its length and two 64-bit numbers, the exclusive
or of hashes of (place, role, text) over its turns, which adds up over slices likewise.
Equal prefixes of all conversations are one node.

Totals over subtrees come from contraction. A round rakes the leaves, adding what they hold
to their parents, and then compresses unary chains: of neighbouring unary nodes those go
whose depth has fewer trailing zero bits, so every second one on an untouched chain; the
child of a node that goes moves up to its parent, and its edge remembers what it passed. A
few joins make a round, and the number of rounds grows with the logarithm of the nodes. Then
the nodes that went are put back, last round first: the total of each is what it held, plus
the edge and the total of the child it had.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableprep.operators.lookup import fits_broadcast

from .common import pick, small_batches, stored, words

#: Seeds of the two numbers of a prefix.
SEEDS = (11, 23)
#: So many parents with the most children meet these by broadcast where the table of parents is large.
HEAVY = 1_000
#: Characters of one piece of a list of conversations.
PIECE = 1 << 20


def sliced(turns: DataFrame) -> DataFrame:
    """``turns`` (conv, turn, role, text) in order: conv, slice, at (ascending within a slice), digest, words.

    Texts go through the sort only if some turns of a conversation share a number.
    """
    tied = not turns.groupBy("conv", "turn").count().filter("count > 1").isEmpty()
    digest = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256))
    thin = turns.select("conv", "turn", digest.alias("digest"), F.size(words(F.col("text"))).cast("long").alias("words"),
                        *([F.col("role"), F.col("text")] if tied else []), F.monotonically_increasing_id().alias("row"))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), *([F.col("role"), F.col("text")] if tied else []), F.col("row")]
    # the order keeps a conversation together and cuts long ones; the row number splits equal rows
    return stored(thin.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv", F.spark_partition_id().alias("slice"), F.monotonically_increasing_id().alias("at"), "digest", "words"), "turns")


def rebuilt(turns: DataFrame, lead: Column, base: Column) -> DataFrame:
    """conv, slice, place (from 0), digest, words of rebuilt conversations, and a row with a null place for each conversation.

    A conversation is rebuilt from the first ``lead`` turns of conversation ``base`` (columns over conv, lead of at
    most three), then its own turns after its first ``lead``.
    """
    rows = sliced(turns)
    parts = rows.groupBy("conv", "slice").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("conv").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    parts = stored(parts.withColumn("gone", F.coalesce(F.sum("n").over(before), F.lit(0))), "slices")
    convs = parts.groupBy("conv").agg(F.sum("n").alias("n")).withColumn("lead", lead.cast("long")).withColumn("base", base.cast("long"))
    sizes = convs.select(F.col("conv").alias("from"), F.col("n").alias("has"))
    convs = stored(convs.join(sizes, F.col("base") == F.col("from"), "left").select(
        "conv", "lead", "base", F.least("lead", F.coalesce("has", F.lit(0))).alias("taken")), "conversations")
    known = parts.join(convs, "conv").select(F.col("conv").alias("c"), F.col("slice").alias("s"), "first", "gone", "lead", "taken")
    numbered = stored(rows.join(known, (F.col("conv") == F.col("c")) & (F.col("slice") == F.col("s"))).select(
        "conv", "slice", (F.col("at") - F.col("first") + F.col("gone")).alias("old"), "lead", "taken", "digest", "words"), "numbered-turns")
    own = numbered.filter("old >= lead").select("conv", "slice", (F.col("old") - F.col("lead") + F.col("taken")).alias("place"), "digest", "words")
    heads = numbered.filter("old < 3").select(F.col("conv").alias("from"), F.col("old").alias("place"), "digest", "words")
    led = convs.filter("taken > 0").join(heads, (F.col("base") == F.col("from")) & (F.col("place") < F.col("taken"))) \
        .select("conv", F.lit(-1).alias("slice"), "place", "digest", "words")
    start = convs.select("conv", F.lit(-2).alias("slice"), F.lit(None).cast("long").alias("place"), F.lit(None).cast("binary").alias("digest"),
                         F.lit(0).cast("long").alias("words"))
    return own.unionByName(led).unionByName(start)


def prefixes(turns: DataFrame) -> DataFrame:
    """conv, depth, a, b, ea, eb, words, last: each prefix with its two numbers, those of its last turn, and whether it is the whole."""
    e = turns.select("conv", "slice", "place", "words", *[
        F.coalesce(F.when(F.col("place").isNotNull(), F.xxhash64(F.lit(seed), "place", "digest")), F.lit(0).cast("long")).alias(name)
        for seed, name in zip(SEEDS, ("ea", "eb"))])
    e = stored(e, "rebuilt-turns")
    parts = e.groupBy("conv", "slice").agg(F.bit_xor("ea").alias("a"), F.bit_xor("eb").alias("b"), F.max("place").alias("place"))
    before = Window.partitionBy("conv").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv")
    carry = parts.select(F.col("conv").alias("c"), F.col("slice").alias("s"), F.coalesce(F.bit_xor("a").over(before), F.lit(0)).alias("ca"),
                         F.coalesce(F.bit_xor("b").over(before), F.lit(0)).alias("cb"), F.coalesce(F.max("place").over(whole), F.lit(-1)).alias("end"))
    run = Window.partitionBy("conv", "slice").orderBy("place")  # a slice is bounded by the range sort
    place = F.coalesce("place", F.lit(-1))
    within = e.select("conv", "slice", "place", "words", "ea", "eb", F.bit_xor("ea").over(run).alias("ra"), F.bit_xor("eb").over(run).alias("rb"))
    return within.join(carry, (F.col("conv") == F.col("c")) & (F.col("slice") == F.col("s"))).select(
        "conv", (place + 1).alias("depth"), F.col("ra").bitwiseXOR(F.col("ca")).alias("a"), F.col("rb").bitwiseXOR(F.col("cb")).alias("b"),
        "ea", "eb", "words", (place == F.col("end")).alias("last"))


def id_lists(ends: DataFrame) -> DataFrame:
    """depth, a, b, ends_sha256: the hash of the ascending, comma-joined conv of ``ends`` (depth, a, b, conv).

    A range sort cuts long lists; slices join their part to pieces of about ``PIECE`` characters, which
    then meet in order, one piece in memory at a time.
    """
    order = ["depth", "a", "b", "conv"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, first, part, size = None, 0, [], 0
        done, held = [], 0
        for batch in batches:
            for *node, conv in zip(*[batch.column(c).to_pylist() for c in order]):
                if part and (node != of or size > PIECE):
                    done.append((*of, first, ",".join(part)))
                    held, part, size = held + size, [], 0
                if not part:
                    of, first = node, conv
                part.append(str(conv))
                size += len(part[-1]) + 1
                if held > PIECE:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], [*order, "part"])
                    done, held = [], 0
        if part:
            done.append((*of, first, ",".join(part)))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], [*order, "part"])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        of, digest = None, None
        for batch in batches:
            out = []
            for *node, part in zip(*[batch.column(c).to_pylist() for c in ("depth", "a", "b", "part")]):
                if node != of:
                    if of is not None:
                        out.append({"depth": of[0], "a": of[1], "b": of[2], "ends_sha256": digest.hexdigest()})
                    of, digest = node, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(part.encode())
            if out:
                yield pa.RecordBatch.from_pylist(out)
        if of is not None:
            yield pa.RecordBatch.from_pylist([{"depth": of[0], "a": of[1], "b": of[2], "ends_sha256": digest.hexdigest()}])

    node = "depth long, a long, b long"
    cut = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pieces, f"{node}, conv long, part string")
    return cut.repartition("depth", "a", "b").sortWithinPartitions(*order).select("depth", "a", "b", "part") \
        .mapInArrow(hashes, f"{node}, ends_sha256 string")


def nodes(found: DataFrame) -> DataFrame:
    """id, depth, conv_id, n_convs, words, parent, parent_conv_id, n_children, ends_sha256 of every node of ``found`` (see ``prefixes``)."""
    up = (F.col("depth") - 1).alias("pdepth"), F.col("a").bitwiseXOR(F.col("ea")).alias("pa"), F.col("b").bitwiseXOR(F.col("eb")).alias("pb")
    found = stored(found, "prefixes")
    each = found.groupBy("depth", "a", "b").agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.first("words").alias("words"),
                                                F.first("ea").alias("ea"), F.first("eb").alias("eb"))
    lists = id_lists(found.filter("last"))
    each = each.join(lists, ["depth", "a", "b"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)))
    each = stored(each.withColumn("id", F.monotonically_increasing_id()).select("*", *up).drop("ea", "eb"), "trie")
    parents = each.filter("depth > 0").groupBy("pdepth", "pa", "pb").agg(F.count("*").alias("n_children"))
    counted = stored(each.drop("pdepth", "pa", "pb").join(
        parents, (F.col("depth") == F.col("pdepth")) & (F.col("a") == F.col("pa")) & (F.col("b") == F.col("pb")), "left")
        .drop("pdepth", "pa", "pb").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-counted")
    above = counted.filter("n_children > 0").select(F.col("depth").alias("d"), F.col("a").alias("x"), F.col("b").alias("y"),
                                                    F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    child = each.select("id", "pdepth", "pa", "pb")
    met = (F.col("pdepth") == F.col("d")) & (F.col("pa") == F.col("x")) & (F.col("pb") == F.col("y"))
    if fits_broadcast(above, above.columns):
        linked = child.join(F.broadcast(above), met, "left").select("id", "parent", "parent_conv_id")
    else:  # a parent may hold much of all nodes as children
        heavy = stored(above.orderBy(F.desc("n_children"), "parent").limit(HEAVY), "trie-heavy")
        one = child.join(F.broadcast(heavy), met, "left")
        rest = one.filter("parent IS NULL").select("id", "pdepth", "pa", "pb").join(above, met, "left")
        linked = one.filter("parent IS NOT NULL").select("id", "parent", "parent_conv_id").unionByName(rest.select("id", "parent", "parent_conv_id"))
    return stored(counted.drop("a", "b").join(linked, "id"), "trie-nodes")


def _zero_bits(depth: Column) -> Column:
    """The lowest set bit of a depth: the fewer trailing zero bits, the smaller."""
    return depth.bitwiseAND(-depth)


def subtree_totals(tree: DataFrame, values: list[str]) -> DataFrame:
    """id and the total of each of ``values`` over the subtree of every node of ``tree`` (id, parent, depth, values).

    ``parent`` is null for a root; ``depth`` grows by one from parent to child. State and results of each round are
    stored in the shared folder; only counts reach the driver.
    """
    held, passed = [f"held_{v}" for v in values], [f"edge_{v}" for v in values]
    kids = tree.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("p")).agg(F.count("*").alias("kids"))
    state = stored(tree.join(kids, F.col("id") == F.col("p"), "left").select(
        "id", "parent", "depth", F.coalesce("kids", F.lit(0)).alias("kids"), *[F.col(v).alias(h) for v, h in zip(values, held)],
        *[F.lit(0).cast("long").alias(w) for w in passed]), "contraction")
    raked, spliced = [], []
    while not state.isEmpty():
        leaf = F.col("kids") == 0
        raked.append(state.filter(leaf).select("id", *[F.col(h).alias(v) for v, h in zip(values, held)]))
        up = state.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("p")).agg(
            F.count(F.when(~leaf, 1)).alias("stay"), F.max(F.when(~leaf, F.col("id"))).alias("kid"),
            *[F.sum(F.when(leaf, F.col(h) + F.col(w)).otherwise(0)).alias(f"up_{v}") for v, h, w in zip(values, held, passed)])
        kept = stored(state.filter(~leaf).join(up, F.col("id") == F.col("p")).select(
            "id", "parent", "depth", F.col("stay").alias("kids"), "kid",
            *[(F.col(h) + F.col(f"up_{v}")).alias(h) for v, h in zip(values, held)], *passed), "contraction-raked")
        unary = kept.filter("kids = 1 AND parent IS NOT NULL")
        low = unary.select(F.col("id").alias("below"), F.struct(_zero_bits(F.col("depth")), "depth").alias("mark"))
        pairs = unary.select("id", "kid", F.struct(_zero_bits(F.col("depth")), "depth").alias("own")).join(low, F.col("kid") == F.col("below"))
        stays = pairs.select(F.when(F.col("own") < F.col("mark"), F.col("kid")).otherwise(F.col("id")).alias("stays")).distinct()
        goes = stored(unary.join(stays, F.col("id") == F.col("stays"), "left_anti").select(
            F.col("id").alias("gone"), F.col("parent").alias("new_parent"), F.col("kid").alias("moved"), *[F.col(h).alias(f"own_{h}") for h in held],
            *[F.col(w).alias(f"own_{w}") for w in passed]), "contraction-gone")
        # what a node that goes adds to its child's total: what it held, and the edge between them as it was
        spliced.append(goes.select("gone", "moved", *[F.col(f"own_{h}").alias(h) for h in held]).join(
            kept.select(F.col("id").alias("m"), *passed), F.col("moved") == F.col("m")).select(
            F.col("gone").alias("id"), F.col("moved").alias("kid"), *[(F.col(h) + F.col(w)).alias(v) for v, h, w in zip(values, held, passed)]))
        # neighbours never both go, so a node is marked once: as gone, or as moved up
        marks = goes.withColumn("at", F.explode(F.array("gone", "moved")))
        shifted = kept.drop("kid").join(marks, F.col("id") == F.col("at"), "left").filter("gone IS NULL OR id <> gone")
        state = stored(shifted.select(
            "id", F.when(F.col("gone").isNotNull(), F.col("new_parent")).otherwise(F.col("parent")).alias("parent"), "depth", "kids", *held,
            *[(F.col(w) + F.coalesce(F.col(f"own_{h}") + F.col(f"own_{w}"), F.lit(0))).alias(w) for h, w in zip(held, passed)]), "contraction")
    totals = None
    for part in raked:
        totals = part if totals is None else totals.unionByName(part)
    if totals is None:
        return tree.select("id", *values)
    for back in reversed(spliced):
        known = totals.select(F.col("id").alias("k"), *[F.col(v).alias(f"sub_{v}") for v in values])
        again = back.join(known, F.col("kid") == F.col("k")).select("id", *[(F.col(v) + F.col(f"sub_{v}")).alias(v) for v in values])
        totals = totals.unionByName(stored(again, "contraction-totals"))
    return totals


def prefix_trie(turns: DataFrame, lead: Column | None = None, base: Column | None = None, key: str = "conv_id", turn: str = "turn",
                role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node.

    Turns are ordered by turn (null first), then role and text; a null role or text is the empty one. With ``lead``
    and ``base``, columns over ``conv``, conversations are rebuilt first (see ``rebuilt``). saved_tokens sums, over
    the subtree, a node's members but one times the words of its last text. Rows with a null key take no part;
    repeated rows are turns of their own. Texts of any length count whole. An empty table gives no node, not even a root.
    """
    small_batches(turns)
    rows = pick(turns, conv=key, turn=turn, role=role, text=text).filter("conv IS NOT NULL").select(
        "conv", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    made = rebuilt(rows, F.lit(0) if lead is None else lead, F.col("conv") if base is None else base)
    trie = nodes(prefixes(made))
    worth = trie.select("id", "parent", "depth", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"),
                        ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    totals = subtree_totals(worth, ["n_leaves", "saved_tokens"])
    return trie.join(totals, "id").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
