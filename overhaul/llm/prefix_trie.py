"""The prefix trie of rebuilt conversations, by collapse of whole sequences.

*Rebuilding.* Conversation c takes the first h original turns of conversation
c - c % 100 (h = checksum of c modulo 6) and its own turns after its first h.

*Prefix ids.* The id of a prefix is a SHA-256 chain over its turns' digests.
Chains run inside blocks of ``BLOCK`` turns; the ids at the blocks' bounds come
from the same scan over the blocks' digests, so a conversation of any length is
scanned by many tasks, in as many rounds as its length has digits to that base.

*Collapse.* Conversations with the same whole sequence become one sequence with
its weight, its smallest member and the list of its ends. Sequences that are
proper prefixes of others go by an anti-join; the rest are the leaves. Then only
the turns of each sequence's smallest member are read: all prefixes carry the
sequence's weight and are added up, before the shuffle already.

*Saved tokens* of a subtree are the sum of n * length over its nodes less the sum
of length. The first is added up along the weighted sequences: weight times the
length of the whole sequence, less what lies above the node. For the second every
node belongs to one sequence, that of its smallest member; a sequence owns the
lower end of its path, so its owned length can be added up in the same way, and
only at the node's own sequence the part above the node has to be taken off.

*Ends.* The ids of a sequence are sorted over all tasks, joined in texts of
``END_BLOCK`` ids, and these run through one incremental hash for each sequence.

Turns of equal number are ordered by their digest. Rows without a conv_id belong
to no conversation and are left out; a conversation is in the table if it has a
row. Repeated rows are turns of their own. An empty table has no nodes.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overhaul.functions.joins import split_join
from overhaul.functions.ranking import positions_within
from overhaul.llm.common import map_batches, stage

BLOCK = 256  # turns chained in one step
END_BLOCK = 4096  # conv_ids joined into one text
HEAD = 5  # most turns that a conversation takes over
ROOT = ""


def original_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 0), digest, chars of every turn, in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256).alias("digest"),
        F.length(text).cast("long").alias("chars"))
    return positions_within(stage(turns, "turns"), ["conv_id"], ["turn", "digest"], "place").drop("turn")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All conversations (conv_id), and the turns (conv_id, place, digest, chars) that they are rebuilt of."""
    heads = turns.where(f"place < {HEAD}").withColumnRenamed("conv_id", "base")
    convs = turns.select("conv_id").distinct().withColumns({
        "base": F.expr("conv_id - conv_id % 100"), "h": F.expr("cast(crc32(cast(conv_id as string)) % 6 as int)")})
    lengths = heads.groupBy("base").agg(F.count("*").cast("int").alias("size"))
    convs = convs.join(lengths, "base", "left").withColumn("shift", F.expr("least(h, coalesce(size, 0)) - h")).drop("size")
    taken = convs.join(heads, "base").where("place < h").select("conv_id", "place", "digest", "chars")
    own = split_join(turns, convs.select("conv_id", "h", "shift"), ["conv_id"]).where("place >= h")
    own = own.select("conv_id", (F.col("place") + F.col("shift")).alias("place"), "digest", "chars")
    return convs.select("conv_id"), taken.unionByName(own)


def scan(rows: DataFrame, label: str) -> DataFrame:
    """conv_id, place, chars, and of the prefixes without and with the row: before, id, chars_before.

    ``rows`` has conv_id, place (0, 1, ... for each conv_id), digest, chars. Ids are the same for equal prefixes only.
    """
    blocks = rows.groupBy("conv_id", F.expr(f"place div {BLOCK}").alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("place", "digest", "chars"))).alias("items"))
    blocks = stage(blocks, label)
    if blocks.where("block > 0").isEmpty():
        begun = blocks.withColumns({"start": F.lit(ROOT), "chars_start": F.lit(0).cast("long"), "end": F.lit(None).cast("string")})
    else:
        whole = blocks.select("conv_id", F.col("block").alias("place"),
                              F.sha2(F.array_join("items.digest", ""), 256).alias("digest"),
                              F.expr("aggregate(items.chars, 0L, (a, x) -> a + x)").alias("chars"))
        upper = scan(whole, label).select("conv_id", F.col("place").alias("block"), F.col("before").alias("start"),
                                          F.col("chars_before").alias("chars_start"), F.col("id").alias("end"))
        begun = split_join(blocks, upper, ["conv_id", "block"])
    # The prefix that ends with a full block has the id that the next block starts with.
    chain = begun.withColumns({
        "ids": F.expr("aggregate(items, array(start), (a, x) -> array_append(a, sha2(concat(element_at(a, -1), x.digest), 256)))"),
        "sums": F.expr("aggregate(items, array(chars_start), (a, x) -> array_append(a, element_at(a, -1) + x.chars))")})
    chain = chain.withColumn("ids", F.expr(
        f"if(size(items) = {BLOCK} and end is not null, concat(slice(ids, 1, {BLOCK}), array(end)), ids)"))
    return chain.select("conv_id", "ids", "sums", F.posexplode("items").alias("at", "item")).select(
        "conv_id", F.col("item.place").alias("place"), F.col("item.chars").alias("chars"),
        F.expr("ids[at]").alias("before"), F.expr("ids[at + 1]").alias("id"), F.expr("sums[at]").alias("chars_before"))


def _end_texts(batches):
    """Texts of up to END_BLOCK comma-joined conv_ids of one sequence, from rows sorted by sequence and conv_id."""
    seq, ids = None, []

    def text():
        return {"seq": [seq], "first": [ids[0]], "ids": [",".join(map(str, ids))]}

    for batch in batches:
        for s, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if ids and (s != seq or len(ids) == END_BLOCK):
                yield text()
                ids = []
            seq = s
            ids.append(c)
    if ids:
        yield text()


def _end_hashes(batches):
    """One hash of each sequence's texts, from rows sorted by sequence and first conv_id."""
    seq, state = None, None
    for batch in batches:
        out = {"seq": [], "ends_sha256": []}
        for s, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if s == seq:
                state.update(b"," + ids.encode())
                continue
            if state:
                out["seq"].append(seq)
                out["ends_sha256"].append(state.hexdigest())
            seq, state = s, hashlib.sha256(ids.encode())
        yield out
    if state:
        yield {"seq": [seq], "ends_sha256": [state.hexdigest()]}


def end_lists(members: DataFrame) -> DataFrame:
    """seq, first, ids: the sorted members (seq, conv_id) of each sequence as texts, in order of ``first``."""
    ranged = members.select("seq", "conv_id").repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    return map_batches(ranged, _end_texts, "seq string, first bigint, ids string")


def trie(conversations: DataFrame) -> DataFrame:
    """One row a node: id, parent_id, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256 (of the decimal conv_ids of the conversations that end there). The turn of a node is turn ``depth``
    of the rebuilt conversation ``conv_id``."""
    convs, turns = rebuilt(original_turns(conversations))
    rows = stage(scan(turns, "blocks"), "prefixes")

    # Whole sequences: weight, smallest member, length.
    whole = rows.groupBy("conv_id").agg(F.max_by(
        F.struct("id", (F.col("chars_before") + F.col("chars")).alias("total")), "place").alias("last"))
    members = stage(split_join(convs, whole, ["conv_id"], "left").select(
        "conv_id", F.coalesce("last.id", F.lit(ROOT)).alias("seq"), F.coalesce("last.total", F.lit(0).cast("long")).alias("total")), "members")
    ends = end_lists(members).repartition("seq").sortWithinPartitions("seq", "first").select("seq", "ids")
    ends = map_batches(ends, _end_hashes, "seq string, ends_sha256 string")
    sequences = members.groupBy("seq").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("weight"), F.first("total").alias("total"))

    # Sequences that are proper prefixes of others are no leaves.
    leaves = sequences.join(rows.select(F.col("before").alias("seq")).distinct(), "seq", "left_anti").select("seq", F.lit(1).alias("leaf"))
    sequences = stage(sequences.join(leaves, "seq", "left").fillna(0, ["leaf"]).drop("seq"), "sequences")

    # All prefixes of each sequence's smallest member, and its root.
    prefixes = split_join(rows, sequences, ["conv_id"]).withColumn("depth", F.col("place").cast("long") + 1).drop("place")
    zero = F.lit(0).cast("long")
    roots = sequences.withColumns({"id": F.lit(ROOT), "before": F.lit(None).cast("string"), "chars": zero, "chars_before": zero, "depth": zero})
    weighted = stage(prefixes.unionByName(roots), "weighted")
    nodes = stage(weighted.groupBy("id").agg(
        *(F.first(c).alias(c) for c in ("before", "depth", "chars", "chars_before")),
        F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"), F.sum("leaf").alias("n_leaves")), "nodes")

    # Lengths that sequences own, and both sums over subtrees.
    owned = nodes.groupBy("conv_id").agg(F.sum("chars").alias("owned"))
    owners = stage(sequences.join(owned, "conv_id", "left").fillna(0, ["owned"]), "owners")
    sums = split_join(weighted.select("id", "conv_id", "weight"), owners.select("conv_id", "total", "owned"), ["conv_id"]).groupBy("id").agg(
        F.sum(F.col("weight") * F.col("total")).alias("read"), F.sum("owned").alias("kept"))
    below = nodes.where("depth > 0").groupBy(F.col("before").alias("id")).agg(F.count("*").alias("n_children"))
    out = (nodes.join(sums, "id").join(below, "id", "left")
           .join(ends.withColumnRenamed("seq", "id"), "id", "left")
           .join(owners.select("conv_id", "total", "owned"), "conv_id"))
    parents = nodes.select(F.col("id").alias("before"), F.col("conv_id").alias("parent_conv_id"))
    out = split_join(out, parents, ["before"], "left")
    saved = "(read - n_convs * chars_before) - (kept - owned + total - chars_before)"
    return out.select(
        "id", F.col("before").alias("parent_id"), "conv_id", "depth", "parent_conv_id", "n_convs",
        F.coalesce("n_children", zero).alias("n_children"), "n_leaves", F.expr(saved).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


ORACLE = """with bits as (
  select list(v order by i) as t from (select i, list_reduce(list_prepend(cast(i as ubigint), cast(range(8) as ubigint[])),
    lambda c, k: case when c & 1 = 1 then xor(c >> 1, cast(3988292384 as ubigint)) else c >> 1 end) as v
    from (select unnest(range(256)) as i))),
turns as (select conv_id as c, list({'r': coalesce(role, ''), 't': coalesce(text, '')} order by turn nulls first,
    sha256(cast(octet_length(encode(coalesce(role, ''))) as varchar) || ':' || coalesce(role, '') || coalesce(text, ''))) as l
  from conversations where conv_id is not null group by conv_id),
heads as (select c, l, xor(list_reduce(list_prepend(cast(4294967295 as ubigint), list_transform(range(1, length(cast(c as varchar)) + 1),
      lambda k: cast(ascii(cast(c as varchar)[k]) as ubigint))),
      lambda a, b: xor(t[cast((xor(a, b) & 255) + 1 as bigint)], a >> 8)), cast(4294967295 as ubigint)) % 6 as h
  from turns, bits),
rebuilt as (select a.c, list_concat(coalesce(b.l[1:cast(a.h as bigint)], []), a.l[cast(a.h as bigint) + 1:]) as s
  from heads a left join turns b on b.c = a.c - a.c % 100),
members as (select c, s, d, s[1:d] as p from (select c, s, unnest(range(0, len(s) + 1)) as d from rebuilt)),
nodes as (select d, p, min(c) as c, count(*) as n,
    sha256(coalesce(string_agg(cast(c as varchar), ',' order by c) filter (len(s) = d), '')) as ends
  from members group by d, p),
parents as (select a.*, b.c as up from nodes a left join nodes b on b.d = a.d - 1 and b.p = a.p[1:a.d - 1]),
children as (select d - 1 as d, p[1:d - 1] as p, count(*) as n from nodes where d > 0 group by 1, 2),
subtree as (select k as d, p[1:k] as p, sum((n - 1) * coalesce(length(p[d].t), 0)) as saved, count(*) filter (leaf) as leaves
  from (select a.*, b.n is null as leaf, unnest(range(0, a.d + 1)) as k from nodes a left join children b on b.d = a.d and b.p = a.p)
  group by 1, 2)
select a.c as conv_id, a.d as depth, a.up as parent_conv_id, a.n as n_convs, coalesce(b.n, 0) as n_children,
  s.leaves as n_leaves, cast(s.saved as bigint) as saved_tokens, a.ends as ends_sha256
from parents a left join children b on b.d = a.d and b.p = a.p join subtree s on s.d = a.d and s.p = a.p"""
