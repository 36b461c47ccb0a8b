"""Merkle manifest of a dataset: leaves, a tree for each group, a tree over the groups, and proofs.

H is the lowercase hex SHA-256 of its inputs put together, digests as hex text. A
tree takes every ``FANOUT`` consecutive nodes (the last run: fewer, even one) to
their H while more than one node is left; the leaves of a group give its subroot,
the subroots in the groups' order give the root.

*Partitions.* The leaves of a group are numbered in order without gathering it
(range partitions and offsets) and cut into aligned partitions of ``BLOCK``
leaves, each reduced to its subtree root in one task.

*Butterfly exchange.* Then the partitions swap subtree roots round by round. In
a round, up to ``FANOUT`` partitions meet that stand at the same place under
neighbouring nodes of one run; each brings the node above it, and all of them
hash the run, so every partition below a node knows it. A partition thus
collects the other nodes of its runs, level by level, up to the root, and
nothing is handed down a tree afterwards. Where the last node of a run has fewer partitions than
the others, its partitions also stand in at the places it lacks (``_absent``). A
meeting never holds more than ``FANOUT`` rows, whatever a group's size, and the
rounds are as many as the tree has levels. Groups of several thousand partitions
and groups of one go through the same rounds; for the rounds over the groups a
place is (group within the node, partition within the group).

Every round is written to the shared folder, so a lost executor costs no round
twice. Rows with equal order columns are ordered by their leaf; null keys come
first. An empty table has no rows and no root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from overhaul.functions.joins import split_join
from overhaul.functions.ranking import row_numbers
from overhaul.llm.common import stage

FANOUT = 16
HEIGHT = 2  # levels inside a partition
BLOCK = FANOUT ** HEIGHT


def leaf(*values: Column) -> Column:
    """H of the values: ``-`` for null, else UTF-8 byte count, ``:`` and the value."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256)


def _run(level: str, p: str) -> str:
    """SQL of the nodes of array ``level`` in the run of the node at index ``p``."""
    return f"slice({level}, cast(({p} div {FANOUT}) * {FANOUT} + 1 as int), {FANOUT})"


def _beside(run: str, at: str) -> str:
    """SQL of the nodes of an array before and after index ``at``, each as one text."""
    return (f"struct(array_join(slice({run}, 1, cast({at} as int)), '') as before, "
            f"array_join(slice({run}, cast({at} as int) + 2, {FANOUT}), '') as after)")


def _levels_needed(count: str, most: int) -> str:
    """SQL of the levels of a tree over ``count`` nodes, ``most`` at most."""
    return " + ".join(f"if({count} > {FANOUT ** k}, 1, 0)" for k in range(most))


def _partitions(leaves: DataFrame, group: str, order: list[str]) -> DataFrame:
    """One row a partition: group, rank of the group, its partition count, index, leaf rows, levels of nodes."""
    numbered = row_numbers(leaves, [group, *order, "leaf"], "_row")
    groups = numbered.groupBy(group).agg(F.min("_row").alias("_first"), F.count("*").alias("_count"))
    groups = row_numbers(groups, [group], "_rank").select(
        group, "_first", "_count", F.col("_rank").alias("rank"))
    placed = split_join(numbered, groups, [group]).withColumn("_place", F.col("_row") - F.col("_first"))
    carried = [c for c in leaves.columns if c != group]
    parts = placed.groupBy("rank", F.expr(f"_place div {BLOCK}").alias("part")).agg(
        F.first(group).alias(group), F.first("_count").alias("_count"),
        F.sort_array(F.collect_list(F.struct("_place", F.struct(*carried).alias("row")))).alias("rows"))
    levels = ["transform(rows, x -> x.row.leaf)"]
    parts = parts.withColumns({"height": F.expr(_levels_needed("_count", HEIGHT)), "level0": F.expr(levels[0])})
    for k in range(HEIGHT):
        up = (f"transform(sequence(0, (size(level{k}) - 1) div {FANOUT}), "
              f"j -> sha2(array_join(slice(level{k}, j * {FANOUT} + 1, {FANOUT}), ''), 256))")
        parts = parts.withColumn(f"level{k + 1}", F.expr(f"if(height > {k}, {up}, level{k})"))
    return parts.withColumn("parts", F.ceil(F.col("_count") / BLOCK).cast("long"))


def _absent(rows: DataFrame, width: str, at: str, low: str, span: int) -> DataFrame:
    """Rows that stand in for the places that the last node of its level lacks, if its run has other nodes.

    ``width`` counts what lies below the whole level, ``span`` what lies below a full node; ``low`` is the place.
    """
    last = f"({width} - 1) div {span}"
    filled = f"({width} - ({last}) * {span})"
    return (rows.where(f"{at} = {last} and {at} % {FANOUT} > 0 and {filled} + {low} < {span}")
            .withColumn(low, F.expr(f"explode(sequence({low} + {filled}, {span} - 1, {filled}))")))


def _meet(members: DataFrame, keys: list[str]) -> DataFrame:
    """One round: members (keys, at, node, and ``state``, null if only standing in) with the next node and path."""
    met = members.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("at", "node", "state"))).alias("met"))
    met = met.withColumn("nodes", F.expr("transform(met, x -> x.node)")).select(
        F.expr("sha2(array_join(nodes, ''), 256)").alias("parent"), "nodes", F.posexplode("met").alias("at", "me"))
    step = F.expr(_beside("nodes", "at"))
    return (met.where("me.state is not null").select("me.state.*", "parent", step.alias("step"))
            .withColumns({"path": F.array_append("path", F.col("step")), "node": F.col("parent")}).drop("parent", "step"))


STATE = ["rank", "part", "parts", "groups", "node", "subroot", "path"]


def _group_rounds(state: DataFrame) -> DataFrame:
    """Swap roots inside each group until every partition knows its group's subroot."""
    most = state.agg(F.max("parts")).first()[0] or 0
    span = 1
    while span < most:
        rows = state.withColumns({"at": F.expr(f"part div {span}"), "low": F.expr(f"part % {span}")})
        busy = rows.where(f"parts > {span}")
        members = busy.withColumn("state", F.struct(*STATE)).unionByName(
            _absent(busy, "parts", "at", "low", span).withColumn("state", F.lit(None)), allowMissingColumns=True)
        members = members.withColumn("run", F.expr(f"at div {FANOUT}"))
        state = stage(_meet(members, ["rank", "run", "low"]).unionByName(rows.where(f"parts <= {span}").select(STATE)), "merkle")
        span *= FANOUT
    return state.withColumn("subroot", F.col("node"))


def _top_rounds(state: DataFrame, groups: int) -> DataFrame:
    """Swap subroots between groups until every partition knows the root."""
    span = 1
    while span < groups:
        place = {"at": F.expr(f"rank div {span}"), "low": F.expr(f"rank % {span}")}
        rows = state.withColumns(place)
        # A group's partitions 0, 1, ... meet those of the same number; where the run has groups with
        # more partitions, rows derived from partition 0 stand in for the numbers that it lacks.
        firsts = rows.where("part = 0").select("groups", "at", "low", "node", F.col("parts").alias("has"))
        firsts = firsts.unionByName(_absent(firsts, "groups", "at", "low", span).withColumn("has", F.lit(0).cast("long")))
        most = (firsts.withColumn("run", F.expr(f"at div {FANOUT}")).groupBy("run", "low")
                .agg(F.max("has").alias("most"), F.collect_list(F.struct("at", "node", "has")).alias("of")))
        stand_in = (most.select("run", "low", "most", F.inline("of")).where("has < most")
                    .select("run", "low", "at", "node", F.explode(F.sequence("has", F.col("most") - 1)).alias("part")))
        members = rows.select(F.expr(f"at div {FANOUT}").alias("run"), "low", "at", "node", "part", F.struct(*STATE).alias("state"))
        members = members.unionByName(stand_in.withColumn("state", F.lit(None)))
        state = stage(_meet(members, ["run", "low", "part"]), "merkle")
        span *= FANOUT
    return state.withColumn("root", F.col("node"))


def prove(leaves: DataFrame, group: str, order: list[str]) -> DataFrame:
    """The rows of ``leaves`` (with a column ``leaf``) and each row's subroot, root and path.

    ``path`` has for each level, from the leaf up to the root, the digests before and after the row's own node in
    its run. All columns of ``leaves`` come out; none may be named like those or begin with an underscore.
    """
    parts = stage(_partitions(stage(leaves, "leaves"), group, order), "parts")
    groups = parts.where("part = 0").count()
    path = "cast(array() as array<struct<before: string, after: string>>)"
    state = parts.select("rank", "part", "parts", F.lit(groups).cast("long").alias("groups"),
                         F.expr(f"level{HEIGHT}[0]").alias("node"), F.lit(None).cast("string").alias("subroot"), F.expr(path).alias("path"))
    proofs = _top_rounds(_group_rounds(state), groups).select("rank", "part", "subroot", "root", F.col("path").alias("above"))
    rows = parts.join(proofs, ["rank", "part"]).select(
        group, "height", *(f"level{k}" for k in range(HEIGHT)), "subroot", "root", "above", F.posexplode("rows").alias("at", "me"))
    own = [f"if(height > {k}, array({_beside(_run(f'level{k}', f'(at div {FANOUT ** k})'), f'(at div {FANOUT ** k}) % {FANOUT}')}), "
           f"{path})" for k in range(HEIGHT)]
    return rows.select(*(F.col(group) if c == group else F.col(f"me.row.{c}").alias(c) for c in leaves.columns),
                       "subroot", "root", F.expr(f"concat({', '.join(own)}, above)").alias("path"))


def proof_digest(path: str = "path") -> Column:
    """H of all digests of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["before"], x["after"])), ""), 256)


def fold(leaf_column: str, path: str = "path") -> Column:
    """The root that a leaf and a path lead to."""
    return F.aggregate(path, F.col(leaf_column), lambda node, x: F.sha2(F.concat(x["before"], node, x["after"]), 256))


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def with_leaves(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf, and the leaf of the row after the text's A-Z were lower-cased in every fifth
    document (by the checksum of its doc_id)."""
    texts = [F.col(c).cast("string") for c in FIELDS]
    lowered = F.translate(texts[4], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    own = docs.select("doc_id", "source", leaf(*texts).alias("leaf"),
                      F.when(F.crc32(texts[0].cast("binary")) % 5 == 0, leaf(*texts[:4], lowered)).alias("tampered"))
    return own.withColumn("held", F.coalesce("tampered", "leaf")).drop("tampered")


def _oracle() -> str:
    value = " || ".join(f"coalesce(cast(octet_length(encode(cast({c} as varchar))) as varchar) || ':' || cast({c} as varchar), '-')"
                        for c in FIELDS[:4])

    def leaf_sql(text):
        return f"sha256({value} || coalesce(cast(octet_length(encode({text})) as varchar) || ':' || {text}, '-'))"

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""with recursive bits as (
  select list(v order by i) as t from (select i, list_reduce(list_prepend(cast(i as ubigint), cast(range(8) as ubigint[])),
    lambda c, k: case when c & 1 = 1 then xor(c >> 1, cast(3988292384 as ubigint)) else c >> 1 end) as v
    from (select unnest(range(256)) as i))),
rows as (select row_number() over () as r, doc_id, source, {leaf_sql('text')} as leaf,
  case when xor(list_reduce(list_prepend(cast(4294967295 as ubigint), list_transform(range(1, length(cast(doc_id as varchar)) + 1),
      lambda k: cast(ascii(cast(doc_id as varchar)[k]) as ubigint))),
      lambda c, b: xor(t[cast((xor(c, b) & 255) + 1 as bigint)], c >> 8)), cast(4294967295 as ubigint)) % 5 = 0
    then {leaf_sql(lower)} else {leaf_sql('text')} end as held
  from documents, bits),
placed as (select *, dense_rank() over (order by source nulls first) as tree,
  row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as spot from rows),
low(tree, level, spot, node, n) as (
  select tree, 0, spot, leaf, count(*) over (partition by tree) from placed
  union all
  select tree, level + 1, spot // 16, sha256(string_agg(node, '' order by spot)), (any_value(n) + 15) // 16
  from low where n > 1 group by tree, level, spot // 16),
subroots as (select tree, node, max(level) over () as levels, level from low where n = 1),
high(level, spot, node, n) as (
  select 0, tree - 1, node, count(*) over () from subroots
  union all
  select level + 1, spot // 16, sha256(string_agg(node, '' order by spot)), (any_value(n) + 15) // 16
  from high where n > 1 group by level, spot // 16),
steps as (
  select p.r, l.level, l.spot // cast(1 as bigint) as spot, l.node, l.spot = p.spot // cast(pow(16, l.level) as bigint) as own
  from placed p join low l on l.tree = p.tree and l.n > 1 and l.spot // 16 = p.spot // cast(pow(16, l.level + 1) as bigint)
  union all
  select p.r, 100 + h.level, h.spot, h.node, h.spot = (p.tree - 1) // cast(pow(16, h.level) as bigint)
  from placed p join high h on h.n > 1 and h.spot // 16 = (p.tree - 1) // cast(pow(16, h.level + 1) as bigint)),
proofs as (select r, sha256(coalesce(string_agg(t.node, '' order by t.level, t.spot) filter (not t.own), '')) as proof_sha256
  from placed p left join steps t using (r) group by r),
sides as (select r, row_number() over (partition by r order by level) as nr, before, after from (
  select r, level, coalesce(string_agg(node, '' order by spot) filter (spot < me), '') as before,
    coalesce(string_agg(node, '' order by spot) filter (spot > me), '') as after
  from (select *, max(spot) filter (own) over (partition by r, level) as me from steps) group by r, level)),
folded(r, nr, node) as (
  select r, 0, held from placed
  union all
  select f.r, f.nr + 1, sha256(s.before || f.node || s.after) from folded f join sides s on s.r = f.r and s.nr = f.nr + 1)
select p.doc_id, p.leaf, s.node as subroot, h.node as root, q.proof_sha256, f.node as folded_root, f.node = h.node as verified
from placed p join subroots s using (tree) join proofs q using (r)
  join (select r, max_by(node, nr) as node from folded group by r) f using (r), (select node from high where n = 1) h"""


ORACLE = _oracle()
