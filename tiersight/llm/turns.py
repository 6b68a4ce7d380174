"""Repair of conversation structure: faults, cheapest edits by signature, and their replay.

A conversation's roles and faults are one letter a row. Rows are sorted across the cluster and cut into
stretches of at most `STRETCH` rows of one conversation, so that a conversation of any length is many
stretches; each distinct stretch is solved once for each state it may begin and end in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiersight.operators.staging import stage

#: Rows of a stretch.
STRETCH = 256
#: States after a sequence of initials: nothing yet, a system row, a user row, an assistant row. Rows may end in the first and the last.
NONE, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (NONE, ASSISTANT)
#: What a user or an assistant row leads to; a system row only leads from the first state to the second.
AFTER = {NONE: (USER, "u"), SYSTEM: (USER, "u"), ASSISTANT: (USER, "u"), USER: (ASSISTANT, "a")}
REROLE, DELETE, INSERT, LEFT_TRUNCATED = 2, 3, 2, 1


def damage(turns: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) with faults put in by a checksum of `conv_id:turn`; nulls become one space."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    rows = turns.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    twice = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), twice.alias("copy")).drop("copy")


class Way(NamedTuple):
    """The cheapest edits of a stretch from one state to another: per row its edits' initials, and the roles they leave."""

    cost: int
    edits: tuple[str, ...]
    roles: tuple[str, ...]


def solve(signature: str) -> dict[tuple[int, int], Way]:
    """The ways through a stretch by (state before, state after).

    A signature has a letter a row: x for a row that must go, else the role's initial (s, u, a, or o for
    any other), a capital if the text is truncated. It begins with ^ where the conversation does, and
    ends with $ where it does; then the way to the better end is given, under a state after of -1.
    Of equally cheap ways the one whose edits' initials come first in ASCII is taken.
    """
    rows = signature.strip("^$")
    opening, closing = signature.startswith("^"), signature.endswith("$")

    @lru_cache(maxsize=None)
    def from_row(i: int, state: int, goal: int) -> tuple[int, str, Way] | None:
        """Cost and initials of what is left from row i on, and the way itself."""
        found = []
        here, cost, put, roles = state, 0, "", ""
        for _ in range(3):  # two inserted rows lead back to where they began, or to an end
            if i == len(rows):
                if here == goal or goal < 0 and here in ENDS:
                    found.append((cost, put, Way(cost, (put,), (roles,))))
            else:
                row, late = rows[i].lower(), LEFT_TRUNCATED * rows[i].isupper()
                next_state, role = AFTER[here]
                options = [("D", here, DELETE, "-")]
                if row != "x":
                    options.append(("R", next_state, REROLE + late, role))
                    if row == role:
                        options.append(("K", next_state, late, row))
                    if row == "s" and here == NONE:
                        options.append(("K", SYSTEM, late, row))
                for edit, then, price, left in options:
                    if rest := from_row(i + 1, then, goal):
                        found.append((cost + price + rest[0], put + edit + rest[1], Way(cost + price + rest[0], (put + edit, *rest[2].edits), (roles + left, *rest[2].roles))))
            if i == len(rows) and not closing:
                break  # rows are inserted before rows, or at the very end
            here, role = AFTER[here]
            cost, put, roles = cost + INSERT, put + "I", roles + role
        return min(found, key=lambda x: x[:2], default=None)

    ways = {}
    for start in (NONE,) if opening else range(4):
        for goal in (-1,) if closing else range(4):
            if best := from_row(0, start, goal):
                *edits, last = best[2].edits
                *roles, left = best[2].roles
                edits[-1], roles[-1] = edits[-1] + last, roles[-1] + left
                ways[start, goal] = Way(best[0], tuple(edits), tuple(roles))
    from_row.cache_clear()
    return ways


def _numbered(rows: DataFrame) -> DataFrame:
    """Sorted rows with the number of their stretch and their place in it; numbers rise with the order."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretch, place, last = TaskContext.get().partitionId() << 40, 0, object()
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column("conv_id")
            filled, null = conv.fill_null(0).to_numpy(), conv.is_null().to_numpy(zero_copy_only=False)
            fresh = np.append(last != (filled[0], null[0]), (filled[1:] != filled[:-1]) | (null[1:] != null[:-1]))
            last = (filled[-1], null[-1])
            at = np.arange(batch.num_rows)
            begun = np.maximum.accumulate(np.where(fresh, at, -1))
            own = np.where(begun < 0, at + place, at - begun)  # rows of the conversation before, here or in the batch before
            # a stretch begins with its conversation and after every STRETCH rows
            begins = (own % STRETCH == 0).cumsum()
            numbers = stretch + begins
            stretch, place = int(numbers[-1]), int(own[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers), pa.array((own % STRETCH).astype(np.int32))], [*batch.schema.names, "stretch", "place"])

    return rows.mapInArrow(each, f"{', '.join(f'{c} {t}' for c, t in rows.dtypes)}, stretch long, place int")


def _ways(signatures: DataFrame) -> DataFrame:
    """(signature, before, after, cost, edits, roles, order) of distinct signatures; order is that of a signature's edits in ASCII."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for signature in batch.column(0).to_pylist():
                ways = solve(signature)
                orders = {x: k for k, x in enumerate(sorted({"".join(w.edits) for w in ways.values()}))}
                rows = [(signature, *states, w.cost, list(w.edits), list(w.roles), orders["".join(w.edits)]) for states, w in ways.items()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    names = ["signature", "before", "after", "cost", "edits", "roles", "order"]
    types = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.int32()]
    return signatures.mapInArrow(each, "signature string, before int, after int, cost long, edits array<string>, roles array<string>, order int")


def _route(rows: pd.DataFrame) -> pd.DataFrame:
    """The cheapest states through all stretches of a conversation, from their ways' costs and orders."""
    rows = rows.sort_values(["stretch", "before", "after"])
    stretches, edges = np.unique(rows["stretch"].to_numpy(), return_index=True)
    table = rows[["before", "after", "cost", "order"]].to_numpy().tolist()
    edges, ahead, choices = [*edges.tolist(), len(table)], {-1: 0}, []
    for lo, hi in zip(reversed(edges[:-1]), reversed(edges[1:])):
        best: dict[int, tuple] = {}
        for before, after, cost, order in table[lo:hi]:
            if after in ahead:
                best[before] = min(best.get(before, (float("inf"),)), (cost + ahead[after], order, after))
        ahead = {k: v[0] for k, v in best.items()}
        choices.append({k: v[2] for k, v in best.items()})
    state, out = NONE, []
    for stretch, choice in zip(stretches.tolist(), reversed(choices)):
        out.append((stretch, state, choice[state]))
        state = choice[state]
    return pd.DataFrame(out, columns=["stretch", "before", "after"])


class Repaired(NamedTuple):
    """audits: a row for each conversation; rows: the repaired conversations, to be sorted by (conv_id, stretch, place, step)."""

    audits: DataFrame
    rows: DataFrame


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def repair(turns: DataFrame) -> Repaired:
    """Repair conversations (conv_id, turn, role, text) so that their roles' initials read `(s?(ua)+)?`, at the least cost.

    Rows are taken by turn, nulls first, then by role, the text's first 200 characters and a SHA-256 of
    both; rows alike in all are interchangeable. Null roles and texts are one space; a null conv_id is a
    conversation. A row's first fault counts: blank (nothing but white space), duplicate (its role and
    text came earlier in the conversation), truncated (the last character that isn't white space is
    none of `.!?`). An empty role has no initial and is as illegal as any unknown one.
    Edits: Keep 0, Rerole to user or assistant 2, Delete 3 (a must for blank and duplicate rows), Insert
    an empty user or assistant row 2; a truncated row that stays costs 1 more. audits: conv_id, gaps
    (turns missing between the first and the last), blank, duplicate, truncated, illegal (neighbours
    other than su, ua, au), cost, audit (the edits' initials in order). rows: conv_id, stretch, place,
    step, edit, role, text. Other columns are not looked at; no rows give no rows.

    Sorting, numbering and the search for duplicates split a conversation of any length; what is
    gathered per conversation is its audit, and 16 costs for every 256 of its rows.
    """
    blank, last = F.lit(r"^[ \x09-\x0D]*$"), r"([^ \x09-\x0D])[ \x09-\x0D]*$"
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    fault = F.when(F.rlike("text", blank), "b").when(~F.regexp_extract("text", last, 1).isin(".", "!", "?"), "t").otherwise("")
    initial = F.substring("role", 1, 1)
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text", F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"), fault.alias("fault"),
        F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)).alias("key"), F.monotonically_increasing_id().alias("row"),
    )
    order = ["conv_id", "turn", "role", F.substring("text", 1, 200), "key", "row"]
    numbered = stage(_numbered(rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("row")))

    firsts = numbered.groupBy("conv_id", "key").agg(F.min(F.struct("stretch", "place")).alias("x")).select("x.*", F.lit(True).alias("is_first"))
    known = numbered.join(firsts, ["stretch", "place"], "left").select("conv_id", "turn", "stretch", "place", "initial", F.when(F.col("fault") == "b", "b").when(F.col("is_first").isNull(), "d").otherwise(F.col("fault")).alias("fault"))
    letter = F.when(F.col("fault").isin("b", "d"), "x").when(F.col("fault") == "t", F.upper("initial")).otherwise(F.col("initial"))
    count = lambda f: F.sum((F.col("fault") == f).cast("long"))
    cells = known.groupBy("conv_id", "stretch").agg(
        F.array_sort(F.collect_list(F.struct("place", letter.alias("letter"), "initial"))).alias("cells"), count("b").alias("blank"), count("d").alias("duplicate"), count("t").alias("truncated"),
    )
    initials = F.expr("transform(cells, x -> x.initial)")
    joined = F.array_join(initials, "")
    legal = lambda pair: pair.isin("su", "ua", "au")
    inner = F.size(F.filter(F.sequence(F.lit(2), F.greatest(F.size("cells"), F.lit(2))), lambda k: (k <= F.size("cells")) & ~legal(F.substring(joined, k - 1, F.lit(2)))))
    stretches = stage(cells.select("conv_id", "stretch", F.array_join(F.expr("transform(cells, x -> x.letter)"), "").alias("letters"), "blank", "duplicate", "truncated", inner.cast("long").alias("illegal"), initials[0].alias("head"), F.element_at(initials, -1).alias("tail")))

    ends = stretches.groupBy(F.col("conv_id").alias("of")).agg(F.min("stretch").alias("lo"), F.max("stretch").alias("hi"))
    in_order = Window.partitionBy("conv_id").orderBy("stretch")
    between = F.concat(F.lag("tail").over(in_order), "head")
    placed = stretches.withColumn("seam", F.coalesce((~legal(between)).cast("long"), F.lit(0)))
    placed = placed.join(ends, same(F.col("conv_id"), F.col("of"))).drop("of")
    mark = lambda end, sign: F.when(F.col("stretch") == F.col(end), sign).otherwise("")
    placed = stage(placed.withColumn("signature", F.concat(mark("lo", "^"), "letters", mark("hi", "$"))).drop("letters", "head", "tail"))
    ways = stage(_ways(placed.select("signature").distinct()))

    whole = placed.where("lo = hi").select("stretch", F.lit(NONE).alias("before"), F.lit(-1).alias("after"))
    costs = placed.where("lo < hi").select("lo", "stretch", "signature").join(ways.select("signature", "before", "after", "cost", "order"), "signature")
    routes = costs.groupBy("lo").applyInPandas(_route, "stretch long, before int, after int")
    chosen = placed.join(whole.unionAll(routes), "stretch").join(ways.drop("order"), ["signature", "before", "after"])
    chosen = stage(chosen.drop("signature", "before", "after", "lo", "hi"))

    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0).cast("long"))
    turn_sets = numbered.select("conv_id", "turn").distinct().groupBy(F.col("conv_id").alias("of")).agg(gaps.alias("gaps"))
    total = lambda c: F.sum(c).alias(c)
    steps = F.array_sort(F.collect_list(F.struct("stretch", F.array_join("edits", "").alias("edits"))))
    audits = chosen.groupBy("conv_id").agg(total("blank"), total("duplicate"), total("truncated"), F.sum(F.col("illegal") + F.col("seam")).alias("illegal"), total("cost"), steps.alias("steps"))
    audits = audits.withColumn("audit", F.array_join(F.expr("transform(steps, x -> x.edits)"), "")).join(turn_sets, same(F.col("conv_id"), F.col("of")))

    by_row = chosen.select("stretch", F.posexplode(F.arrays_zip("edits", "roles")).alias("place", "x")).select("stretch", "place", "x.*")
    edited = numbered.select("conv_id", "stretch", "place", "role", "text").join(by_row, ["stretch", "place"])
    edit, left = F.expr("substring(edits, step + 1, 1)"), F.expr("substring(roles, step + 1, 1)")
    edited = edited.withColumn("step", F.explode(F.sequence(F.lit(0), F.length("edits") - 1))).withColumn("edit", edit).where("edit <> 'D'")
    kept_role = F.when(F.col("edit") == "K", F.col("role")).when(left == "u", "user").otherwise("assistant")
    repaired = edited.select("conv_id", "stretch", "place", "step", "edit", kept_role.alias("role"), F.when(F.col("edit") == "I", "").otherwise(F.col("text")).alias("text"))
    return Repaired(audits.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"), repaired)


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of `role:text` lines joined by line feeds, in order; a stream over each conversation's rows."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], ["conv_id", "repaired_sha256"])
        current, digest = None, None
        for batch in batches:
            done = []
            for conv_id, line in zip(batch.column("conv_id").to_pylist(), batch.column("line").to_pylist()):
                if digest is None or conv_id != current:
                    if digest is not None:
                        done.append((current, digest.hexdigest()))
                    current, digest = conv_id, hashlib.sha256(line.encode())
                else:
                    digest.update(b"\n")
                    digest.update(line.encode())
            yield made(done)
        if digest is not None:
            yield made([(current, digest.hexdigest())])

    order = ["conv_id", "stretch", "place", "step"]
    lines = rows.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", F.concat("role", F.lit(":"), "text").alias("line"))
    return lines.mapInArrow(each, "conv_id long, repaired_sha256 string")


def repair_digest(original: DataFrame, turns: DataFrame) -> DataFrame:
    """Audits and digests for every conv_id of `original`; those without rows in `turns` have zeros, an empty audit and the digest of nothing."""
    repaired = repair(turns)
    of = lambda df, name: df.withColumnRenamed("conv_id", name)
    ids = original.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    out = ids.join(of(repaired.audits, "a"), same(F.col("conv_id"), F.col("a")), "left").join(of(digests(repaired.rows), "d"), same(F.col("conv_id"), F.col("d")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", *map(zero, ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))


#: The same rows by DuckDB: the checksum bit by bit, then a recursion over rows that keeps the best way to each state.
REPAIR_SQL = r"""
WITH RECURSIVE shown AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS id FROM conversations
), sums AS (
  SELECT *, xor(list_reduce(
    list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(id, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda sum, v: CASE WHEN v >= 0 THEN xor(sum, v) ELSE xor(sum >> 1, 3988292384 * (sum & 1)) END), 4294967295) % 20 AS kind
  FROM shown
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM sums WHERE kind <> 0
), sorted AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, 200), sha256(length(role)::VARCHAR || ':' || role || text), copy) AS i FROM damaged
), faults AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^ \x09-\x0D]') THEN 'b'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
      WHEN NOT regexp_matches(text, '[.!?][ \x09-\x0D]*$') THEN 't' ELSE '' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair
  FROM sorted
), counts AS (
  SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
    count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id
), puts(a, b, price, put, made) AS (
  VALUES (0, 0, 0, '', []::VARCHAR[]), (0, 2, 2, 'I', ['user:']), (0, 3, 4, 'II', ['user:', 'assistant:']), (1, 1, 0, '', []), (1, 2, 2, 'I', ['user:']), (1, 3, 4, 'II', ['user:', 'assistant:']),
    (2, 2, 0, '', []), (2, 3, 2, 'I', ['assistant:']), (2, 2, 4, 'II', ['assistant:', 'user:']), (3, 3, 0, '', []), (3, 2, 2, 'I', ['user:']), (3, 3, 4, 'II', ['user:', 'assistant:'])
), edits(a, initial, edit, b, price, role) AS (
  VALUES (0, 's', 'K', 1, 0, NULL), (0, 'u', 'K', 2, 0, NULL), (1, 'u', 'K', 2, 0, NULL), (3, 'u', 'K', 2, 0, NULL), (2, 'a', 'K', 3, 0, NULL),
    (0, NULL, 'R', 2, 2, 'user'), (1, NULL, 'R', 2, 2, 'user'), (3, NULL, 'R', 2, 2, 'user'), (2, NULL, 'R', 3, 2, 'assistant'),
    (0, NULL, 'D', 0, 3, NULL), (1, NULL, 'D', 1, 3, NULL), (2, NULL, 'D', 2, 3, NULL), (3, NULL, 'D', 3, 3, NULL)
), ways AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS state, {'cost': 0::BIGINT, 'audit': '', 'made': []::VARCHAR[]} AS best FROM counts
  UNION ALL
  SELECT w.conv_id, f.i, e.b, min({'cost': w.best.cost + p.price + e.price + CASE WHEN f.fault = 't' AND e.edit <> 'D' THEN 1 ELSE 0 END, 'audit': w.best.audit || p.put || e.edit,
    'made': w.best.made || p.made || CASE WHEN e.edit = 'D' THEN []::VARCHAR[] ELSE [coalesce(e.role, f.role) || ':' || f.text] END})
  FROM ways w JOIN puts p ON p.a = w.state JOIN faults f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1
  JOIN edits e ON e.a = p.b AND (e.initial IS NULL OR e.initial = left(f.role, 1)) AND (e.edit = 'D' OR f.fault NOT IN ('b', 'd'))
  GROUP BY w.conv_id, f.i, e.b
), done AS (
  SELECT c.conv_id, min({'cost': w.best.cost + p.price, 'audit': w.best.audit || p.put, 'made': w.best.made || p.made}) AS best
  FROM counts c JOIN ways w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.i = c.n JOIN puts p ON p.a = w.state AND p.b IN (0, 3) GROUP BY c.conv_id
)
SELECT o.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal,
  coalesce(d.best.cost, 0) AS cost, coalesce(d.best.audit, '') AS audit, sha256(coalesce(array_to_string(d.best.made, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM o.conv_id
"""
