"""Conversation structure repair: the cheapest edits that give a conversation of roles ``(s?(ua)+)?``.

A row's first fault counts: blank (no character but ASCII white space), duplicate (role and text stood earlier in the
conversation) or truncated (its last such character isn't ``.``, ``!`` or ``?``). Edits and their costs: Keep 0, Rerole
to user or assistant 1, Delete 2 (a blank or duplicate row has to be deleted), Insert an empty user or assistant turn
anywhere 5; a truncated row that isn't deleted costs 5 more. Of the cheapest lists of edits the one whose initials come
first in ASCII order is taken; that list fixes the repaired turns.

Edits are found by depth-first branch and bound, see :func:`cheapest_edits`. Spark finds the faults and deals the
conversations out in one shuffle; only the search and its edits are Python.

Cases: a null role or text counts as one blank; rows sort by turn, nulls first, then by role and text, so that repeated
rows are one after the other; a role counts by its first character, and an empty one can't be kept; a null id is a
conversation of its own; a conversation of one long row or of very many rows is dealt with whole (its turns meet in one
task, as the search and the result go along it); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import table, tidy

WHITE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
#: What has been put out: nothing, only a system turn, a user turn last, an assistant turn last.
NOTHING, SYSTEM, ASKED, ANSWERED = range(4)
ENDS = (NOTHING, ANSWERED)


def _bounds(rows: str) -> list[tuple[int, int, int]]:
    """For each number of rows dealt with and state nothing, asked or answered: what the others cost at least.

    A relaxation: after a system turn all goes on as after an answer, so that nothing else has to follow it.
    """
    n = len(rows) // 2
    bound = [(0, INSERT, 0)] * (n + 1)
    for i in range(n - 1, -1, -1):
        role, fault = rows[2 * i], rows[2 * i + 1]
        nothing, asked, answered = bound[i + 1]
        now = [nothing + DELETE, asked + DELETE, answered + DELETE]
        if fault in "-t":
            cut = CUT if fault == "t" else 0
            now[1] = min(now[1], answered + cut + (KEEP if role == "a" else REROLE))
            now[2] = min(now[2], asked + cut + (KEEP if role == "u" else REROLE))
            if role == "s":
                now[0] = min(now[0], answered + cut + KEEP)
        asked, answered = min(now[1], now[2] + INSERT), min(now[2], now[1] + INSERT)
        bound[i] = min(now[0], answered), asked, answered
    return bound


def cheapest_edits(rows: str) -> tuple[int, str]:
    """(cost, initials of the edits) for ``rows``, two characters each: the role's initial and the fault, of ``-bdt``.

    A node is a prefix of edits: rows dealt with, state of the roles put out, cost, and its parent. Nodes wait on an
    explicit stack, the most promising child on top. A node goes if its cost with the bound of the rows left is over the
    incumbent's, or equal with later initials; or if the dominance table has a prefix of lower cost, or of the same cost
    and earlier initials, for its rows and state: whatever follows fits both, and of two prefixes of one cost none begins
    with the other, as inserts cost. With the stack empty the incumbent is proved.
    """
    n = len(rows) // 2
    bounds = _bounds(rows)
    bound = lambda i, state: bounds[i][max(0, state - 1) if state != SYSTEM else 2]
    parents, letters, depths = [-1], [""], [0]  # by node

    def earlier(x: int, y: int) -> bool:
        """Whether the initials of node ``x`` come before those of ``y``; a common beginning alone says no."""
        a = b = ""
        while depths[x] > depths[y]:
            x = parents[x]
        while depths[y] > depths[x]:
            y = parents[y]
        while x != y:
            a, b = letters[x], letters[y]
            x, y = parents[x], parents[y]
        return a < b

    best = -1  # the incumbent's cost
    trail: list[int] = []  # and its nodes

    def behind(node: int) -> bool:
        """Whether the incumbent's initials come before those of ``node``."""
        letter = ""
        while depths[node] >= len(trail) or trail[depths[node]] != node:
            letter = letters[node]
            node = parents[node]
        at = depths[node] + 1
        return letter != "" and (at == len(trail) or letters[trail[at]] < letter)

    table: dict[tuple[int, int], tuple[int, int]] = {(0, NOTHING): (0, 0)}
    stack = [(bound(0, NOTHING), 0, NOTHING, 0, 0)]  # bound with cost, rows, state, cost, node
    while stack:
        least, i, state, cost, node = stack.pop()
        if table[i, state][1] != node or best >= 0 and (least > best or least == best and behind(node)):
            continue
        if i == n and state in ENDS:
            best, trail = cost, [node]
            while trail[-1]:
                trail.append(parents[trail[-1]])
            trail.reverse()
        to = ANSWERED if state == ASKED else ASKED
        moves = [("I", i, to, cost + INSERT)]  # initial, rows, state, cost
        if i < n:
            role, fault = rows[2 * i], rows[2 * i + 1]
            moves.append(("D", i + 1, state, cost + DELETE))
            if fault in "-t":
                cut = cost + (CUT if fault == "t" else 0)
                moves.append(("R", i + 1, to, cut + REROLE))
                if role == ("a" if to == ANSWERED else "u"):
                    moves.append(("K", i + 1, to, cut + KEEP))
                elif role == "s" and state == NOTHING:
                    moves.append(("K", i + 1, SYSTEM, cut + KEEP))
        fresh = []
        for letter, j, state, paid in moves:
            under = paid + bound(j, state)
            if 0 <= best < under:
                continue
            made = len(parents)
            parents.append(node)
            letters.append(letter)
            depths.append(depths[node] + 1)
            known = table.get((j, state))
            if known and (known[0] < paid or known[0] == paid and not earlier(made, known[1])):
                continue
            table[j, state] = paid, made
            fresh.append((under, letter, j, state, paid, made))
        stack += [(under, *rest) for under, _, *rest in sorted(fresh, reverse=True)]
    return best, "".join(letters[k] for k in trail)


def repaired(turns: list[dict], audit: str) -> list[dict]:
    """Roles and texts after the edits that ``audit`` names."""
    out: list[dict] = []
    rows = iter(turns)
    for e in audit:
        row = {"role": "", "text": ""} if e == "I" else next(rows)
        if e == "D":
            continue
        asked = bool(out) and out[-1]["role"][0] == "u"
        out.append({"role": row["role"] if e == "K" else "assistant" if asked else "user", "text": row["text"]})
    return out


def fault(text: Column, again: Column) -> Column:
    """``b`` blank, ``d`` duplicate, ``t`` truncated, else ``-``."""
    last = F.substring(F.rtrim(text, F.lit(WHITE)), -1, 1)
    return F.when(last == "", "b").when(again, "d").when(~last.isin(".", "!", "?"), "t").otherwise("-")


def with_faults(turns: DataFrame, present: Column | None = None) -> DataFrame:
    """One row a conversation: ``conv_id`` and ``turns``: array<struct<turn, role, text, fault>> in order. A conversation
    none of whose rows is ``present`` has no turns."""
    text = lambda c: F.coalesce(c, F.lit(" ")).alias(c)
    rows = turns.select("conv_id", "turn", text("role"), text("text"), (F.lit(True) if present is None else present).alias("present"))
    # one shuffle for both: what is dealt out by conversation needs no other for its parts
    same = W.partitionBy("conv_id", "present", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    judged = rows.repartition(F.col("conv_id")).withColumn("nth", F.row_number().over(same)).withColumn("fault", fault(F.col("text"), F.col("nth") > 1))
    one = F.when(F.col("present"), F.struct("turn", "role", "text", "nth", "fault"))
    ordered = F.array_sort(F.collect_list(one))
    return judged.groupBy("conv_id").agg(F.transform(ordered, lambda r: F.struct(*[r[c].alias(c) for c in ("turn", "role", "text", "fault")])).alias("turns"))


def repair_conversations(turns: DataFrame, present: Column | None = None) -> DataFrame:
    """``conv_id``, ``turns`` as :func:`with_faults`, ``cost``, ``audit``, ``repaired``: array<struct<role, text>>."""
    found = with_faults(turns, present)
    one = T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    schema = T.StructType([*found.schema.fields, T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType()), T.StructField("repaired", T.ArrayType(one))])
    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, str]] = {}  # short conversations are much alike
        for b in batches:
            costs, audits, texts = [], [], []
            for rows in b.column(1).to_pylist():
                code = "".join((r["role"][:1] or " ") + r["fault"] for r in rows)
                if code not in known:
                    if len(known) > 10_000:
                        known.clear()
                    known[code] = cheapest_edits(code)
                cost, audit = known[code]
                costs.append(cost)
                audits.append(audit)
                texts.append(repaired(rows, audit))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(costs, pa.int64()), pa.array(audits, pa.string()), pa.array(texts, kind)], names=schema.fieldNames())

    return found.mapInArrow(tidy(run), schema)


def damaged(turns: DataFrame) -> DataFrame:
    """The turns with planted faults, by a checksum of conversation and turn; ``present`` is false for those left out."""
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = turns.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")], (F.crc32(name.cast("binary")) % 20).alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    out = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") != 0).alias("present"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("times"))
    return out.withColumn("nth", F.explode(F.sequence(F.lit(1), "times"))).drop("times", "nth")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repair_conversations(damaged(table(spark, sf_dir, "conversations")), F.col("present"))
    numbers = F.filter(F.transform("turns", lambda r: r["turn"]), lambda t: t.isNotNull())
    gaps = F.coalesce(F.array_max(numbers) - F.array_min(numbers) + 1 - F.size(F.array_distinct(numbers)), F.lit(0))
    count = lambda fault: F.size(F.filter("turns", lambda r: r["fault"] == fault)).cast("long")
    heads = F.transform("turns", lambda r: F.substring(r["role"], 1, 1))
    pairs = F.zip_with(F.col("heads"), F.slice("heads", 2, F.greatest(F.size("heads") - 1, F.lit(0))), lambda a, b: F.concat(a, b))
    illegal = F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au"))).cast("long")
    lines = F.array_join(F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    return found.withColumn("heads", heads).select(
        "conv_id",
        gaps.cast("long").alias("gaps"),
        count("b").alias("blank"),
        count("d").alias("duplicate"),
        count("t").alias("truncated"),
        illegal.alias("illegal"),
        "cost",
        "audit",
        F.sha2(lines, 256).alias("repaired_sha256"),
    )


#: Damage and faults by plain SQL; edits by dynamic programming over rows in place of the search.
OP13_SQL = r"""
WITH RECURSIVE named AS (
  SELECT row_number() OVER () AS k, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations
), kinds AS (
  SELECT conv_id, turn, role, text,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(name, ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda x, b: list_reduce(list_prepend(xor(x, b), range(8)), lambda y, k: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)), 4294967295) % 20 AS kind
  FROM named
), hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM kinds, unnest(CASE kind WHEN 3 THEN [1, 2] ELSE [1] END) WHERE kind <> 0
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i FROM hurt
), seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, right(regexp_replace(text, '[\x20\x09-\x0D]+$', ''), 1) AS last_one
  FROM numbered
), faulty AS (
  SELECT *, CASE WHEN last_one = '' THEN 'b' WHEN again THEN 'd' WHEN last_one NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS fault,
    left(role, 1) AS head, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS head_before FROM seen
), counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (i > 0 AND head_before || head NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id
), ids AS (SELECT DISTINCT conv_id FROM conversations),
-- states: 0 nothing yet, 1 system, 2 user last, 3 assistant last; cost and initials in one string that sorts like both
inserts(state, nxt, cost, initials) AS (VALUES (0, 0, 0, ''), (0, 2, 5, 'I'), (0, 3, 10, 'II'), (1, 1, 0, ''), (1, 2, 5, 'I'), (1, 3, 10, 'II'), (2, 2, 0, ''), (2, 3, 5, 'I'), (3, 3, 0, ''), (3, 2, 5, 'I')),
moves(letter, state, head, nxt, cost) AS (VALUES
  ('D', 0, NULL, 0, 2), ('D', 1, NULL, 1, 2), ('D', 2, NULL, 2, 2), ('D', 3, NULL, 3, 2),
  ('R', 0, NULL, 2, 1), ('R', 1, NULL, 2, 1), ('R', 2, NULL, 3, 1), ('R', 3, NULL, 2, 1),
  ('K', 0, 's', 1, 0), ('K', 0, 'u', 2, 0), ('K', 1, 'u', 2, 0), ('K', 2, 'a', 3, 0), ('K', 3, 'u', 2, 0)),
walked AS (
  SELECT conv_id, n, 0 AS i, 0 AS state, lpad('0', 9, '0') AS best FROM counted
  UNION ALL
  SELECT w.conv_id, w.n, w.i + 1, m.nxt,
    min(lpad(CAST(CAST(left(w.best, 9) AS BIGINT) + s.cost + m.cost + CASE WHEN f.fault = 't' AND m.letter <> 'D' THEN 5 ELSE 0 END AS VARCHAR), 9, '0') || substr(w.best, 10) || s.initials || m.letter)
  FROM walked w JOIN inserts s ON s.state = w.state
    JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i
    JOIN moves m ON m.state = s.nxt AND (m.head IS NULL OR m.head = f.head) AND (m.letter = 'D' OR f.fault IN ('-', 't'))
  WHERE w.i < w.n GROUP BY w.conv_id, w.n, w.i, m.nxt
), ended AS (
  SELECT conv_id, min(lpad(CAST(CAST(left(best, 9) AS BIGINT) + cost AS VARCHAR), 9, '0') || substr(best, 10) || initials) AS best
  FROM walked JOIN inserts USING (state) WHERE i = n AND nxt IN (0, 3) GROUP BY conv_id
), edits AS (
  SELECT conv_id, p, substr(best, 9 + p, 1) AS letter FROM ended, unnest(range(1, length(best) - 8)) AS u(p)
), placed AS (
  SELECT *, count(*) FILTER (letter <> 'I') OVER w - 1 AS i, count(*) FILTER (letter <> 'D') OVER w AS o FROM edits
  WINDOW w AS (PARTITION BY conv_id ORDER BY p)
), turned AS (
  SELECT e.conv_id, e.p, e.o, e.letter, f.role, f.text,
    bool_or(e.letter = 'K' AND f.head = 's') OVER (PARTITION BY e.conv_id) AS led
  FROM placed e LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.i = e.i AND e.letter <> 'I' WHERE e.letter <> 'D'
), whole AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (o + CAST(led AS INTEGER)) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY p) AS lines
  FROM turned GROUP BY conv_id
)
SELECT ids.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(coalesce(left(best, 9), '0') AS BIGINT) AS cost, coalesce(substr(best, 10), '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM ids LEFT JOIN counted ON counted.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN ended ON ended.conv_id IS NOT DISTINCT FROM ids.conv_id
  LEFT JOIN whole ON whole.conv_id IS NOT DISTINCT FROM ids.conv_id
"""
