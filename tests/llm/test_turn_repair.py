import random
import re

from oracle import check
from pyspark.sql import functions as F

from gridlens.llm import queries
from gridlens.llm import turn_repair as R


def all_edits(rows):
    """The best of all lists of edits with at most two inserts in a row."""
    best = None

    def go(i, roles, cost, audit, inserted):
        nonlocal best
        if best and cost > best[0]:
            return
        if 2 * i == len(rows) and re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
            best = cost, audit
        if 2 * i < len(rows):
            role, fault = rows[2 * i], rows[2 * i + 1]
            go(i + 1, roles, cost + 2, audit + "D", 0)
            if fault in "-t":
                cut = 5 * (fault == "t")
                go(i + 1, roles + role, cost + cut, audit + "K", 0)
                for r in "ua":
                    go(i + 1, roles + r, cost + cut + 1, audit + "R", 0)
        if inserted < 2:
            for r in "ua":
                go(i, roles + r, cost + 5, audit + "I", inserted + 1)

    go(0, "", 0, "", 0)
    return best


def row_by_row(rows):
    """Dynamic programming over rows."""
    def inserted(now):
        for _ in range(3):
            for state, (cost, audit) in list(now.items()):
                to, one = (3 if state == 2 else 2), (cost + 5, audit + "I")
                if to not in now or one < now[to]:
                    now[to] = one
        return now

    now = {0: (0, "")}
    for i in range(0, len(rows), 2):
        role, fault, after = rows[i], rows[i + 1], {}
        for state, (cost, audit) in inserted(now).items():
            moves, cut, to = [("D", state, 2)], 5 * (fault == "t"), 3 if state == 2 else 2
            if fault in "-t":
                moves.append(("R", to, cut + 1))
                if role == ("a" if state == 2 else "u"):
                    moves.append(("K", to, cut))
                if role == "s" and state == 0:
                    moves.append(("K", 1, cut))
            for letter, nxt, paid in moves:
                one = cost + paid, audit + letter
                if nxt not in after or one < after[nxt]:
                    after[nxt] = one
        now = after
    return min(v for s, v in inserted(now).items() if s in (0, 3))


def test_search_against_all_edits():
    rng = random.Random(5)
    for _ in range(120):
        rows = "".join(rng.choice("suax") + rng.choice("---bdt") for _ in range(rng.randint(0, 4)))
        assert R.cheapest_edits(rows) == all_edits(rows) == row_by_row(rows)


def test_search_against_dynamic_programming():
    rng = random.Random(6)
    for _ in range(3000):
        roles = rng.choice(["suax", "ua", "uuua", "sua", "s", "a", "sssua"])
        rows = "".join(rng.choice(roles) + rng.choice("----bdtt") for _ in range(rng.randint(0, 40)))
        assert R.cheapest_edits(rows) == row_by_row(rows), rows
    for roles, faults in (("ua", "--t"), ("s", "-t"), ("suax", "-bdt"), ("u", "-"), ("a", "b")):
        rows = "".join(rng.choice(roles) + rng.choice(faults) for _ in range(5000))
        assert R.cheapest_edits(rows) == row_by_row(rows)


def test_conversations_against_sql(spark, data):
    check(queries.QUERIES["op13_turn_repair"](spark, data), queries.ORACLE_SQL["op13_turn_repair"], data)


def test_odd_conversations(spark, tmp_path):
    rows = [
        (1, 0, "system", "Be kind."), (1, 1, "user", "Why?"), (1, 2, "assistant", "So."),
        (2, 0, "assistant", "First."), (2, 3, "user", "Cut"), (2, 3, "user", "Cut"), (2, None, "tool", "Odd."),
        (3, 0, None, None), (3, 1, "user", " \t\x0b"), (None, 0, "user", "Lone."), (None, None, None, "x"),
        (4, 0, "", "No role."), (5, 0, "system", "Alone."),
    ]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "conv_id long, turn long, role string, text string, fault string, nth int")
    got = {r.conv_id: r for r in R.repair_conversations(df).collect()}
    assert len(got) == 6
    assert (got[1].audit, got[1].cost) == ("KKK", 0)
    assert [x.fault for x in got[2].turns] == ["-", "-", "t", "d"]  # the row without turn comes first
    assert (got[2].audit, got[2].cost) == ("RKDD", 5) and [(x.role, x.text) for x in got[2].repaired] == [("user", "Odd."), ("assistant", "First.")]
    assert got[3].audit == "DD" and got[3].repaired == [] and [x.fault for x in got[3].turns] == ["b", "b"]
    assert [x.text for x in got[None].turns] == ["x", "Lone."] and got[None].audit == "DD"
    assert got[4].audit == "D" and got[5].audit == "D"
    assert R.repair_conversations(df.where("conv_id = 99")).count() == 0
    gone = {r.conv_id: r for r in R.repair_conversations(df, F.col("conv_id") != 1).collect()}
    assert gone[1].turns == [] and gone[1].audit == "" and gone[1].cost == 0
    # the query itself, on these rows and many more of one conversation
    more = [(7, k, ("user", "assistant", "system")[k * k % 3], f"Number {k // 2}" + ".!?"[k % 3] * (k % 5 > 0), "z", 1) for k in range(600)]
    df.unionByName(spark.createDataFrame(more, df.schema)).write.parquet(f"{tmp_path}/conversations.parquet")
    folder = tmp_path / "flat"
    folder.mkdir()
    import pyarrow.parquet as pq

    pq.write_table(pq.read_table(f"{tmp_path}/conversations.parquet"), f"{folder}/conversations.parquet")
    check(queries.QUERIES["op13_turn_repair"](spark, str(folder)), queries.ORACLE_SQL["op13_turn_repair"], folder)
