import duckdb

from molscreen.llm import quotations as q

ROWS = [
    (1, 0, "user", "Hello there\nfriends"),
    (1, 1, "assistant", "> hello   THERE\n> friends\nHi!\n"),
    (1, 2, "user", ">> Hello there\n>> friends\n> Hi!\nOn turn 1, they wrote:\nAnd on it goes"),
    (1, 3, "user", "> > Hi!\n> And on it goes\nLast"),
    (2, 4, "user", "> Last\nfrom another conversation"),
    (2, 5, "user", "> friends\na line of a message only"),
    (3, 0, "user", "> nothing anyone wrote\nalone"),
    (3, 1, None, None),
    (4, 1, "user", "same"), (4, 1, "user", "same"), (4, 2, "user", "> same\nreply"),
    (None, 1, "user", "> same\nno key"), (5, None, "user", "Hello there"), (6, 9, "user", ""), (6, 10, "user", ">\n> \nempty quote"),
    (7, 0, "user", "> Last\ntoo early"),
]


def messages(spark):
    return spark.createDataFrame(ROWS, "conv_id bigint, turn bigint, role string, text string")


def test_passages(spark):
    got = {(r["conv_id"], r["turn"]): r for r in q.parse(messages(spark)).collect()}
    assert [tuple(p) for p in got[(1, 2)]["parts"]] == [(2, "Hello there\nfriends"), (1, "Hi!"), (0, "And on it goes")]
    assert [tuple(p) for p in got[(1, 3)]["parts"]] == [(2, "Hi!"), (1, "And on it goes"), (0, "Last")]
    assert got[(1, 1)]["body"] == "Hi!" and got[(3, 1)]["body"] == ""


def test_threads(spark):
    rows = q.threads(messages(spark)).collect()
    assert len(rows) == len(ROWS)
    got = {(r["conv_id"], r["turn"]): r for r in rows}
    link = lambda c, t: (got[(c, t)]["parent_conv"], got[(c, t)]["parent_turn"], got[(c, t)]["depth"], got[(c, t)]["position"])
    assert link(1, 0) == (None, None, 0, 0)
    assert link(1, 1) == (1, 0, 1, 1)
    assert link(1, 2) == (1, 1, 2, 3)  # behind (2, 5), which is nearer to the root
    assert link(1, 3) == (1, 2, 3, 4) and got[(1, 3)]["n_linked"] == 2
    # another conversation's message, and a single line of one
    assert link(2, 4)[:3] == (1, 3, 4)
    assert link(2, 5)[:2] == (1, 0)
    assert link(4, 2)[:3] == (4, 1, 1)
    for alone in ((3, 0), (3, 1), (None, 1), (5, None), (6, 9), (6, 10), (7, 0)):
        assert link(*alone) == (None, None, 0, 0), alone
    assert got[(2, 4)]["root_conv"] == 1 and got[(2, 4)]["root_turn"] == 0
    assert q.threads(messages(spark).limit(0)).count() == 0


def test_long_chain_and_hot_passage(spark):
    chain = spark.range(70).selectExpr("1L AS conv_id", "id AS turn", "'u' AS role", "IF(id > 0, concat('> m', id - 1, '\nm', id), 'm0') AS text")
    hot = spark.range(300).selectExpr("id + 10 AS conv_id", "100L AS turn", "'u' AS role", "concat('> m69\nhot', id) AS text")
    rows = q.threads(chain.unionByName(hot)).collect()
    depth = {(r["conv_id"], r["turn"]): r["depth"] for r in rows}
    assert [depth[(1, t)] for t in range(70)] == list(range(70))
    assert {depth[(c + 10, 100)] for c in range(300)} == {70}
    assert sorted(r["position"] for r in rows) == list(range(370))


def test_partial_quotes_need_all_their_lines(spark):
    rows = [
        (1, 0, "Hi all,\nlunch?"), (1, 1, "Hi all,\nI propose Monday.\nBob"),
        (1, 2, "> Hi all,\n> I propose Monday.\nFine"),  # a common first line
        (1, 3, "> Hi all,\n> something nobody ever wrote here\nNo"),
        (2, 0, "Dear colleagues of the group,\nthe meeting is moved to Friday at ten\nin the large room\nAnn"),
        (2, 1, "> of the group,\n> the meeting is moved\n> to Friday at ten\nreflowed"),
        (2, 2, "> [...] group,\n> the meeting is moved to Friday at ten\n> in the large room\nfirst line trimmed"),
        (2, 3, "> the meeting is moved to Friday at ten\n> in the small room of the annex\nother words"),
        (2, 4, "> eagues of the group,\n> the meeting is moved to Fri\ncut inside words"),
        (3, 9, "> I propose Monday.\n> Bob\nfrom elsewhere"), (3, 10, "> propose\nnot a whole line"), (3, 11, "> Monday.\n> Hi all,\nwrong order"),
    ]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, text string").selectExpr("conv_id", "turn", "'u' AS role", "text")
    got = {(r["conv_id"], r["turn"]): (r["parent_conv"], r["parent_turn"]) for r in q.threads(df).collect()}
    want = {(1, 2): (1, 1), (2, 1): (2, 0), (2, 2): (2, 0), (2, 4): (2, 0), (3, 9): (1, 1)}
    assert got == {(c, t): want.get((c, t), (None, None)) for c, t, _ in rows}


def test_query_quotes_in_part(spark):
    """What as_replies writes has partial quotes, and all of them link."""
    docs = spark.createDataFrame([(1, i, "u", f"Hi all,\nthis is what number {i} says\nbye") for i in range(4)], "conv_id bigint, turn bigint, role string, text string")
    mail = q.as_replies(docs)
    assert ">> Hi all," not in mail.where("turn = 2").first()["text"]
    rows = q.threads(mail).collect()
    assert {(r["turn"], r["n_linked"], r["parent_turn"]) for r in rows} == {(0, 0, None), (1, 1, 0), (2, 2, 1), (3, 2, 2)}


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    got = q.query(spark, folder)
    cur = con.execute(f"SELECT {', '.join(got.columns)} FROM ({q.SQL})")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, cur.fetchall()))
