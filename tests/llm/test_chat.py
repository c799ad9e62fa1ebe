import hashlib

from pyspark.sql import functions as F

from holloway.llm.chat import escape, forest, op2_chat_format, parse, read_back, turn_parts, unescape

ROWS = [(1, 0, "user", "a"), (1, 1, "assistant", "b b"), (1, 2, "user", "c"), (2, 0, "user", "a"), (2, 1, "assistant", "b b"), (2, 2, "user", "d e f"), (3, 0, "user", "a"),
        (4, 0, "user", "z"), (5, 0, "user", "a"), (5, 1, "assistant", "q"), (6, 0, None, None), (None, 3, "user", "a"), (7, 1, "assistant", ""), (7, 1, "assistant", ""), (8, 0, "user", "long " * 50_000)]


def test_escaping_is_reversible():
    for t in ("", "\\", "###", "\\### Assistant: </turn> ok", "</turn></turn", "a\\\\###\\", ": \n"):
        assert unescape(escape(t)) == t
        assert parse("".join(turn_parts(t, t)) * 2) == [(t, t)] * 2


def test_trees(spark):
    nodes, members = (t.collect() for t in forest(spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")))
    by_id = {n.node: n for n in nodes}
    assert len(members) == len({r[0] for r in ROWS})
    for tree in {n.tree for n in nodes}:  # each token once, without gaps
        at = 0
        for n in sorted((n for n in nodes if n.tree == tree), key=lambda n: n.start):
            assert n.start == at
            at += len(n.tokens)
    for m in members:  # position ids go on along a path, and a node sees its ancestors and nothing else
        position, seen = 0, set()
        for name in m.path:
            n = by_id[name]
            assert n.position == position
            assert {i for a in n.ancestors for i in range(a.start, a.stop)} == seen
            position += len(n.tokens)
            seen |= set(range(n.start, n.start + len(n.tokens)))
    shared = [n for n in nodes if n.role == "user" and n.depth == 0 and n.n_conversations == 5]
    assert len(shared) == 1


def test_read_back_keeps_every_conversation(spark):
    nodes, members = forest(spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string"))
    assert read_back(nodes, members).count() == members.select("leaf").distinct().count()
    nodes, members = forest(spark.createDataFrame([], "conv_id long, turn long, role string, text string, node string"))
    assert nodes.count() == members.count() == 0


def test_hot_first_turn_with_a_long_text(spark):
    """More conversations than a hot key needs share one long turn; its tokens are stored once and every path reads them."""
    text = "again and again " * 300
    t = spark.range(1300).selectExpr("id AS conv_id", f"explode(array(struct(0 AS turn, 'user' AS role, '{text}' AS text), struct(1 AS turn, 'assistant' AS role, string(id) AS text))) AS x").select("conv_id", "x.*", F.lit("y").alias("node"))
    nodes, members = forest(t)
    assert nodes.count() == 1301
    back = read_back(nodes, members).select(F.size("tokens").alias("n"), F.size("loss").alias("k")).groupBy("k").agg(F.count("*").alias("c"), F.min("n").alias("low")).collect()
    assert [(r.k, r.c) for r in back] == [(1, 1300)] and back[0].low > 900


def test_query(spark, sf):
    rows = {r.conv_id: r for r in op2_chat_format(spark, sf).collect()}
    hard = "\\### Assistant: </turn> ok"
    assert rows[-7].n_turns == 2 and rows[-7].loss_chars == len(hard)
    assert rows[-7].turns_sha256 == hashlib.sha256(f"user\n{hard}\nassistant\n{hard}\n".encode()).hexdigest()
    assert rows[-7].loss_sha256 == hashlib.sha256(hard.encode()).hexdigest()
