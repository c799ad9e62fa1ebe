"""Chat formatting into prefix trees.

Conversations that begin with the same turns share these turns' nodes. A node is known by the fingerprint of its prefix (the
exclusive or of 128-bit hashes of position, role and text, a running window sum). Nodes are laid out depth first: distinct
conversations are sorted by their paths, a node belongs to the first one that has it, and running sums give
each node its place in its tree. A node's tokens are emitted once, with the position id of its first token (its ancestors'
length) and the intervals of the tree that its tokens may attend to besides themselves.

A turn is ``### role: text</turn>``; a backslash before it escapes a control string or backslash in a text, so
formatting can be undone. Turn heads, texts and ends are tokenized apart, so the loss mask (assistant texts) has whole tokens.

Defined cases: null texts and roles count as empty; rows of one conversation are ordered by turn, role and text, and repeated
rows are turns of their own; a null conv_id is a conversation too; texts of any length are formatted whole; an empty table gives no nodes;
further columns are not looked at, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, join_keyed, join_salted, read, stored

HEAD, MIDDLE, TAIL, ESCAPE, LOSS_ROLE = "### ", ": ", "</turn>", "\\", "assistant"
#: Paths in a block of the running sum over a tree, as bits.
BLOCK_BITS = 16
#: Roles whose heads a task remembers, and characters that are encoded at once.
ROLES, ENCODED = 1000, 1 << 20

_CONTROL = re.compile(r"\\|###|</turn>")
_ROLE_CONTROL = re.compile(r"\\|###|</turn>|:")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"### ([^\\:]*+(?:\\.[^\\:]*+)*+): ([^\\<]*+(?:(?:\\.|<(?!/turn>))[^\\<]*+)*+)</turn>", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: ESCAPE + m.group(), text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def turn_parts(role: str, text: str) -> tuple[str, str, str]:
    """Head, escaped text and end of a turn."""
    return HEAD + _ROLE_CONTROL.sub(lambda m: ESCAPE + m.group(), role) + MIDDLE, escape(text), TAIL


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


class _Codec:
    """Text to token ids and back, without special tokens."""

    def __init__(self) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        self.tokenizer.encode_special_tokens = True
        with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            known = {int(i): base64.b64decode(b) for b, i in map(bytes.split, f)}
        self.raw = [known.get(i, b"") for i in range(max(known) + 1)]
        self.heads: dict[str, list[int]] = {}
        self.tail = self.encode([TAIL])[0]

    def head(self, role: str) -> list[int]:
        """The tokens of a turn's head; few roles make most turns."""
        if role not in self.heads:
            if len(self.heads) > ROLES:
                self.heads.clear()
            self.heads[role] = self.encode([turn_parts(role, "")[0]])[0]
        return self.heads[role]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8")


_CODEC: list[_Codec] = []


def _codec() -> _Codec:
    if not _CODEC:
        _CODEC.append(_Codec())
    return _CODEC[0]


def _turn_tokens():
    @F.pandas_udf("struct<tokens: array<int>, loss_from: int, loss_to: int>")
    def run(roles: pd.Series, texts: pd.Series) -> pd.DataFrame:
        codec, rows = _codec(), []
        escaped = [escape(t) for t in texts]
        lo = size = 0
        for hi, t in enumerate(escaped, 1):
            size += len(t)
            if size < ENCODED and hi < len(escaped):
                continue
            for role, body in zip(roles[lo:hi], codec.encode(escaped[lo:hi]), strict=True):
                head = codec.head(role)
                rows.append((head + body + codec.tail, len(head), len(head) + (len(body) if role == LOSS_ROLE else 0)))
            lo, size = hi, 0
        return pd.DataFrame(rows, columns=["tokens", "loss_from", "loss_to"])

    return run


def turns(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, depth, node, parent, role, text) of the conversations' turns; depths count from 0."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("depth", F.row_number().over(order) - 1)
    so_far = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    for k in (1, 2):
        rows = rows.withColumn(f"h{k}", F.xxhash64(F.lit(k), "depth", "role", "text"))
    for k in (1, 2):
        rows = rows.withColumn(f"p{k}", F.bit_xor(f"h{k}").over(so_far))
    name = lambda a, b: F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0"))
    parent = F.when(F.col("depth") > 0, name(F.col("p1").bitwiseXOR(F.col("h1")), F.col("p2").bitwiseXOR(F.col("h2"))))
    return rows.select("conv_id", "depth", name(F.col("p1"), F.col("p2")).alias("node"), parent.alias("parent"), "role", "text")


def forest(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The prefix trees of ``conversations`` (conv_id, turn, role, text) as two tables.

    Nodes: tree, node, parent, depth, role, tokens, n_conversations, start (in the tree's token sequence), position (id of the
    first token), loss_from and loss_to (tokens of the node under the loss mask), ancestors (array of intervals of
    the sequence, in order). Members: conv_id, leaf, n_turns, path (its nodes in order).
    """
    rows = stored(turns(conversations))
    nodes = rows.groupBy("node").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("role").alias("role"), F.first("text").alias("text"), F.count(F.lit(1)).alias("n_conversations"))
    nodes = stored(nodes.select("*", _turn_tokens()("role", "text").alias("t")).select("node", "parent", "depth", "role", "n_conversations", "t.*", F.size("t.tokens").cast("long").alias("n")))
    members = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("depth", "node"))).alias("p")).select("conv_id", F.col("p.node").alias("path"))
    members = cut(members.select("conv_id", F.element_at("path", -1).alias("leaf"), F.size("path").cast("long").alias("n_turns"), "path"))
    # Depth-first order: distinct paths sorted; equal conversations are one path.
    paths = cut(members.groupBy("leaf").agg(F.first("path").alias("path")).orderBy("path").select("path", F.monotonically_increasing_id().alias("rank")))
    steps = paths.select("rank", F.element_at("path", 1).alias("tree"), F.posexplode("path").alias("depth", "node"))
    owners = steps.groupBy("node").agg(F.min("rank").alias("owner"), F.first("tree").alias("tree"), F.count(F.lit(1)).alias("paths"))
    placed = cut(nodes.drop("tokens").join(owners, "node"))
    sums = placed.groupBy("tree", "owner").agg(F.sum("n").alias("n")).withColumn("block", F.shiftright("owner", BLOCK_BITS))
    blocks = sums.groupBy("tree", "block").agg(F.sum("n").alias("n")).selectExpr("tree", "block", "sum(n) OVER (PARTITION BY tree ORDER BY block) - n AS before")
    begins = sums.selectExpr("tree", "block", "owner", "sum(n) OVER (PARTITION BY tree, block ORDER BY owner) - n AS inside").join(blocks, ["tree", "block"]).select("owner", (F.col("inside") + F.col("before")).alias("begin"))
    placed = placed.join(begins, "owner").selectExpr("*", "begin + sum(n) OVER (PARTITION BY owner ORDER BY depth) - n AS start")
    placed = cut(placed.drop("begin"))
    # Along each path: position ids, and the runs of adjacent nodes before each node.
    along = join_keyed(steps.select("rank", "node"), placed.select("node", "paths", "owner", "depth", "start", "n"), "node", "paths")
    along = along.selectExpr("*", "sum(n) OVER (PARTITION BY rank ORDER BY depth) - n AS position", "CASE WHEN start = lag(start + n) OVER (PARTITION BY rank ORDER BY depth) THEN 0 ELSE 1 END AS turns_off")
    along = along.selectExpr("*", "sum(turns_off) OVER (PARTITION BY rank ORDER BY depth) AS run")
    runs = along.groupBy("rank", "run").agg(F.min("start").alias("a"), F.max(F.col("start") + F.col("n")).alias("b"))
    runs = runs.groupBy("rank").agg(F.array_sort(F.collect_list(F.struct("run", "a", "b"))).alias("runs"))
    own = along.where("rank = owner").join(runs, "rank")
    ancestors = F.expr("transform(filter(runs, r -> r.run < run OR r.run = run AND r.a < start), r -> named_struct('start', r.a, 'stop', CASE WHEN r.run = run THEN start ELSE r.b END))")
    own = own.select("node", "position", ancestors.alias("ancestors"))
    out = placed.join(own, "node").join(nodes.select("node", "tokens"), "node").select("tree", "node", "parent", "depth", "role", "tokens", "n_conversations", "start", "position", "loss_from", "loss_to", "ancestors", "paths")
    return stored(out), members


def read_back(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """Each conversation as its tree gives it: conv_id, tokens, loss (array of token intervals). Nodes are in path order."""
    paths = members.groupBy("leaf").agg(F.first("path").alias("path"), F.count(F.lit(1)).alias("copies"))
    steps = paths.select("leaf", F.posexplode("path").alias("at", "node"))
    span = F.struct((F.col("position") + F.col("loss_from")).alias("start"), (F.col("position") + F.col("loss_to")).alias("stop"))
    parts = nodes.select("node", "paths", "tokens", F.when(F.col("loss_to") > F.col("loss_from"), span).alias("loss"))
    along = join_salted(steps, parts, "node", "paths", "leaf")
    whole = along.groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("at", "tokens", "loss"))).alias("p"))
    whole = whole.select("leaf", F.flatten("p.tokens").alias("tokens"), F.filter("p.loss", lambda x: x.isNotNull()).alias("loss"))
    return whole.join(paths.select("leaf", "copies"), "leaf")


def _digests():
    @F.pandas_udf("struct<n_turns: long, turns_sha256: string, loss_chars: long, loss_sha256: string, formatted_chars: long>")
    def run(tokens: pd.Series, loss: pd.Series) -> pd.DataFrame:
        codec, rows = _codec(), []
        for ids, spans in zip(tokens, loss, strict=True):
            ids = ids.tolist()
            formatted = codec.decode(ids)
            found = parse(formatted)
            learned = "".join(unescape(codec.decode(ids[s["start"] : s["stop"]])) for s in spans)
            whole = "".join(f"{role}\n{text}\n" for role, text in found)
            rows.append((len(found), hashlib.sha256(whole.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(formatted)))
        return pd.DataFrame(rows, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return run


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted into prefix trees and read back from these: conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    hard = "\\### Assistant: </turn> ok"
    table = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    nodes, members = forest(table.unionByName(more))
    digests = cut(read_back(nodes, members).select("leaf", "copies", _digests()("tokens", "loss").alias("d")).select("leaf", "copies", "d.*"))
    return join_keyed(members.select("conv_id", "leaf"), digests, "leaf", "copies").select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, '### ' || regexp_replace(role, '(\\|###|</turn>|:)', '\\\1', 'g') || ': ' || regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g') || '</turn>' AS f FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(f)) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
