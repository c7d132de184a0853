"""Chat formatting as prefix trees: conversations that share their first turns share the tokens of these turns.

A tree's node is a turn after the turns before it. Different conversations, sorted by their paths, are the branches of the
trees in depth-first order: a branch emits the nodes that no branch before it has, so every node's tokens come once. A
branch's row has its place in the one long sequence of all trees, the position id of its first token (those of the
others follow on) and the intervals of the sequence that hold its ancestors, which are all that its tokens may attend to
beside the branch's own earlier ones.

Texts are escaped, so that nothing in them reads as one of the template's marks or another template's: a backslash is
doubled and one is put after the first character of a control string.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfwright.llm.common import running_total, snapshot

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
#: Role whose texts are learned.
LEARNED = "assistant"
_CONTROL = re.compile(r"\\|<(?=\|)|<(?=/?s>)|\[(?=/?INST\])|<(?=</?SYS>>)")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(re.escape(TURN) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END), re.S)
_KEY = 16


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m.group() + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def load_tokenizer(tokenizer_file: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file)
    tokenizer.encode_special_tokens = True
    return tokenizer


def paths(conversations: DataFrame) -> DataFrame:
    """conv_id, path (a key per turn that stands for it and all turns before it), turns: one row per conversation.

    Turns in order; equal turn numbers by role, then text, nulls first; null roles and texts are empty."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    gathered = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    gathered = gathered.select("conv_id", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keys = []
            for roles, texts in zip(frame["roles"], frame["texts"]):
                own, last = [], b""
                for role, text in zip(roles, texts):
                    r = role.encode("utf-8")
                    last = hashlib.blake2b(b"%b%d:%b%b" % (last, len(r), r, text.encode("utf-8")), digest_size=_KEY).digest()
                    own.append(last)
                keys.append(b"".join(own))
            yield frame.assign(conv_id=frame["conv_id"].astype("Int64"), path=keys)

    return gathered.mapInPandas(run, "conv_id long, roles array<string>, texts array<string>, path binary")


def tokenised(nodes: DataFrame, tokenizer_file: str) -> DataFrame:
    """node, tokens, learned (a byte per token, 1 under the loss), n_tokens."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = load_tokenizer(tokenizer_file).encode_batch
        for frame in frames:
            for at in range(0, len(frame), 1000):
                part = frame.iloc[at : at + 1000]
                heads = [e.ids for e in encode([TURN + escape(r) + TEXT for r in part["role"]], add_special_tokens=False)]
                texts = [e.ids for e in encode([escape(t) for t in part["text"]], add_special_tokens=False)]
                end = encode([END], add_special_tokens=False)[0].ids
                learned = [bytes(len(h)) + (b"\1" if r == LEARNED else b"\0") * len(t) + bytes(len(end)) for h, t, r in zip(heads, texts, part["role"])]
                tokens = [h + t + end for h, t in zip(heads, texts)]
                yield pd.DataFrame({"node": part["node"].to_numpy(), "tokens": tokens, "learned": learned, "n_tokens": [len(t) for t in tokens]})

    return nodes.mapInPandas(run, "node binary, tokens array<int>, learned binary, n_tokens long")


class Trees:
    """The formatted conversations. ``branches``: branch, tree, start, position, tokens, learned, ancestors; one row per different
    conversation. ``members``: conv_id, branch. ``steps``: branch, depth, owner (the branch that emits the node), lo, hi."""

    def __init__(self, branches: DataFrame, members: DataFrame, steps: DataFrame):
        self.branches, self.members, self.steps = branches, members, steps


def build(conversations: DataFrame, tokenizer_file: str) -> Trees:
    """Rows of conv_id, turn, role, text to trees. A null conv_id is one conversation; repeated rows are repeated turns; long
    texts are whole. A node, branch or conversation that very many conversations share is never gathered: it is counted
    in every task first, and joined by keys that can be split."""
    convs = snapshot(paths(conversations), "paths")
    at = F.posexplode(F.arrays_zip("roles", "texts")).alias("depth", "x")
    node = F.substring("path", F.col("depth") * _KEY + 1, F.lit(_KEY))
    nodes = (
        convs.select("path", at).select(node.alias("node"), F.col("x.roles").alias("role"), F.col("x.texts").alias("text"))
        .groupBy("node").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    )
    tokens = snapshot(tokenised(nodes, tokenizer_file), "tokens")
    ranked = snapshot(running_total(convs.select("path").distinct().withColumn("one", F.lit(1)), ["path"], "one", "branch").select("path", "branch"), "ranked")
    members = convs.select("conv_id", F.col("path").alias("_path")).join(ranked, F.col("_path") == F.col("path")).select("conv_id", "branch")

    depths = F.explode(F.sequence(F.lit(0), (F.octet_length("path") / _KEY).cast("int") - 1)).alias("depth")
    spots = snapshot(ranked.select("branch", "path", depths).select("branch", "depth", node.alias("node")), "spots")
    owners = spots.groupBy("node").agg(F.min("branch").alias("owner"))
    sized = snapshot(owners.join(tokens.select(F.col("node").alias("_n"), "n_tokens"), F.col("node") == F.col("_n")).drop("node"), "sized")
    # Position of a node's first token: the tokens of its ancestors.
    along = Window.partitionBy("branch").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    placed = snapshot(
        spots.join(sized, F.col("node") == F.col("_n")).select("branch", "depth", "node", "owner", "n_tokens"), "placed"
    ).withColumn("position", F.coalesce(F.sum("n_tokens").over(along), F.lit(0)))
    placed = snapshot(placed, "positions")
    new = placed.filter(F.col("owner") == F.col("branch"))
    spans = new.groupBy("branch").agg(F.sum("n_tokens").alias("n_new"), F.min("position").alias("first"))
    starts = snapshot(running_total(spans, ["branch"], "n_new", "start").select(F.col("branch").alias("_b"), "start", "first"), "starts")
    lo = F.col("start") + F.col("position") - F.col("first")
    steps = snapshot(
        placed.join(starts, F.col("owner") == F.col("_b")).select("branch", "depth", "node", "owner", "position", lo.alias("lo"), (lo + F.col("n_tokens")).alias("hi")), "steps"
    )
    bodies = (
        steps.filter(F.col("owner") == F.col("branch")).join(tokens.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"))
        .groupBy("branch").agg(F.sort_array(F.collect_list(F.struct("depth", "lo", "position", "tokens", "learned"))).alias("b"))
    )
    merge = lambda acc, x: F.when(  # noqa: E731  intervals that meet become one
        F.element_at(acc, -1)["hi"] == x["lo"], F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["lo"].alias("lo"), x["hi"].alias("hi"))))
    ).otherwise(F.concat(acc, F.array(F.struct(x["lo"].alias("lo"), x["hi"].alias("hi")))))
    above = steps.filter(F.col("owner") != F.col("branch")).groupBy(F.col("branch").alias("_b")).agg(F.sort_array(F.collect_list(F.struct("depth", "lo", "hi"))).alias("a"))
    roots = steps.filter("depth = 0").select(F.col("branch").alias("_r"), F.col("owner").alias("tree"))
    none = F.array().cast("array<struct<lo:bigint,hi:bigint>>")
    first = F.array(F.struct(F.col("a")[0]["lo"].alias("lo"), F.col("a")[0]["hi"].alias("hi")))
    branches = (
        bodies.join(roots, F.col("branch") == F.col("_r")).join(above, F.col("branch") == F.col("_b"), "left")
        .select(
            "branch",
            "tree",
            F.col("b")[0]["lo"].alias("start"),
            F.col("b")[0]["position"].alias("position"),
            F.flatten("b.tokens").alias("tokens"),
            F.aggregate("b.learned", F.lit(b""), lambda acc, x: F.concat(acc, x)).alias("learned"),
            F.when(F.col("a").isNull(), none).otherwise(F.aggregate(F.slice("a", 2, F.greatest(F.size("a") - 1, F.lit(0))), first, merge)).alias("ancestors"),
        )
    )
    return Trees(snapshot(branches, "branches"), members, steps.select("branch", "depth", "owner", "lo", "hi"))


def read_back(trees: Trees, tokenizer_file: str) -> DataFrame:
    """branch, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read from the emitted tokens and their mask."""
    emitted = trees.branches.select(F.col("branch").alias("_b"), "start", "tokens", "learned")
    cut = F.struct(
        "depth",
        F.slice("tokens", (F.col("lo") - F.col("start") + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int")).alias("tokens"),
        F.substring("learned", (F.col("lo") - F.col("start") + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int")).alias("learned"),
    )
    parts = trees.steps.join(emitted, F.col("owner") == F.col("_b")).select("branch", cut.alias("p"))
    whole = parts.groupBy("branch").agg(F.sort_array(F.collect_list("p")).alias("p")).select(
        "branch", F.flatten("p.tokens").alias("tokens"), F.aggregate("p.learned", F.lit(b""), lambda acc, x: F.concat(acc, x)).alias("learned")
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = load_tokenizer(tokenizer_file)
        for frame in frames:
            out = []
            for branch, tokens, learned in zip(frame["branch"], frame["tokens"], frame["learned"]):
                formatted = tokenizer.decode(list(tokens), skip_special_tokens=False)
                turns = parse(formatted)
                said = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8")).hexdigest()
                loss = unescape(tokenizer.decode([t for t, m in zip(tokens, learned) if m], skip_special_tokens=False))
                out.append((branch, len(turns), said, len(loss), hashlib.sha256(loss.encode("utf-8")).hexdigest(), len(formatted)))
            yield pd.DataFrame(out, columns=["branch", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return whole.mapInPandas(run, "branch long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
