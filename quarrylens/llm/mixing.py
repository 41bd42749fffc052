"""Mixing sources to target weights by hierarchical budgets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: A leaf's seeded order is cut by its first so many hexadecimal digits, two at a time: 256 bins, and 256 of the one that the
#: budget ends in, and so on. Only a bin of the last kind, one of sixteen million, is ever sorted.
DIGITS = 6


@dataclass
class Node:
    """A node of the tree: what a child gets is its weight's share of its parent's budget."""

    name: tuple
    weight: float
    tokens: int
    children: list[Node]
    budget: int = 0
    room: int = 0


def tree(leaves: Sequence[tuple[tuple, int]], weights: Mapping[tuple, float] | None = None, power: float = 1.0) -> Node:
    """Builds the tree over leaves (path, tokens). A node weighs what weights says of its path, else its
    tokens to the power, on the scale of its siblings that weights names: as if theirs added up to their tokens to the power."""
    root = Node((), 1.0, 0, [])
    at = {(): root}
    for path, tokens in sorted(leaves, key=lambda x: tuple("" if p is None else str(p) for p in x[0])):
        root.tokens += tokens
        for n in range(1, len(path) + 1):
            if path[:n] not in at:
                at[path[:n]] = Node(path[:n], 0.0, 0, [])
                at[path[: n - 1]].children.append(at[path[:n]])
            at[path[:n]].tokens += tokens
    weights = weights or {}
    for node in at.values():
        given = [c for c in node.children if c.name in weights]
        total, size = sum(weights[c.name] for c in given), sum(c.tokens**power for c in given if c.tokens)
        scale = total / size if total > 0 and size > 0 else 1.0
        for c in node.children:
            c.weight = float(weights[c.name] if c.name in weights else c.tokens**power * scale)
    return root


def fill(weights: Sequence[float], rooms: Sequence[int], budget: int) -> list[int]:
    """Shares a budget by weight among siblings of limited room. Who would get more than its room gets its room, and the
    others share the rest anew. Whole tokens: shares are rounded down, and what rounding leaves goes to the first with room."""
    out, left = [0] * len(weights), budget
    open_ = [i for i, w in enumerate(weights) if w > 0 and rooms[i] > 0]
    while open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * (weights[i] / total) >= rooms[i]]
        for i in full:
            out[i] = rooms[i]
        left -= sum(rooms[i] for i in full)
        if not full:
            for i in open_:
                out[i] = min(rooms[i], int(left * (weights[i] / total)))
            left -= sum(out[i] for i in open_)
            break
        open_ = [i for i in open_ if i not in set(full)]
    for i, w in enumerate(weights):
        if left > 0 and w > 0:
            more = min(left, rooms[i] - out[i])
            out[i], left = out[i] + more, left - more
    return out


def _room(node: Node, max_epochs: int) -> int:
    """Tokens that a node can take: a leaf its own, max_epochs times over; others what their weighted children can."""
    node.room = sum(r for c in node.children for r in [_room(c, max_epochs)] if c.weight > 0) if node.children else node.tokens * max_epochs
    return node.room


def allocate(root: Node, budget: int, max_epochs: int) -> None:
    """Budgets from the root down. A node's room is all that its subtree can take, so what a leaf can't take goes to its
    siblings, and only what the whole family can't take goes to the parent's siblings, and so on up."""
    _room(root, max_epochs)
    root.budget = min(budget, root.room)
    todo = [root]
    while todo:
        node = todo.pop()
        for c, b in zip(node.children, fill([c.weight for c in node.children], [c.room for c in node.children], node.budget), strict=True):
            c.budget = b
        todo += node.children


def plan(root: Node, budget: int, max_epochs: int) -> list[tuple[tuple, int, int]]:
    """(path, tokens, budget) of each leaf."""
    allocate(root, budget, max_epochs)
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        if n.children:
            todo += n.children
        elif n.name:
            out.append((n.name, n.tokens, n.budget))
    return sorted(out, key=str)


def word_count(text: Column) -> Column:
    """Words between ASCII white space; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix(
    docs: DataFrame, levels: Mapping[str, Column], tokens: Column, share: float | None = None, budget: int | None = None, weights: Mapping[tuple, float] | None = None,
    power: float = 1.0, max_epochs: int = 4, seed: str = "0", id_col: str = "doc_id", max_leaves: int = 100_000,
) -> DataFrame:
    """Samples documents so that each leaf of the tree gets its budget of tokens. Adds epoch (from 0), in place of such a column.

    levels: the tree's levels from the root down, by name (say domain, language, source). The budget is given, or a
    share of all tokens. weights: by path, of any node; others weigh their tokens to the power, on the scale of their weighted siblings. A leaf with a
    budget of b tokens gives its documents floor(b / tokens) times (epochs 0, 1, ...) and, of the next epoch, the longest
    prefix that stays within the rest, in that epoch's order by md5(seed:epoch:id). Null levels are a value of their own;
    null text has no tokens; null ids and ids that repeat are ordered like any others (among equal ids the row with fewer
    tokens first); documents without tokens are taken if their place is in the prefix. An empty table gives an empty one.

    The tree has as many leaves as sources are configured; more than max_leaves raise an error. A prefix is found without
    sorting a leaf: token sums by the first digits of the order, first of two, then of two more within the bin in which the
    budget ends, tell where it ends; of that last bin alone the documents are sorted."""
    given = [c for c in docs.columns if c != "epoch"]
    path = common.fresh(docs, *(f"level{i}" for i in range(len(levels))))
    leaf, tok, full, rest, order, cut, before, upto = common.fresh(docs, "leaf", "tokens", "full", "rest", "order", "cut", "before", "sum")
    spark = docs.sparkSession
    rows = docs.select(*[F.col(f"`{c}`") for c in given], *[x.cast("string").alias(n) for n, x in zip(path, levels.values(), strict=True)], tokens.cast("long").alias(tok)).withColumn(leaf, F.to_json(F.struct(*path)))
    found = rows.groupBy(*path, leaf).agg(F.sum(tok).alias("t")).limit(max_leaves + 1).collect()
    if len(found) > max_leaves:
        raise ValueError(f"more than {max_leaves} leaves")
    of = {tuple(r[n] for n in path): r[leaf] for r in found}
    root = tree([(tuple(r[n] for n in path), r["t"]) for r in found], weights, power)
    if budget is None:
        budget = int(root.tokens * (1.0 if share is None else share))
    goals = [(of[p], b // t if t else 0, b % t if t else 0) for p, t, b in plan(root, budget, max_epochs)]
    rows = rows.join(F.broadcast(spark.createDataFrame(goals, f"{leaf} string, {full} long, {rest} long")), leaf)  # a row for each leaf
    md5 = F.md5(F.concat_ws(":", F.lit(seed), F.col(full).cast("string"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))).cast("binary"))
    partial = rows.where(F.col(rest) > 0).withColumn(order, md5)
    sums = common.Scratch(spark, "mixing").put(partial.groupBy(F.col(leaf).alias("leaf"), F.col(rest).alias("rest"), F.substring(order, 1, DIGITS).alias("at")).agg(F.sum(tok).alias("s")))
    ends = sums.select("leaf", F.lit("").alias("cut"), F.lit(0).cast("long").alias("before")).distinct()
    for n in range(2, DIGITS + 1, 2):
        bins = sums.join(F.broadcast(ends), "leaf").where(F.col("at").startswith(F.col("cut"))).groupBy("leaf", "rest", "before", F.substring("at", 1, n).alias("bin")).agg(F.sum("s").alias("s"))
        bins = bins.withColumn("upto", F.col("before") + F.sum("s").over(Window.partitionBy("leaf").orderBy("bin")))  # 256 rows at most
        ends = bins.where(F.col("upto") > F.col("rest")).groupBy("leaf").agg(F.min(F.struct("bin", (F.col("upto") - F.col("s")).alias("b"))).alias("x")).select("leaf", F.col("x.bin").alias("cut"), F.col("x.b").alias("before"))
    ends = ends.select(F.col("leaf").alias(f"{leaf}_"), F.col("cut").alias(cut), F.col("before").alias(before))
    placed = partial.join(F.broadcast(ends), F.col(leaf) == F.col(f"{leaf}_"), "left")  # a row for each leaf
    columns = [F.col(f"`{c}`") for c in given]
    here = F.substring(order, 1, DIGITS)
    whole = placed.where(F.col(cut).isNull() | (here < F.col(cut)))
    w = Window.partitionBy(leaf).orderBy(order, F.col(f"`{id_col}`"), tok).rowsBetween(Window.unboundedPreceding, 0)
    edge = placed.where(here == F.col(cut)).withColumn(upto, F.sum(tok).over(w) + F.col(before)).where(F.col(upto) <= F.col(rest))
    again = rows.where(F.col(full) > 0).select(*columns, F.explode(F.sequence(F.lit(0), (F.col(full) - 1).cast("int"))).alias("epoch"))
    last = [x.select(*columns, F.col(full).cast("int").alias("epoch")) for x in (whole, edge)]
    return again.unionByName(last[0]).unionByName(last[1])


def levels() -> dict[str, Column]:
    """The tree of the documents table: a domain (a group of sources), a language, a source."""
    n = F.try_to_number(F.regexp_extract("source", r"([0-9]+)$", 1), F.lit("99999")).cast("int")
    return {"domain": F.when(n.isNull(), "other").when(n == 0, "crawl").when(n % 2 == 1, "reference").otherwise("community"), "lang": F.col("lang"), "source": F.col("source")}


def op8(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    goals = {("crawl",): 0.2, ("reference",): 0.5, ("community",): 0.3}
    docs = common.Scratch(spark, "mix").put(docs.select("doc_id", "lang", "source", word_count(F.col("text")).alias("n_tokens")))
    return mix(docs, levels(), F.col("n_tokens"), share=0.8, weights=goals, power=0.7, max_epochs=2, seed="mix").select("doc_id", "epoch", "lang", "source", "n_tokens")
