"""Mixing sources to target weights.

Sources are the leaves of a tree (by default domain, language, source).  A token
budget flows down it: at every node the budget is split among the children by
weight; a child whose subtree cannot supply its share gives the shortage to its
siblings, and only what no sibling can take is left to the node's own siblings,
since a node's capacity is what its leaves supply.  A leaf supplies its tokens
once in each of up to `max_epochs` epochs.

A leaf's budget buys whole epochs and then the longest prefix of a seeded
permutation (its own for each epoch) whose tokens fit in the rest.  The prefix is
found by sums of hash buckets of about BUCKET documents: only the bucket that the
budget ends in is sorted, and sums run over GROUP buckets at a time, so a leaf with
a third of all rows is spread over all tasks.

Only DataFrame operations.  Defined cases: a null level is a leaf value of its
own; null texts have no tokens, long ones are counted whole; documents without
tokens come with the prefix that reaches them; rows that share an id and leaf
stand together in the permutation and are taken together, each once an epoch; an
empty table gives an empty result; values without a weight have weight 1; a weight
of 0 takes nothing.  Extra columns are ignored unless they are named in `carry`;
columns named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartoframe.runtime import Scratch

#: Documents in a bucket, buckets in a group.
BUCKET, GROUP = 1000, 1000
LEVELS = ("domain", "lang", "source")
WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}}


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def domain_of(source: Column) -> Column:
    """One of four domains, by the first digit of the source name's md5."""
    digit = F.substring(F.md5(F.coalesce(source, F.lit(""))), 1, 1)
    return F.when(digit < "4", "d0").when(digit < "8", "d1").when(digit < "c", "d2").otherwise("d3")


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    known = weights.get(level)
    if not known:
        return F.lit(1).cast("long")
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x).cast(k) for v, w in known.items() for x, k in ((v, "string"), (w, "long"))]), F.coalesce(F.col(level), F.lit("\0"))), F.lit(1).cast("long"))


def _split(nodes: DataFrame, parent: list[str], level: str) -> DataFrame:
    """`budget` of each parent split among its children: rows of (parent..., level, weight, capacity, budget) get `share`.

    Children in order of capacity per weight: those that their part of what is
    left would fill are filled; the others divide the rest by weight.
    """
    same = [F.coalesce(F.concat(F.lit("v"), p), F.lit("n")) for p in parent]
    order = Window.partitionBy(*(same or [F.lit(0)])).orderBy(F.col("capacity").cast("double") / F.col("weight"), F.col(level).asc_nulls_first())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*(same or [F.lit(0)]))
    big = lambda c: F.col(c).cast("decimal(19,0)")
    nodes = nodes.where("weight > 0").withColumn("left_budget", F.col("budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0))).withColumn("left_weight", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    nodes = nodes.withColumn("full", big("capacity") * big("left_weight") <= big("weight") * big("left_budget"))
    nodes = nodes.withColumn("rest_budget", F.col("budget") - F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0)).over(whole)).withColumn("rest_weight", F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(whole))
    share = F.when(F.col("full"), F.col("capacity")).otherwise(F.expr("cast((cast(weight as decimal(19,0)) * cast(rest_budget as decimal(19,0))) div greatest(rest_weight, 1) as bigint)"))
    return nodes.withColumn("share", share).drop("left_budget", "left_weight", "full", "rest_budget", "rest_weight")


def leaf_budgets(leaves: DataFrame, budget: Column, levels: tuple[str, ...] = LEVELS, weights: dict[str, dict[str, int]] = WEIGHTS, max_epochs: int = 4) -> DataFrame:
    """Leaves (levels..., supply) with `share`, the tokens each is to give.  `budget` is an aggregate over the leaves, such as F.lit(10**9)."""
    leaves = leaves.withColumn("capacity", F.col("supply") * max_epochs)
    node = leaves.withColumn("budget", F.lit(leaves.agg(budget.cast("long")).first()[0]).cast("long"))
    for depth, level in enumerate(levels):
        path = list(levels[: depth + 1])
        children = node.groupBy(*path).agg(F.sum("capacity").alias("capacity"), F.max("budget").alias("budget")).withColumn("weight", _weight(level, weights))
        shared = _split(children, path[:-1], level)
        shared_named = shared.select(*[F.col(p).alias(f"__{p}") for p in path], F.col("share").alias("__share"))
        node = node.join(shared_named, [node[p].eqNullSafe(shared_named[f"__{p}"]) for p in path]).withColumn("budget", F.col("__share")).drop("__share", *[f"__{p}" for p in path])
    return node.withColumnRenamed("budget", "share")


def mix(docs: DataFrame, budget: Column, levels: tuple[str, ...] = LEVELS, weights: dict[str, dict[str, int]] = WEIGHTS, max_epochs: int = 4, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, levels..., epoch, n_tokens and the columns `carry`: a row for each time that a document is taken."""
    made = {"doc_id", "epoch", "n_tokens", *levels}
    carry = tuple(c for c in carry if c.lower() not in made)
    scratch = Scratch(docs.sparkSession, "mixing")
    slim = [F.col(id_col).cast("long").alias("doc_id"), *[F.col(x).cast("string").alias(x) for x in levels], n_words(F.col(text_col)).alias("n_tokens")]
    counted = scratch.table(docs.select(*slim))
    leaves = scratch.table(counted.groupBy(*levels).agg(F.sum("n_tokens").alias("supply"), F.count(F.lit(1)).alias("n_docs")))
    bought = leaf_budgets(leaves, budget, levels, weights, max_epochs).where("supply > 0").select(*[F.col(x).alias(f"__{x}") for x in levels], F.expr("share div supply").alias("__full"), F.expr("share % supply").alias("__rest"), F.ceil(F.col("n_docs") / BUCKET).alias("__buckets"))
    bought = scratch.table(bought)
    leaf = F.concat_ws("\0", *[F.coalesce(F.concat(F.lit("v"), x), F.lit("n")) for x in levels])

    def dealt(rows: DataFrame) -> DataFrame:
        """Rows with what their leaf has bought, their place in its permutation and their bucket."""
        rows = rows.join(bought, [rows[x].eqNullSafe(bought[f"__{x}"]) for x in levels]).drop(*[f"__{x}" for x in levels])
        rows = rows.withColumn("__h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("__full").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
        rows = rows.withColumn("__bucket", F.expr("(cast(conv(substring(__h, 1, 8), 16, 10) as bigint) * __buckets) div 4294967296"))
        return rows.withColumn("__leaf", leaf).drop("__buckets")

    sums = scratch.table(dealt(counted).groupBy("__leaf", "__bucket").agg(F.sum("n_tokens").alias("own")).withColumn("group", F.expr(f"__bucket div {GROUP}")))
    groups = sums.groupBy("__leaf", "group").agg(F.sum("own").alias("of_group"))
    ahead = groups.withColumn("ahead", F.sum("of_group").over(Window.partitionBy("__leaf").orderBy("group")) - F.col("of_group")).drop("of_group")
    upto = F.col("ahead") + F.sum("own").over(Window.partitionBy("__leaf", "group").orderBy("__bucket"))
    sums = sums.join(ahead, ["__leaf", "group"]).withColumn("__upto", upto).select("__leaf", "__bucket", (F.col("__upto") - F.col("own")).alias("__before"), "__upto")
    rows = dealt(docs.select(*slim, *carry) if carry else counted).join(sums, ["__leaf", "__bucket"])
    cut = F.expr("__upto > __rest and __before < __rest")  # the budget ends in this bucket: its rows one by one
    inside = F.sum("n_tokens").over(Window.partitionBy("__leaf", "__bucket").orderBy("__h", "doc_id"))
    once_more = F.expr("__upto <= __rest and __rest > 0").cast("int")
    whole = rows.where(~cut).withColumn("__copies", F.col("__full") + once_more)
    part = rows.where(cut).withColumn("__upto", F.col("__before") + inside).withColumn("__copies", F.col("__full") + once_more)
    taken = whole.unionByName(part).where("__copies > 0")
    return taken.select("doc_id", *levels, "n_tokens", *carry, F.explode(F.sequence(F.lit(0).cast("long"), F.col("__copies") - 1)).alias("epoch")).select("doc_id", *levels, "epoch", "n_tokens", *carry)


def half_of_supply() -> Column:
    return F.expr("coalesce(sum(supply), 0) div 2")


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    """Half of all tokens of `documents`, by target weights over domain, language and source."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source").withColumn("domain", domain_of(F.col("source")))
    return mix(docs, half_of_supply())


def sql() -> str:
    """The query in DuckDB SQL, for trees of any depth."""
    case = lambda level: f"CASE {level} " + " ".join(f"WHEN '{v}' THEN {w}" for v, w in WEIGHTS[level].items()) + " ELSE 1 END" if level in WEIGHTS else "1"
    steps, prev = [], "top"
    for depth, level in enumerate(LEVELS):
        path, above = ", ".join(LEVELS[: depth + 1]), ", ".join(LEVELS[:depth])
        part = f"PARTITION BY {above}" if above else ""
        order = f"{part} ORDER BY CAST(capacity AS DOUBLE) / weight, {level}"
        before = f"OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        steps.append(f"""c{depth} AS (SELECT {path}, CAST(sum(capacity) AS HUGEINT) AS capacity, CAST(max(budget) AS HUGEINT) AS budget, CAST({case(level)} AS HUGEINT) AS weight FROM {prev} GROUP BY {path}
), f{depth} AS (SELECT *, capacity * (sum(weight) OVER ({part}) - coalesce(sum(weight) {before}, 0)) <= weight * (budget - coalesce(sum(capacity) {before}, 0)) AS filled FROM c{depth}
), g{depth} AS (SELECT *, budget - sum(CASE WHEN filled THEN capacity ELSE 0 END) OVER ({part}) AS rb, sum(CASE WHEN filled THEN 0 ELSE weight END) OVER ({part}) AS rw FROM f{depth}
), n{depth} AS (SELECT p.* EXCLUDE (budget), CASE WHEN filled THEN g.capacity ELSE g.weight * rb // greatest(rw, 1) END AS budget FROM {prev} p JOIN g{depth} g USING ({path}))""")
        prev = f"n{depth}"
    leaf = ", ".join(LEVELS)
    return rf"""
WITH d AS (SELECT doc_id, lang, source, CASE WHEN x < '4' THEN 'd0' WHEN x < '8' THEN 'd1' WHEN x < 'c' THEN 'd2' ELSE 'd3' END AS domain,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens FROM (SELECT *, substr(md5(coalesce(source, '')), 1, 1) AS x FROM documents)
), s AS (SELECT {leaf}, CAST(sum(n_tokens) AS HUGEINT) AS supply FROM d GROUP BY {leaf}
), top AS (SELECT *, supply * 4 AS capacity, (SELECT sum(supply) FROM s) // 2 AS budget FROM s
), {", ".join(steps)}, b AS (SELECT {leaf}, CAST(budget // supply AS BIGINT) AS full_epochs, budget % supply AS rest FROM {prev} WHERE supply > 0
), k AS (SELECT d.*, full_epochs, rest, md5('7:' || full_epochs || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM d JOIN b USING ({leaf})
), u AS (SELECT *, sum(n_tokens) OVER (PARTITION BY {leaf} ORDER BY h, doc_id) AS upto FROM k
), e AS (SELECT *, full_epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS copies FROM u)
SELECT doc_id, {leaf}, epoch, CAST(n_tokens AS BIGINT) AS n_tokens FROM (SELECT *, unnest(range(0, copies)) AS epoch FROM e WHERE copies > 0)"""
