"""Mixing sources to target weights along a tree of domains, languages and sources.

DataFrame operations only. The budget flows from the root to the leaves: at every node the
children share it by weight, a child that holds less than its share gives the rest to its
siblings, and only what a whole subtree can not use goes to the siblings of its parent.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ampledger.llm.common import scratch

#: Runs of other characters than these are tokens.
SPACES = r"\t\n\x0B\f\r "
#: Documents per hash range of a leaf; only the range in which a budget ends is ordered.
RANGE_ROWS = 16_384


@dataclass(frozen=True)
class Plan:
    """``levels``: names and expressions from the root's children to the leaves.
    ``weights``: per level the weight of a value among its siblings; others weigh
    ``other``. ``share``: the budget as a share of all tokens; ``tokens``: the budget as a
    number, which comes first. ``epochs``: how often a document may be used."""

    levels: dict[str, Column]
    weights: dict[str, dict[str, float]] = field(default_factory=dict)
    other: float = 1.0
    share: float = 1.0
    tokens: int | None = None
    epochs: int = 1
    seed: int = 1


def token_count(text: Column) -> Column:
    """Number of tokens separated by white space; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACES}]+")), F.lit(0)).cast("long")


def _weight(level: str, plan: Plan) -> Column:
    out = F.lit(float(plan.other))
    for value, weight in plan.weights.get(level, {}).items():
        out = F.when(F.col(level) == value, F.lit(float(weight))).otherwise(out)
    return out


def _all_positive(names: list[str]) -> Column:
    return F.forall(F.array(*[F.col(f"_w_{level}") for level in names]), lambda w: w > 0)


def leaf_budgets(leaves: DataFrame, plan: Plan) -> DataFrame:
    """``leaves(levels..., tokens)`` with ``budget``, in tokens.

    The children of a node in order of capacity by weight: if the first i are used up, the
    others get ``(budget - their capacity) / other weight`` per unit of weight. The largest
    of these rates is the one that holds, and a child gets its rate or all that it has.
    Children of weight 0 get nothing.
    """
    names = list(plan.levels)
    leaves = leaves.withColumn("_cap", F.col("tokens").cast("double") * plan.epochs)
    for level in names:
        leaves = leaves.withColumn(f"_w_{level}", _weight(level, plan))
    usable = leaves.where(_all_positive(names))
    top = Window.partitionBy(F.lit(0))
    wanted = F.lit(float(plan.tokens or 0)) if plan.tokens is not None else F.sum("_all").over(top) * plan.share
    # The budget counts the tokens of all leaves, also of those without weight.
    nodes = (
        leaves.groupBy(names[0], f"_w_{names[0]}")
        .agg(
            F.sum(F.when(_all_positive(names), F.col("_cap")).otherwise(0.0)).alias("_cap"),
            F.sum(F.col("tokens").cast("double")).alias("_all"),
        )
        .withColumn("_in", F.least(wanted, F.sum("_cap").over(top)))
        .where(F.col(f"_w_{names[0]}") > 0)
    )
    above: list[str] = []
    for depth, level in enumerate(names):
        if depth:
            children = usable.groupBy(*names[: depth + 1], f"_w_{level}").agg(F.sum("_cap").alias("_cap"))
            nodes = children.join(nodes.select(*above, F.col("budget").alias("_in")), above)
        weight = F.col(f"_w_{level}")
        group = Window.partitionBy(*above) if above else top
        ordered = group.orderBy(F.col("_cap") / weight, level)
        before = ordered.rowsBetween(Window.unboundedPreceding, -1)
        after = ordered.rowsBetween(0, Window.unboundedFollowing)
        rate = (F.col("_in") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum(weight).over(after)
        nodes = nodes.withColumn("_rate", rate)
        nodes = nodes.withColumn("budget", F.least(F.col("_cap"), weight * F.max("_rate").over(group)))
        above.append(level)
    return leaves.select(*names, "tokens", *[c for c in leaves.columns if c == "docs"]).join(
        nodes.select(*names, F.floor(F.col("budget") + 1e-6).alias("budget")), names
    )


def mixture(
    df: DataFrame, plan: Plan, id_col: str = "doc_id", text_col: str = "text", with_digest: bool = False
) -> DataFrame:
    """The chosen documents: ``doc_id``, the levels, ``epoch``, ``n_tokens``, ``taken``; on
    request ``text_sha256``, which with the id names a row.

    A leaf whose budget is more than its tokens is used whole once or several times; of the
    last epoch it gives a prefix in that epoch's order, the md5 of seed, epoch and id. The
    document in which the budget ends is ``taken`` up to it. So the taken tokens of a leaf
    are its budget exactly.

    Level values are text; null and empty are one value. A null text has no tokens; such
    documents belong to full epochs and to prefixes that reach them. Rows that repeat an id
    stand next to each other in the order, null ids share one place, equal rows are
    interchangeable. Nothing is chosen from an empty table.
    """
    names = list(plan.levels)
    rows = scratch(
        df.select(
            F.col(id_col).cast("long").alias("_id"),
            *[F.coalesce(e.cast("string"), F.lit("")).alias(n) for n, e in plan.levels.items()],
            token_count(F.col(text_col)).alias("n_tokens"),
            *([F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("text_sha256")] if with_digest else []),
        ),
        "mixture",
    )
    leaves = rows.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    budgets = leaf_budgets(leaves, plan).where("tokens > 0")
    budgets = budgets.select(
        *names,
        F.expr("budget div tokens").alias("_full"),
        F.expr("budget % tokens").alias("_rest"),
        F.ceil(F.col("docs") / RANGE_ROWS).alias("_ranges"),
    )
    used = rows.join(budgets, names)
    out = [F.col("_id").alias("doc_id"), *names, "epoch", "n_tokens", "taken", *(["text_sha256"] if with_digest else [])]
    whole = (
        used.where("_full > 0")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_full") - 1)))
        .withColumn("taken", F.col("n_tokens"))
        .select(*out)
    )
    place = F.md5(
        F.concat_ws("|", F.lit(str(plan.seed)), F.col("_full").cast("string"), F.coalesce(F.col("_id").cast("string"), F.lit(""))).cast("binary")
    )
    last = used.where("_rest > 0").withColumn("_place", place)
    # The first 32 bits of the place, cut into equal ranges: ranges follow the order.
    last = last.withColumn(
        "_range", F.expr("conv(substring(_place, 1, 8), 16, 10)").cast("long") * F.col("_ranges") / F.lit(float(1 << 32))
    ).withColumn("_range", F.floor("_range"))
    sums = last.groupBy(*names, "_range").agg(F.sum("n_tokens").alias("_sum"))
    before = Window.partitionBy(*names).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_start", F.coalesce(F.sum("_sum").over(before), F.lit(0).cast("long")))
    placed = last.join(sums, [*names, "_range"]).where("_start < _rest")
    inside = placed.where("_start + _sum <= _rest").withColumn("taken", F.col("n_tokens"))
    order = ["_place", "n_tokens", *(["text_sha256"] if with_digest else [])]
    within = (
        Window.partitionBy(*names, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    edge = (
        placed.where("_start + _sum > _rest")
        .withColumn("_start", F.col("_start") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0).cast("long")))
        .where("_start < _rest")
        .withColumn("taken", F.least(F.col("n_tokens"), F.col("_rest") - F.col("_start")))
    )
    epoch = F.col("_full").alias("epoch")
    prefix = inside.unionByName(edge).select("*", epoch).select(*out)
    return whole.unionByName(prefix)


def oracle(plan_sql: dict[str, str], plan: Plan, documents: str = "documents") -> str:
    """The same result in DuckDB SQL; ``plan_sql`` has the SQL of each level."""
    names = list(plan.levels)

    def weight(level: str) -> str:
        cases = " ".join(f"WHEN '{v}' THEN {float(w)!r}" for v, w in plan.weights.get(level, {}).items())
        return f"CASE {level} {cases} ELSE {float(plan.other)!r} END::DOUBLE" if cases else f"{float(plan.other)!r}::DOUBLE"

    ctes = [
        "_rows AS (SELECT doc_id, "
        + ", ".join(f"coalesce({e}, '') AS {n}" for n, e in plan_sql.items())
        + rf", coalesce(len(regexp_extract_all(text, '[^{SPACES}]+')), 0)::BIGINT AS n_tokens FROM {documents})",
        f"_leaves AS (SELECT {', '.join(names)}, sum(n_tokens)::BIGINT AS tokens FROM _rows GROUP BY ALL)",
        "_usable AS (SELECT *, tokens::DOUBLE * "
        + f"{plan.epochs} AS cap FROM _leaves WHERE "
        + " AND ".join(f"{weight(n)} > 0" for n in names)
        + ")",
    ]
    wanted = f"{float(plan.tokens)!r}" if plan.tokens is not None else f"(SELECT sum(tokens::DOUBLE) * {plan.share!r} FROM _leaves)"
    ctes.append(f"_n0 AS (SELECT least({wanted}, sum(cap)) AS budget FROM _usable)")
    for depth, level in enumerate(names):
        keys, above = ", ".join(names[: depth + 1]), ", ".join(names[:depth])
        group = f"PARTITION BY {above}" if above else ""
        parent = f"JOIN _n{depth} USING ({above})" if above else f"CROSS JOIN _n{depth}"
        ctes.append(
            f"""_c{depth} AS (SELECT {keys}, {weight(level)} AS w, cap, budget AS inflow FROM
                (SELECT {keys}, sum(cap) AS cap FROM _usable GROUP BY ALL) {parent})"""
        )
        ctes.append(
            f"""_r{depth} AS (SELECT *, (inflow - coalesce(sum(cap) OVER (w_o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(w) OVER (w_o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate
                FROM _c{depth} WINDOW w_o AS ({group} ORDER BY cap / w, {level}))"""
        )
        ctes.append(f"_n{depth + 1} AS (SELECT {keys}, least(cap, w * max(rate) OVER ({group})) AS budget FROM _r{depth})")
    keys = ", ".join(names)
    ctes += [
        f"""_budgets AS (SELECT *, floor(budget + 1e-6)::BIGINT // tokens AS full_epochs,
            floor(budget + 1e-6)::BIGINT % tokens AS rest FROM _leaves JOIN _n{len(names)} USING ({keys}) WHERE tokens > 0)""",
        f"_used AS (SELECT * FROM _rows JOIN _budgets USING ({keys}))",
        f"""_whole AS (SELECT doc_id, {keys}, unnest(range(0, full_epochs)) AS epoch, n_tokens, n_tokens AS taken
            FROM _used WHERE full_epochs > 0)""",
        f"""_placed AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY {keys}
            ORDER BY md5('{plan.seed}|' || full_epochs || '|' || coalesce(doc_id::VARCHAR, '')), n_tokens
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM _used WHERE rest > 0)""",
    ]
    return f"""WITH {', '.join(ctes)}
        SELECT * FROM _whole UNION ALL
        SELECT doc_id, {keys}, full_epochs AS epoch, n_tokens, least(n_tokens, rest - start) AS taken
        FROM _placed WHERE start < rest"""
