"""Mixing sources to target weights by budgets that run down a tree: domain, language, source.

The total is shared among domains by weight, a domain's share among its languages, a language's
among its sources. What a child cannot use (it has only so many tokens, times the epochs allowed) is
shared among its siblings by weight; only what a whole subtree cannot use goes further up. A leaf's
budget is spent on whole epochs of the leaf and then on a prefix of one more epoch, in an order
that a seed, the epoch and the doc_id give.

The prefix is found without sorting a leaf: tokens are summed by leaf and by the first digits of
the order's key; the digits where the budget ends are known from these sums, and only the rows
under those digits are ordered. What comes out is one cut key a leaf, so the documents themselves
are filtered where they lie and never shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkqueue.llm import common

OTHER = "(other)"
#: Hexadecimal digits of a key by which tokens are summed first: 4096 sums a leaf.
DIGITS = 3


@dataclass(frozen=True)
class Mix:
    """Targets. Weights are whole numbers above 0; names outside the tables share ``(other)``.

    ``domains`` has each domain's weight, ``domain_of`` the domain of each source, ``languages`` a
    language's weight within a domain, ``sources`` a source's weight within a language. So the
    leaves are no more than the tables say, whatever the documents hold. The total is
    ``total_tokens``, or ``share`` of all tokens there are.
    """

    domains: dict[str, int]
    domain_of: dict[str, str]
    languages: dict[str, int]
    sources: dict[str, int]
    total_tokens: int | None = None
    share: tuple[int, int] = (4, 5)
    epochs: int = 2
    seed: int = 7


def share_out(budget: int, children: list[tuple[str, int, int]]) -> dict[str, int]:
    """``budget`` among children (name, weight, most it can use), by weight and rounded down.

    Children that would get more than they can use get that; the rest is shared among the others.
    """
    out, rest = {}, sum(w for _, w, _ in children)
    left = sorted(children, key=lambda x: (x[2] / x[1], x[0]))
    while left and left[0][2] * rest <= budget * left[0][1]:
        name, weight, most = left.pop(0)
        out[name] = most
        budget, rest = budget - most, rest - weight
    return out | {name: budget * weight // rest for name, weight, _ in left}


def leaf_budgets(tokens: dict[tuple[str, str, str], int], mix: Mix) -> dict[tuple[str, str, str], int]:
    """Tokens to take from each leaf (domain, language, source), given the tokens that it has."""
    every = sum(tokens.values())
    total = mix.total_tokens if mix.total_tokens is not None else every * mix.share[0] // mix.share[1]
    weights = (mix.domains, mix.languages, mix.sources)
    budgets: dict[tuple, int] = {(): min(total, every * mix.epochs)}
    for depth in range(3):
        most: dict[tuple, int] = {}
        for leaf, n in tokens.items():
            most[leaf[: depth + 1]] = most.get(leaf[: depth + 1], 0) + n * mix.epochs
        deeper = {}
        for parent, budget in budgets.items():
            shared = share_out(budget, [(k[-1], weights[depth].get(k[-1], 1), m) for k, m in most.items() if k[:-1] == parent])
            deeper |= {(*parent, name): n for name, n in shared.items()}
        budgets = deeper
    return budgets


def _named(column: Column, names) -> Column:
    return F.when(column.isin(*names), column).otherwise(OTHER) if names else F.lit(OTHER)


def _leaves(lang: Column, source: Column, mix: Mix) -> list[Column]:
    domain = F.lit(OTHER)
    for name in sorted(set(mix.domain_of.values())):
        domain = F.when(source.isin(*sorted(s for s, d in mix.domain_of.items() if d == name)), name).otherwise(domain)
    return [domain.alias("domain"), _named(lang, sorted(mix.languages)).alias("lang"), _named(source, sorted(mix.sources)).alias("source")]


#: What is added to each row taken: its leaf, its tokens and the epoch.
ADDED = ("_domain", "_lang", "_source", "_tokens", "_epoch")


def mixed(docs: DataFrame, mix: Mix, tokens: str | None = None) -> DataFrame:
    """The rows of ``docs`` that the mix takes, once for each epoch that takes them.

    All columns stay; ``ADDED`` follow: the leaf, the tokens (of the column ``tokens``, such as another
    operator's counts, null as none; without one, the words between white space, none in a null text)
    and the epoch (from 0). Where ``docs`` has a column of such a name, the added one gets underscores
    before it. A null or unnamed source or language belongs to ``(other)``. Within an epoch, a row is
    taken if the tokens before it are fewer than the leaf's rest, so a leaf is over its budget by less
    than one document; rows of equal doc_id are taken together. A leaf without tokens gives nothing.
    """
    spark = docs.sparkSession
    of = {c: docs[c] if c in docs.columns else F.lit(None).cast(kind) for c, kind in (("doc_id", "long"), ("text", "string"), ("lang", "string"), ("source", "string"))}
    n_tokens = docs[tokens] if tokens else F.regexp_count(of["text"], F.lit(r"[^\x20\x09-\x0D]+"))
    names = ["domain", "lang", "source"]
    # The documents' own columns go by their place, so that no name meets another.
    own = [docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)]
    rows = docs.select(*own, of["doc_id"].alias("id"), *_leaves(of["lang"], of["source"], mix), F.coalesce(n_tokens, F.lit(0)).cast("long").alias("tokens"))
    small = common.written(rows.select("id", *names, "tokens"), "mix-rows")
    total = {tuple(r[c] for c in names): r.n for r in small.groupBy(*names).agg(F.sum("tokens").alias("n")).collect()}
    budgets = leaf_budgets({k: n for k, n in total.items() if n}, mix)
    plan = [(*k, b // total[k], b % total[k]) for k, b in sorted(budgets.items())]
    plan = F.broadcast(spark.createDataFrame(plan, "domain string, lang string, source string, whole long, rest long"))

    key = F.md5(F.concat_ws(":", F.lit(str(mix.seed)), F.col("whole").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"))
    keyed = small.join(plan, names).where("rest > 0").withColumn("key", key).withColumn("digits", F.substring("key", 1, DIGITS))
    sums = keyed.groupBy(*names, "rest", "digits").agg(F.sum("tokens").alias("n"))
    up_to = Window.partitionBy(*names).orderBy("digits").rowsBetween(Window.unboundedPreceding, 0)
    # The digits under which the rest is used up: the first whose sum reaches it.
    ends = sums.withColumn("sum", F.sum("n").over(up_to)).where("sum >= rest").groupBy(*names).agg(F.min(F.struct("digits", (F.col("sum") - F.col("n")).alias("before"))).alias("end"))
    ends = F.broadcast(ends.select(*names, F.col("end.digits").alias("end"), F.col("end.before").alias("before")))
    there = keyed.join(ends, names).where("digits = end")
    so_far = Window.partitionBy(*names, "digits").orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    reached = there.withColumn("sum", F.col("before") + F.sum("tokens").over(so_far)).where("sum >= rest")
    cuts = {tuple(r[c] for c in names): r.cut for r in reached.groupBy(*names).agg(F.min("key").alias("cut")).collect()}
    common.drop_written(small)

    full = [(*k, b // total[k], cuts.get(k)) for k, b in sorted(budgets.items())]
    full = F.broadcast(spark.createDataFrame(full, "domain string, lang string, source string, whole long, cut string"))
    taken = rows.join(full, names).withColumn("last", F.when(key <= F.col("cut"), F.col("whole")).otherwise(F.col("whole") - 1))
    taken = taken.where("last >= 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("last").cast("int"))))
    added = common.free_names(docs, *ADDED)
    return taken.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)), *(F.col(c).alias(n) for c, n in zip((*names, "tokens", "epoch"), added, strict=True)))


def mix_sql(mix: Mix) -> str:
    """DuckDB SQL for ``doc_id, domain, lang, source, n_tokens, epoch`` of the rows that the mix takes."""

    def table(name: str, of: dict[str, int]) -> str:
        return f"{name}(name, w) AS (VALUES " + ", ".join(f"('{k}', {w})" for k, w in sorted(of.items())) + ")"

    def level(out: str, parents: str, keys: list[str], name: str, weights: str) -> str:
        by = f"PARTITION BY {', '.join(keys)}" if keys else ""
        every = ", ".join([*keys, name])
        on = " AND ".join(f"p.{k} = x.{k}" for k in keys) or "true"
        return f"""
        {out}_most AS (SELECT {every}, CAST(sum(n) AS HUGEINT) * {mix.epochs} AS most FROM leaves GROUP BY {every}),
        {out}_known AS (
            SELECT x.*, p.budget, CAST(coalesce(w.w, 1) AS HUGEINT) AS w
            FROM {out}_most x JOIN {parents} p ON {on} LEFT JOIN {weights} w ON w.name = x.{name}
        ), {out}_order AS (
            SELECT *, CAST(coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS HUGEINT) AS used,
                CAST(sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS HUGEINT) AS rest
            FROM {out}_known WINDOW o AS ({by} ORDER BY CAST(most AS DOUBLE) / CAST(w AS DOUBLE), {name})
        ), {out}_full AS (SELECT *, most * rest <= (budget - used) * w AS whole FROM {out}_order),
        {out} AS (
            SELECT {every}, CASE WHEN whole THEN most ELSE
                (budget - CAST(coalesce(sum(most) FILTER (whole) OVER ({by}), 0) AS HUGEINT)) * w // CAST(sum(w) FILTER (NOT whole) OVER ({by}) AS HUGEINT) END AS budget
            FROM {out}_full
        )"""

    domain = " ".join(f"WHEN source IN ({', '.join(repr(s) for s in sorted(k for k, v in mix.domain_of.items() if v == d))}) THEN '{d}'" for d in sorted(set(mix.domain_of.values())))
    listed = lambda of: ", ".join(repr(k) for k in sorted(of))
    total = str(mix.total_tokens) if mix.total_tokens is not None else f"sum(n) * {mix.share[0]} // {mix.share[1]}"
    return f"""
        WITH {table("dw", mix.domains)}, {table("lw", mix.languages)}, {table("sw", mix.sources)},
        docs AS (
            SELECT doc_id, CASE {domain} ELSE '{OTHER}' END AS domain,
                CASE WHEN lang IN ({listed(mix.languages)}) THEN lang ELSE '{OTHER}' END AS lang,
                CASE WHEN source IN ({listed(mix.sources)}) THEN source ELSE '{OTHER}' END AS source,
                CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens
            FROM documents
        ), leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS HUGEINT) AS n FROM docs GROUP BY ALL HAVING sum(n_tokens) > 0),
        root AS (SELECT CAST(least({total}, sum(n) * {mix.epochs}) AS HUGEINT) AS budget FROM leaves),
        {level("d", "root", [], "domain", "dw")}, {level("l", "d", ["domain"], "lang", "lw")}, {level("s", "l", ["domain", "lang"], "source", "sw")},
        plan AS (SELECT s.domain, s.lang, s.source, budget // n AS whole, budget % n AS rest FROM s JOIN leaves USING (domain, lang, source)),
        keyed AS (
            SELECT d.*, p.whole, p.rest, md5('{mix.seed}:' || CAST(p.whole AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
            FROM docs d JOIN plan p USING (domain, lang, source)
        ), placed AS (
            SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key GROUPS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
            FROM keyed
        )
        SELECT doc_id, domain, lang, source, n_tokens, CAST(unnest(range(0, CAST(whole + CASE WHEN before < rest THEN 1 ELSE 0 END AS BIGINT))) AS INTEGER) AS epoch
        FROM placed
    """
