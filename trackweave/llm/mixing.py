"""Mixing sources to target weights by hierarchical budgeting over a domain > language > source tree.

Each leaf can supply `max_epochs` times its tokens. Budgets flow from the root: a node's budget is
split among its children by weight, a child that cannot use its share is filled up and the rest is
shared again among its siblings (water-filling), and only what all siblings together cannot take
stays unused at the parent, whose own siblings then get it, since a parent's capacity is the sum of
its children's. A leaf with budget b and supply s takes floor(b / s) whole epochs and, from the next
epoch's seeded order, the longest prefix of documents whose tokens fit in the rest.

Only tables of one row per leaf or per (leaf, hash bucket) are windowed. Documents are compared with
their leaf's cut; in the single bucket where the cut falls, rows of equal order key and length are counted in SLICES
parts first, and rows are numbered one by one only inside the part where the cut falls.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from trackweave.llm.common import settled

LEVELS = ("domain", "lang", "source")
#: Tasks that a leaf's documents are dealt to where the leaves are too many for a broadcast.
SALTS = 64
#: Parts of rows that no key tells apart.
SLICES = 256


@dataclass(frozen=True)
class MixPlan:
    """Integer weights by level; names not listed get `default_weight`.

    domains: (name, regex on source) tried in order; `other_domain` when none matches.
    budget_percent: total budget as a percentage of all tokens. bucket_digits: hex digits of the order key per bucket.
    broadcast_leaves: up to so many leaves, counted, their rows (about 100 bytes each) are broadcast.
    """

    domain_weights: Mapping[str, int] = field(default_factory=lambda: {"web": 55, "reference": 30, "forum": 15})
    lang_weights: Mapping[str, int] = field(default_factory=lambda: {"en": 60, "de": 15, "fr": 15, "es": 10})
    source_weights: Mapping[str, int] = field(default_factory=dict)
    domains: tuple = (("web", r"^src\d$"), ("reference", r"^src1[0-4]$"), ("forum", r"^src1[5-9]$"))
    other_domain: str = "web"
    default_weight: int = 10
    budget_percent: int = 80
    max_epochs: int = 3
    seed: int = 7
    bucket_digits: int = 3
    broadcast_leaves: int = 100_000


def _weight(column: str, weights: Mapping[str, int], default: int) -> Column:
    out = F.lit(default)
    for name, w in weights.items():
        out = F.when(F.col(column) == name, F.lit(int(w))).otherwise(out)
    return out.cast("bigint")


def token_count(text: Column) -> Column:
    """Whitespace-separated words of the whole text; null counts 0."""
    return F.coalesce(F.length(F.regexp_replace(F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x"), r"[\x20\x09-\x0D]+", "")), F.lit(0)).cast("bigint")


def with_leaves(docs: DataFrame, plan: MixPlan, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, tokens, the tree levels, _row (a number of its own) and _kept (the columns `keep`). Null language or source: 'unknown'."""
    source = F.coalesce(F.col("source"), F.lit("unknown"))
    domain = F.lit(plan.other_domain)
    for name, pattern in reversed(plan.domains):
        domain = F.when(source.rlike(pattern), F.lit(name)).otherwise(domain)
    kept = F.struct(*keep) if keep else F.lit(None).cast("int")
    return docs.select("doc_id", token_count(F.col("text")).alias("tokens"), domain.alias("domain"), F.coalesce(F.col("lang"), F.lit("unknown")).alias("lang"), source.alias("source"), F.monotonically_increasing_id().alias("_row"), kept.alias("_kept"))


def _water_fill(nodes: DataFrame, parent: list[str], name: str, budget: str, out: str) -> DataFrame:
    """Splits `budget`, the same in all rows of a parent, over children by `weight` and `capacity`, all whole numbers.

    In ascending capacity / weight, a child is full if its capacity is within its share of what the
    children before it left; from the first one that isn't, all get their share of the rest.
    """
    by = W.partitionBy(*parent).orderBy(F.col("capacity") / F.col("weight"), name)
    before = by.rowsBetween(W.unboundedPreceding, -1)
    x = nodes.withColumns({"_used": F.coalesce(F.sum("capacity").over(before), F.lit(0)), "_weights": F.sum("weight").over(by.rowsBetween(0, W.unboundedFollowing))})
    share = F.expr(f"({budget} - _used) * weight div _weights")
    x = x.withColumn("_full", F.col("capacity") <= share)
    x = x.withColumn("_open", F.max(F.when(~F.col("_full"), F.lit(1)).otherwise(0)).over(by.rowsBetween(W.unboundedPreceding, 0)))
    first = W.partitionBy(*parent)
    level = x.withColumns({"_left": F.max(F.when(F.col("_open") == 1, F.expr(f"{budget} - _used"))).over(first), "_rest": F.max(F.when(F.col("_open") == 1, F.col("_weights"))).over(first)})
    return level.withColumn(out, F.when(F.col("_open") == 0, F.col("capacity")).otherwise(F.least(F.col("capacity"), F.expr("greatest(_left, 0L) * weight div _rest")))).drop("_used", "_weights", "_full", "_open", "_left", "_rest")


def leaf_budgets(leaves: DataFrame, plan: MixPlan) -> DataFrame:
    """Input: domain, lang, source, supply. Adds budget, epochs (whole ones) and rest (tokens of the next one)."""
    leaves = leaves.withColumn("capacity", F.col("supply") * plan.max_epochs)
    domains = leaves.groupBy("domain").agg(F.sum("capacity").alias("capacity"), F.sum("supply").alias("supply")).withColumn("weight", _weight("domain", plan.domain_weights, plan.default_weight))
    total = domains.agg(F.expr(f"sum(supply) * {plan.budget_percent} div 100").alias("total"))
    domains = _water_fill(domains.crossJoin(F.broadcast(total)).withColumn("_root", F.lit(0)), ["_root"], "domain", "total", "domain_budget").select("domain", "domain_budget")
    langs = leaves.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity")).withColumn("weight", _weight("lang", plan.lang_weights, plan.default_weight)).join(domains, "domain")
    langs = _water_fill(langs, ["domain"], "lang", "domain_budget", "lang_budget").select("domain", "lang", "lang_budget")
    out = leaves.withColumn("weight", _weight("source", plan.source_weights, plan.default_weight)).join(langs, ["domain", "lang"])
    out = _water_fill(out, ["domain", "lang"], "source", "lang_budget", "budget")
    return out.select(*LEVELS, "supply", "budget", F.expr("if(supply > 0, budget div supply, 0L)").alias("epochs"), F.expr("if(supply > 0, budget % supply, 0L)").alias("rest"))


def order_key(doc_id: Column, epoch: Column, seed: int) -> Column:
    """A seeded order of each epoch, the same on any cluster."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def _with_leaf(keyed: DataFrame, leaves: DataFrame, few: bool) -> DataFrame:
    """Joins its leaf's row to each document: broadcast where the leaves, counted before, are few; else by leaf and salt, so that a large leaf is dealt to SALTS tasks."""
    if few:
        return keyed.join(F.broadcast(leaves), list(LEVELS))
    salted = leaves.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int")
    return keyed.withColumn("_salt", salt).join(salted, [*LEVELS, "_salt"]).drop("_salt")


def mix(docs: DataFrame, plan: MixPlan = MixPlan(), keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, domain, lang, source, tokens, copies, and the columns `keep`, of every document that is taken at least once.

    Nulls: a null or empty text has 0 tokens and never ends a prefix; null lang and source form the
    leaf 'unknown'; a null doc_id is ordered as ''. Repeated rows are separate documents; of rows of equal order key the shorter
    come first, and of equally long ones as many as fit are taken, by a running number. An empty table gives an
    empty result. Extra columns are ignored.
    """
    keyed = settled(with_leaves(docs, plan, keep))  # the texts are read once
    leaves = settled(leaf_budgets(keyed.groupBy(*LEVELS).agg(F.sum("tokens").alias("supply")), plan).select(*LEVELS, "epochs", "rest"))
    few = leaves.count() <= plan.broadcast_leaves
    ordered = _with_leaf(keyed, leaves, few).withColumn("_key", order_key(F.col("doc_id"), F.col("epochs"), plan.seed))
    ordered = ordered.withColumn("_bucket", F.substring("_key", 1, plan.bucket_digits))
    buckets = ordered.groupBy(*LEVELS, "_bucket").agg(F.sum("tokens").alias("_tokens"), F.first("rest").alias("rest"))
    x = _with_leaf(ordered, settled(leaves.select(*LEVELS).join(_cut(buckets, ["_bucket"], F.lit(0)), list(LEVELS), "left")), few)
    whole = x.filter("_cut is null or _bucket <> _cut._bucket").withColumn("_in", F.expr("_cut is null or _bucket < _cut._bucket"))
    split = x.filter("_bucket = _cut._bucket").withColumn("_slice", F.pmod(F.xxhash64("_row"), F.lit(SLICES)))
    groups = split.groupBy(*LEVELS, "_key", "tokens", "_slice").agg(F.sum("tokens").alias("_tokens"), F.first("rest").alias("rest"), F.first("_base").alias("_before"))
    at = settled(_cut(groups, ["_key", "tokens", "_slice"], F.col("_before")))
    split = _with_leaf(split.drop("_cut", "_base"), at, few)
    place = F.struct("_key", "tokens", "_slice")
    sides = split.filter(place != F.col("_cut")).withColumn("_in", place < F.col("_cut"))
    last = split.filter(place == F.col("_cut")).withColumn("_in", F.col("_base") + F.sum("tokens").over(W.partitionBy(*LEVELS).orderBy("_row").rowsBetween(W.unboundedPreceding, 0)) <= F.col("rest"))
    copies = (F.col("epochs") + F.when(F.col("_in"), 1).otherwise(0)).cast("bigint").alias("copies")
    parts = [part.select("doc_id", *LEVELS, "tokens", copies, *(F.col(f"_kept.{c}").alias(c) for c in keep)) for part in (whole, sides, last)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).filter("copies > 0")


def _cut(groups: DataFrame, order: list[str], before: Column) -> DataFrame:
    """LEVELS, _cut (the group, by `order`, in which a leaf's rest ends) and _base (tokens before it, with those of `before`), of leaves that don't take all groups."""
    upto = before + F.sum("_tokens").over(W.partitionBy(*LEVELS).orderBy(*order))
    cut = groups.withColumn("_upto", upto).filter("_upto > rest").groupBy(*LEVELS).agg(F.min(F.struct(F.struct(*order).alias("at"), (F.col("_upto") - F.col("_tokens")).alias("base"))).alias("_cut"))
    return cut.select(*LEVELS, F.col("_cut.at").alias("_cut"), F.col("_cut.base").alias("_base"))


def mix_sql(plan: MixPlan = MixPlan()) -> str:
    """The same in DuckDB SQL over `documents`."""
    case = lambda col, ws: "case " + " ".join(f"when {col} = '{k}' then {v}" for k, v in ws.items()) + f" else {plan.default_weight} end" if ws else str(plan.default_weight)
    domain = "case " + " ".join(f"when regexp_matches(coalesce(source, 'unknown'), '{p}') then '{n}'" for n, p in plan.domains) + f" else '{plan.other_domain}' end"

    def fill(rows: str, parent: str, name: str, budget: str, keep: str, out: str) -> str:
        return f"""(select {keep}, case when open_ = 0 then capacity else least(capacity, greatest(max(case when open_ = 1 then {budget} - used end) over (partition by {parent}), 0) * weight // max(case when open_ = 1 then weights end) over (partition by {parent})) end as {out}
          from (select *, max(case when capacity <= ({budget} - used) * weight // weights then 0 else 1 end) over (partition by {parent} order by capacity / weight, {name} rows unbounded preceding) open_
          from (select *, coalesce(sum(capacity) over (partition by {parent} order by capacity / weight, {name} rows between unbounded preceding and 1 preceding), 0) used,
            sum(weight) over (partition by {parent} order by capacity / weight, {name} rows between current row and unbounded following) weights from ({rows}))))"""

    return f"""
    with keyed as (select doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint tokens, {domain} as domain, coalesce(lang, 'unknown') lang, coalesce(source, 'unknown') source from documents),
    leaves as (select domain, lang, source, sum(tokens)::bigint supply, sum(tokens)::bigint * {plan.max_epochs} capacity from keyed group by all),
    d as {fill(f"select domain, 0 root, sum(capacity)::bigint capacity, {case('domain', plan.domain_weights)} weight, (select sum(supply)::bigint * {plan.budget_percent} // 100 from leaves) total from leaves group by domain", "root", "domain", "total", "domain", "domain_budget")},
    l as {fill(f"select a.*, domain_budget from (select domain, lang, sum(capacity)::bigint capacity, {case('lang', plan.lang_weights)} weight from leaves group by all) a join d using (domain)", "domain", "lang", "domain_budget", "domain, lang", "lang_budget")},
    s as {fill(f"select v.*, lang_budget, {case('source', plan.source_weights)} weight from leaves v join l using (domain, lang)", "domain, lang", "source", "lang_budget", "domain, lang, source, supply", "budget")},
    b as (select *, case when supply > 0 then budget // supply else 0 end epochs, case when supply > 0 then budget % supply else 0 end rest from s),
    o as (select k.*, epochs, rest, sum(tokens) over (partition by domain, lang, source order by md5(concat_ws(':', '{plan.seed}', epochs::bigint::varchar, coalesce(doc_id::varchar, ''))), doc_id, tokens rows unbounded preceding) upto from keyed k join b using (domain, lang, source))
    select doc_id, domain, lang, source, tokens, (epochs + case when upto <= rest then 1 else 0 end)::bigint copies from o where epochs + case when upto <= rest then 1 else 0 end > 0"""
