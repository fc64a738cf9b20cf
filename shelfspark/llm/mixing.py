"""Mixing sources to target weights: hierarchical token budgets and seeded epochs.

The leaves are domain, language and source. A budget of tokens flows down the tree by the weights of siblings; what a
child can't take (its leaves' tokens times the epochs allowed) goes to its siblings by their weights, and only what no
sibling can take is left to the level above. Level by level that is a water-filling with a closed form over sorted
ratios of capacity to weight, so it is a window over the (small) table of nodes. Each leaf then reads whole epochs, and
of one more seeded permutation the token-prefix that fills its budget. Prefix sums go over hash buckets first and over
rows only within the one bucket where the prefix ends, so no leaf, however large, is sorted in one task, and texts are
never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

DOMAINS = {"web": [f"src{i}" for i in range(10)], "reference": [f"src{i}" for i in range(10, 16)], "forum": [f"src{i}" for i in range(16, 20)]}
DOMAIN_WEIGHTS = {"web": 0.5, "reference": 0.3, "forum": 0.2}
LANG_WEIGHTS = {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}
OTHER_WEIGHT = 0.05
MAX_EPOCHS, SEED = 4, 17
LEAF = ["domain", "lang", "source"]
_BLANK = "[^\\x09-\\x0d\\x20]+"


def _weight(col: str, weights: dict[str, float]) -> Column:
    out = F.lit(OTHER_WEIGHT)
    for k, w in weights.items():
        out = F.when(F.col(col) == k, F.lit(w)).otherwise(out)
    return out


def _leaves() -> list[Column]:
    domain = F.lit("other")
    for k, sources in DOMAINS.items():
        domain = F.when(F.col("source").cast("string").isin(sources), F.lit(k)).otherwise(domain)
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c)
    return [domain.alias("domain"), named("lang"), named("source")]


def tokens(text: str = "text") -> Column:
    """Tokens of a text: maximal runs of signs other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(_BLANK)), F.lit(0)).cast("long")


def _fill(nodes: DataFrame, parent: list[str], budget: Column) -> DataFrame:
    """``nodes`` (cap, w) with ``got``: the parent's budget by weight, no node beyond its cap."""
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    node = [c for c in LEAF if c in nodes.columns]
    upto = by.orderBy("ratio", *node).rowsBetween(Window.unboundedPreceding, 0)
    d = nodes.withColumn("b", budget).withColumn("ratio", F.col("cap") / F.col("w"))
    d = d.withColumn("cap_upto", F.sum("cap").over(upto)).withColumn("w_after", F.sum("w").over(by) - F.sum("w").over(upto))
    d = d.withColumn("full", F.col("cap_upto") + F.col("ratio") * F.greatest(F.col("w_after"), F.lit(0.0)) <= F.col("b") + 1e-6)
    level = (F.col("b") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(by), F.lit(0.0))) / F.sum(F.when(~F.col("full"), F.col("w"))).over(by)
    d = d.withColumn("level", level)
    return d.withColumn("got", F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("w") * F.col("level")))).drop("b", "ratio", "cap_upto", "w_after", "full", "level")


def leaf_budgets(leaves: DataFrame, budget: int | None = None, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``leaves`` (domain, lang, source, have) with ``budget`` in whole tokens, ``epochs`` read in full and ``rest`` tokens of one more.

    Without a ``budget`` it is what all leaves have. Leaves without tokens get nothing.
    """
    d = leaves.where("have > 0").withColumn("cap", F.col("have").cast("double") * max_epochs)
    total = F.lit(float(budget)) if budget is not None else F.sum("have").over(Window.partitionBy(F.lit(0))).cast("double")
    with_total = d.withColumn("total", total)
    top = with_total.groupBy("domain").agg(F.sum("cap").alias("cap"), F.max("total").alias("total")).withColumn("w", _weight("domain", DOMAIN_WEIGHTS))
    top = _fill(top, [], F.col("total")).select("domain", F.col("got").alias("d_got"))
    mid = d.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).withColumn("w", _weight("lang", LANG_WEIGHTS)).join(top, "domain")
    mid = _fill(mid, ["domain"], F.col("d_got")).select("domain", "lang", F.col("got").alias("l_got"))
    low = _fill(d.withColumn("w", F.lit(1.0)).join(mid, ["domain", "lang"]), ["domain", "lang"], F.col("l_got"))
    b = F.floor(F.col("got") + 1e-3).cast("long")
    return low.select(*LEAF, "have", b.alias("budget")).select("*", F.expr("budget div have").alias("epochs"), F.expr("budget % have").alias("rest"))


def _key(epoch: str, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(epoch).cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def _plan(docs: DataFrame, budget: int | None, max_epochs: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The narrow rows (doc_id, th, leaf, n), and by leaf what it reads: epochs, rest and the order value where the prefix ends."""
    rows = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("th"), *_leaves(), tokens().alias("n")).where("n > 0"))
    leaves = stored(leaf_budgets(rows.groupBy(*LEAF).agg(F.sum("n").alias("have")), budget, max_epochs))
    part = rows.join(leaves.where("rest > 0"), LEAF).withColumn("key", _key("epochs", seed)).withColumn("bucket", F.substring("key", 1, 3))
    sums = part.groupBy(*LEAF, "bucket").agg(F.sum("n").alias("n"), F.max("rest").alias("rest"))
    before = F.sum("n").over(Window.partitionBy(*LEAF).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    last = stored(sums.withColumn("before", before).where("before < rest").groupBy(*LEAF).agg(F.max_by("bucket", "bucket").alias("last"), F.max("before").alias("base")))
    order = Window.partitionBy(*LEAF).orderBy("key", "doc_id", "th").rangeBetween(Window.unboundedPreceding, 0)
    same = Window.partitionBy(*LEAF, "key", "doc_id", "th")
    edge = part.join(last, LEAF).where("bucket = last").withColumn("before", F.col("base") + F.sum("n").over(order) - F.sum("n").over(same))
    ends = edge.where("before < rest").groupBy(*LEAF).agg(F.max(F.struct("key", F.col("doc_id").isNotNull().alias("has"), "doc_id", "th")).alias("end"), F.max("before").alias("end_before"))
    return rows, stored(leaves.join(ends, LEAF, "left"))


def _reads(d: DataFrame, seed: int) -> DataFrame:
    """Rows with their leaf's plan, one for each epoch that reads them."""
    d = d.withColumn("__key", _key("epochs", seed))
    here = F.struct(F.col("__key").alias("key"), F.col("doc_id").isNotNull().alias("has"), F.col("doc_id").cast("long").alias("doc_id"), F.col("th").alias("th"))
    times = F.col("epochs") + F.when(F.col("end").isNotNull() & (here <= F.col("end")), 1).otherwise(0)
    return d.withColumn("__last", F.col("end").isNotNull() & (here == F.col("end"))).withColumn("epoch", F.explode(F.when(times > 0, F.sequence(F.lit(0).cast("long"), times - 1)).otherwise(F.array().cast("array<bigint>"))))


def mix(docs: DataFrame, budget: int | None = None, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """What each leaf reads: doc_id, domain, lang, source, epoch (from 0), order_key and take_tokens.

    A document comes once for each epoch that reads it; within an epoch the order is that of order_key (then doc_id).
    All of a document is read, but for the one at which the leaf's budget ends: there ``take_tokens`` are those within
    the budget. Domains, languages or sources that no weight is given for share ``OTHER_WEIGHT`` each; null languages and
    sources are "unknown". Null, empty and blank texts have no tokens and are never read. Repeated rows (same doc_id and
    text) stand at one place of the order: the budget's end takes all or none of them. An empty table gives none; other
    columns are ignored.
    """
    rows, plan = _plan(docs, budget, max_epochs, seed)
    d = _reads(rows.join(plan, LEAF), seed)
    cut = F.when(F.col("__last") & (F.col("epoch") == F.col("epochs")), F.least(F.col("n"), F.col("rest") - F.col("end_before"))).otherwise(F.col("n"))
    return d.withColumn("order_key", _key("epoch", seed)).select("doc_id", *LEAF, "epoch", "order_key", cut.alias("take_tokens"))


def select(docs: DataFrame, budget: int | None = None, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The documents that ``mix`` reads, as often as it reads them, whole and with all their columns as they came."""
    _, plan = _plan(docs, budget, max_epochs, seed)
    plan = plan.select(*(F.col(c).alias(f"__{c}") for c in LEAF), "epochs", "rest", "end")
    row = docs.select(F.struct("*").alias("__row"), "doc_id", F.xxhash64(F.col("text").cast("string")).alias("th"), *(c.alias(f"__{n}") for c, n in zip(_leaves(), LEAF, strict=True)), F.col("text").cast("string").rlike(_BLANK).alias("__some"))
    d = row.where("__some").join(plan, [f"__{c}" for c in LEAF])
    return _reads(d, seed).select("__row.*")


def _case(col: str, pairs: list[tuple[str, str]], other: str) -> str:
    return "case " + " ".join(f"when {col} in ({k}) then {v}" for k, v in pairs) + f" else {other} end"


def _fill_sql(name: str, source: str, parent: str, node: str, budget: str) -> str:
    by = f"partition by {parent}" if parent else ""
    return f"""
{name}_r as (select *, {budget} as b, cap / w as ratio from {source}),
{name}_s as (select *, sum(cap) over ({by} order by ratio, {node} rows unbounded preceding) as cap_upto,
    sum(w) over ({by}) - sum(w) over ({by} order by ratio, {node} rows unbounded preceding) as w_after from {name}_r),
{name}_f as (select *, cap_upto + ratio * greatest(w_after, 0) <= b + 1e-6 as filled from {name}_s),
{name} as (select *, case when filled then cap else least(cap, w * (b - coalesce(sum(case when filled then cap end) over ({by}), 0))
    / sum(case when not filled then w end) over ({by})) end as got from {name}_f)"""


_quoted = lambda xs: ", ".join(f"'{x}'" for x in xs)
ORACLE = rf"""
with rows_ as (select doc_id, {_case("source", [(_quoted(v), f"'{k}'") for k, v in DOMAINS.items()], "'other'")} as domain,
    coalesce(lang, 'unknown') as lang, coalesce(source, 'unknown') as source,
    len(regexp_extract_all(text, '[^\x09-\x0d\x20]+')) as n from documents where text is not null),
leaves as (select domain, lang, source, sum(n) as have, sum(n)::double * {MAX_EPOCHS} as cap, 1.0::double as w from rows_ where n > 0 group by all),
tops as (select domain, sum(cap) as cap, {_case("domain", [(f"'{k}'", f"{v}::double") for k, v in DOMAIN_WEIGHTS.items()], f"{OTHER_WEIGHT}::double")} as w from leaves group by domain),
{_fill_sql("top", "tops", "", "domain", "(select sum(have)::double from leaves)")},
mids as (select l.domain, l.lang, sum(l.cap) as cap, any_value(top.got) as up, {_case("l.lang", [(f"'{k}'", f"{v}::double") for k, v in LANG_WEIGHTS.items()], f"{OTHER_WEIGHT}::double")} as w
    from leaves l join top using (domain) group by l.domain, l.lang),
{_fill_sql("mid", "mids", "domain", "lang", "up")},
lows as (select l.*, mid.got as up from leaves l join mid using (domain, lang)),
{_fill_sql("low", "lows", "domain, lang", "source", "up")},
plan as (select domain, lang, source, have::bigint as have, floor(got + 1e-3)::bigint as budget, floor(got + 1e-3)::bigint // have::bigint as epochs,
    floor(got + 1e-3)::bigint % have::bigint as rest from low),
parts as (select r.*, p.epochs, p.rest, sum(n) over (partition by r.domain, r.lang, r.source order by md5(concat_ws(':', '{SEED}', p.epochs, r.doc_id)), r.doc_id rows unbounded preceding) - n as before
    from rows_ r join plan p using (domain, lang, source) where n > 0),
reads as (select doc_id, domain, lang, source, unnest(range(0, epochs)) as epoch, n as take from parts
    union all select doc_id, domain, lang, source, epochs, least(n, rest - before) from parts where before < rest)
select doc_id, domain, lang, source, epoch::bigint as epoch, md5(concat_ws(':', '{SEED}', epoch, doc_id)) as order_key, take::bigint as take_tokens from reads
"""
