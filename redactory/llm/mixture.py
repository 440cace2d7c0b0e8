"""Mixing sources to target weights by hierarchical budgets.

Leaves are (domain, language, source). The tree's weights are whole numbers with defaults for names that are not listed. A token budget
goes down the tree: at each node it is shared among the children by weight, no child above its capacity (its tokens times `epochs`);
what a child can't take goes to its siblings by their weights, and only what all siblings together can't take is missing at their
parent, whose own siblings then take it. Shares are whole tokens: the threshold at which children are full is found on their order by
capacity over weight with running sums, and what rounding leaves goes to the first children in that order, one token each.

A leaf's documents stand in an order of their own in every epoch, by a seeded hash of epoch and document. The leaf's tokens are the
prefix of that sequence: whole epochs, then the documents of the next one whose running sum stays within the leaf's budget. The sum is
taken in two steps, over ranges of the hash and inside the one range that the budget ends in, so no task holds a leaf.

Defined cases: null texts have no tokens and go with the prefix they stand in; null domain, language or source are names of their own;
an empty table gives no rows; repeated rows are separate documents in one place of the order, taken or left together; a leaf of weight
zero gets nothing; all columns are kept, whatever their names, but those that mix() adds (COLUMNS) take the place of columns so named.

A task holds the children of one node of the tree at most, one narrow row for each.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redactory.session import ROWS_PER_FILE, forget, materialize

LEVELS = ("__domain", "__lang", "__source")
#: Name of a null domain, language or source.
NO_NAME = "\0"
#: What mix() adds to the columns of a table.
COLUMNS = (*LEVELS, "__tokens", "__copies")
#: Bits of a document's place in the order of an epoch.
ORDER_BITS = 60


@dataclass(frozen=True)
class Tree:
    """Weights by path: ("web",), ("web", "en"), ("web", "en", "src0"). `*` stands for any name; the longest path without it wins."""

    weights: dict[tuple[str, ...], int] = field(default_factory=dict)
    default: int = 1

    def column(self, level: int) -> Column:
        """Weight of the node at a level (1 to 3) from the columns of LEVELS."""
        paths = sorted((p for p in self.weights if len(p) == level), key=lambda p: p.count("*"))
        out = F.lit(self.default)
        for p in reversed(paths):
            match = reduce(lambda a, b: a & b, (F.col(c) == x for c, x in zip(LEVELS, p, strict=False) if x != "*"), F.lit(True))
            out = F.when(match, F.lit(self.weights[p])).otherwise(out)
        return out.cast("long")

    def sql(self, level: int, names: list[str]) -> str:
        """column() as SQL over columns of these names."""
        quoted = lambda x: "'" + x.replace("'", "''") + "'"
        paths = sorted((p for p in self.weights if len(p) == level), key=lambda p: p.count("*"))
        when = "".join(f" WHEN {' AND '.join([f'{n} = {quoted(x)}' for n, x in zip(names, p, strict=False) if x != '*'] or ['true'])} THEN {self.weights[p]}" for p in paths)
        return f"CASE{when} ELSE {self.default} END" if when else str(self.default)


def share(children: DataFrame, parents: DataFrame | None, by: list[str], name: str, budget: Column | None = None) -> DataFrame:
    """children (by + name, weight, capacity) with their share of the parents' (by, share), as whole tokens."""
    if parents is not None:
        rows = children.join(parents.select(*by, F.col("share").alias("budget")), by)
    else:
        rows = children.withColumn("budget", budget)
    rows = rows.withColumn("capacity", F.when(F.col("weight") > 0, F.col("capacity")).otherwise(F.lit(0).cast("long")))
    # order of filling: capacity over weight, by its whole part and the rest's; the double of the latter is exact enough for weights below 2^26
    whole = F.when(F.col("weight") > 0, F.expr("capacity div weight")).otherwise(F.lit(-1).cast("long"))
    order = [whole, F.when(F.col("weight") > 0, F.col("capacity") % F.col("weight") / F.col("weight")).otherwise(F.lit(0.0)), F.col(name)]
    w = Window.partitionBy(*by).orderBy(*order)
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumns({"below": F.coalesce(F.sum("capacity").over(before), F.lit(0)), "open_weight": F.sum("weight").over(after), "rank": F.row_number().over(w)})
    part = lambda x: x.cast("decimal(38,0)")  # noqa: E731  products of tokens and weights
    full = part(F.col("capacity")) * part(F.col("open_weight")) <= part(F.col("weight")) * part(F.col("budget") - F.col("below"))
    rows = rows.withColumn("full", F.coalesce(full, F.lit(True)))
    # the first child that isn't full sets the share of all after it
    whole = Window.partitionBy(*by)
    first = F.min(F.when(~F.col("full"), F.struct("rank", "below", "open_weight"))).over(whole)
    rows = rows.withColumn("at", first)
    open_ = F.col("rank") >= F.col("at.rank")
    floor = F.expr("CAST((CAST(weight AS DECIMAL(19,0)) * CAST(budget - at.below AS DECIMAL(19,0))) div CAST(at.open_weight AS DECIMAL(19,0)) AS BIGINT)")
    rows = rows.withColumn("share", F.when(open_ & (F.col("weight") > 0), floor).otherwise(F.col("capacity")))
    left = F.least(F.col("budget"), F.sum("capacity").over(whole)) - F.sum("share").over(whole)
    one = F.when(open_ & (F.col("share") < F.col("capacity")) & (F.col("rank") - F.col("at.rank") < left), 1).otherwise(0)
    return rows.withColumn("share", (F.col("share") + one).cast("long")).select(*by, name, "weight", "capacity", "share")


def leaf_budgets(leaves: DataFrame, tree: Tree, budget: Column | int, epochs: int) -> DataFrame:
    """LEVELS, tokens, share: leaves (LEVELS, tokens) with their budgets; one row per leaf, domains and languages above it."""
    d, l, s = LEVELS
    sized = leaves.withColumn("capacity", F.col("tokens") * epochs)
    sources = sized.withColumn("weight", tree.column(3)).select(d, l, s, "weight", "capacity")
    langs = sources.groupBy(d, l).agg(F.sum(F.when(F.col("weight") > 0, F.col("capacity")).otherwise(0)).alias("capacity")).withColumn("weight", tree.column(2))
    domains = langs.groupBy(d).agg(F.sum(F.when(F.col("weight") > 0, F.col("capacity")).otherwise(0)).alias("capacity")).withColumn("weight", tree.column(1))
    top = share(domains, None, [], d, budget if isinstance(budget, Column) else F.lit(budget).cast("long"))
    mid = share(langs, top, [d], l)
    return share(sources, mid, [d, l], s)


def mix(docs: DataFrame, tree: Tree, *, domain: Column, lang: str = "lang", source: str = "source", tokens: Column, key: Column, budget_ratio: float = 1.0, epochs: int = 2, seed: int = 7) -> DataFrame:
    """docs with __copies: how often each document is in the mixture (0 to epochs). The budget is budget_ratio of all tokens.

    tokens: a document's length in tokens. key: what identifies a document for the seeded order.
    """
    d, l, s = LEVELS
    name = lambda x: F.coalesce(x.cast("string"), F.lit(NO_NAME))
    names = [c for c in docs.columns if c not in COLUMNS]
    own = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]  # no name of docs can clash from here on
    added = {d: name(domain), l: name(F.col(lang)), s: name(F.col(source)), "__tokens": F.coalesce(tokens, F.lit(0)).cast("long"), "__key": F.coalesce(key.cast("string"), F.lit(NO_NAME))}
    held = materialize(docs.select(*own, *(v.alias(k) for k, v in added.items())), "mixture-documents")
    leaves = held.groupBy(*LEVELS).agg(F.sum("__tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
    leaves = materialize(leaves, "leaves", n_leaves := leaves.count())
    total = leaves.agg(F.sum("tokens").alias("t")).first().t or 0  # one number
    shares = leaf_budgets(leaves, tree, int(total * budget_ratio), epochs)
    plan = leaves.join(shares.select(*LEVELS, "share"), [*LEVELS])
    # ranges of the order: as many as a leaf has documents in each, so neither step of the sum is large
    bits = F.least(F.lit(40), F.ceil(F.log2("n") / 2)).cast("int")
    plan = materialize(plan.withColumns({"full": F.when(F.col("tokens") > 0, F.expr("share div tokens")).otherwise(F.when(F.col("share") > 0, epochs).otherwise(0)), "bits": bits}), "leaf-plan", n_leaves)
    forget(leaves)
    plan = plan.withColumn("rest", F.col("share") - F.col("full") * F.col("tokens"))
    order = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("full").cast("string"), "__key")), 1, ORDER_BITS // 4), 16, 10).cast("long")
    at = F.expr(f"shiftrightunsigned(__order, {ORDER_BITS} - bits)")
    #: Rows by leaf; those of a window over leaves are dealt anew, so that the few files don't make few tasks of the window.
    few = lambda df, what: materialize(df.repartition(-(-max(n_leaves, 1) // ROWS_PER_FILE)), what)

    def placed(rows: DataFrame) -> DataFrame:
        return rows.join(plan.select(*LEVELS, "full", "rest", "bits"), [*LEVELS]).withColumn("__order", order).withColumn("__range", at)

    sums = placed(held.select(*LEVELS, "__tokens", "__key")).groupBy(*LEVELS, "__range", "rest").agg(F.sum("__tokens").alias("t"))
    running = Window.partitionBy(*LEVELS).orderBy("__range")
    sums = sums.withColumn("upto", F.sum("t").over(running))
    ends = sums.where(F.col("upto") > F.col("rest")).groupBy(*LEVELS).agg(F.min(F.struct("__range", (F.col("upto") - F.col("t")).alias("before"))).alias("end"))
    ends = few(ends, "leaf-ends")
    rows = placed(held)
    rows = rows.join(ends, [*LEVELS], "left")
    edge = rows.where(F.col("__range") == F.col("end.__range")).select(*LEVELS, "__order", "__tokens", "rest", "end.before")
    inside = Window.partitionBy(*LEVELS).orderBy("__order").rangeBetween(Window.unboundedPreceding, 0)
    cut = edge.withColumn("upto", F.col("before") + F.sum("__tokens").over(inside)).where(F.col("upto") <= F.col("rest")).groupBy(*LEVELS).agg(F.max("__order").alias("last"))
    cut = few(cut, "leaf-cuts")
    rows = rows.join(cut, [*LEVELS], "left")
    in_part = (F.col("end").isNull()) | (F.col("__range") < F.col("end.__range")) | ((F.col("__range") == F.col("end.__range")) & (F.col("__order") <= F.col("last")))
    partial = F.when(F.col("full") < epochs, F.coalesce(in_part, F.lit(False)).cast("int")).otherwise(0)
    weighted = tree.column(1) * tree.column(2) * tree.column(3) > 0
    copies = F.when(weighted, F.least(F.lit(epochs), F.col("full") + F.when(F.col("rest") > 0, partial).otherwise(0))).otherwise(0)
    return rows.withColumn("__copies", copies.cast("int")).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)), *COLUMNS)


#: Production weights of this corpus: its sources stand in three domains, English counts double in the general one.
DOMAINS = {"general": range(0, 10), "reference": range(10, 15), "forum": range(15, 20)}
TREE = Tree({("general",): 5, ("reference",): 3, ("forum",): 2, ("general", "en"): 6, ("*", "en"): 4, ("*", "de"): 2, ("*", "fr"): 2, ("*", "es"): 2, ("general", "*", "src0"): 2})


def domain_of(source: Column) -> Column:
    """Domain of a source by the number that its name ends in; general where it has none or another."""
    number = F.try_element_at(F.regexp_extract_all(source, F.lit(r"(\d+)$"), 1), F.lit(1)).cast("int")
    out = F.lit("general")
    for name, numbers in DOMAINS.items():
        out = F.when(number.between(numbers.start, numbers.stop - 1), F.lit(name)).otherwise(out)
    return out


def word_tokens(text: Column) -> Column:
    """Words between white space: the length that budgets are counted in here."""
    from redactory.llm.quality import words_of

    return F.size(words_of(F.coalesce(text, F.lit(""))))


def mix_documents(docs: DataFrame, tokens: Column | None = None, **options) -> DataFrame:
    """mix() with the production tree for a table like documents. tokens: by default the words of the text."""
    return mix(docs, TREE, domain=domain_of(F.col("source")), tokens=word_tokens(F.col("text")) if tokens is None else tokens, key=F.col("doc_id"), **options)


def mixture_rows(docs: DataFrame, **options) -> DataFrame:
    """The mixture as rows: each document as often as it was selected, with the columns of docs."""
    mixed = mix_documents(docs, **options)
    names = [c for c in mixed.columns if c not in COLUMNS]
    rows = mixed.where("__copies > 0").select(*(F.col(f"`{c}`") for c in names), F.explode(F.sequence(F.lit(1), "__copies")).alias("__copies"))
    return rows.drop("__copies") if names == docs.columns else rows.select(*(F.col(f"`{c}`") if c in names else F.lit(None).cast(t).alias(c) for c, t in docs.dtypes))


def _share_sql(level: int, tree: Tree) -> str:
    """Tables of shares of a level's children (c{level}: names, capacity) in their parents' (p{level}: names, budget)."""
    names = ["d", "l", "s"][:level]
    by, own = ", ".join(names[:-1]), ", ".join(names)
    part = f"PARTITION BY {by}" if by else ""
    join = f"JOIN p{level} USING ({by})" if by else f"CROSS JOIN p{level}"
    weight = tree.sql(level, names)
    order = f"{part} ORDER BY whole, rest, {names[-1]}"
    return f"""
a{level} AS (SELECT {own}, CAST({weight} AS HUGEINT) AS w, CASE WHEN {weight} > 0 THEN CAST(capacity AS HUGEINT) ELSE 0 END AS c, CAST(budget AS HUGEINT) AS b FROM c{level} {join}),
o{level} AS (SELECT *, CASE WHEN w > 0 THEN c // w ELSE -1 END AS whole, CASE WHEN w > 0 THEN CAST(c % w AS DOUBLE) / CAST(w AS DOUBLE) ELSE 0 END AS rest FROM a{level}),
f{level} AS (SELECT *, coalesce(sum(c) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(w) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wide, row_number() OVER ({order}) AS r FROM o{level}),
g{level} AS (SELECT *, min(CASE WHEN c * wide > w * (b - below) THEN r END) OVER ({part}) AS ra FROM f{level}),
h{level} AS (SELECT *, max(CASE WHEN r = ra THEN below END) OVER ({part}) AS ra_below, max(CASE WHEN r = ra THEN wide END) OVER ({part}) AS ra_wide FROM g{level}),
i{level} AS (SELECT *, CASE WHEN ra IS NOT NULL AND r >= ra AND w > 0 THEN CAST(w * (b - ra_below) // ra_wide AS HUGEINT) ELSE c END AS sh FROM h{level}),
s{level} AS (SELECT {own}, CAST(sh + CASE WHEN ra IS NOT NULL AND r >= ra AND sh < c AND r - ra < least(b, sum(c) OVER ({part})) - sum(sh) OVER ({part}) THEN 1 ELSE 0 END AS HUGEINT) AS share FROM i{level})"""


def oracle_sql(tree: Tree = TREE, epochs: int = 2, seed: int = 7) -> str:
    """mix_documents() over documents, with a budget of all tokens, as SQL of DuckDB."""
    domain = "CASE" + "".join(f" WHEN try_cast(regexp_extract(source, '(\\d+)$', 1) AS INT) BETWEEN {n.start} AND {n.stop - 1} THEN '{k}'" for k, n in reversed(DOMAINS.items())) + " ELSE 'general' END"
    weighted = " * ".join(f"({tree.sql(k, ['d', 'l', 's'])})" for k in (1, 2, 3))
    return f"""
WITH docs AS (
  SELECT *, coalesce({domain}, 'general') AS d, coalesce(lang, chr(0)) AS l, coalesce(source, chr(0)) AS s, coalesce(CAST(doc_id AS VARCHAR), chr(0)) AS k,
    len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS n FROM documents
), leaves AS (SELECT d, l, s, sum(n) AS tokens FROM docs GROUP BY ALL),
c3 AS (SELECT d, l, s, tokens * {epochs} AS capacity FROM leaves),
c2 AS (SELECT d, l, sum(CASE WHEN {tree.sql(3, ["d", "l", "s"])} > 0 THEN capacity ELSE 0 END) AS capacity FROM c3 GROUP BY ALL),
c1 AS (SELECT d, sum(CASE WHEN {tree.sql(2, ["d", "l"])} > 0 THEN capacity ELSE 0 END) AS capacity FROM c2 GROUP BY ALL),
p1 AS (SELECT sum(tokens) AS budget FROM leaves),{_share_sql(1, tree)},
p2 AS (SELECT d, share AS budget FROM s1),{_share_sql(2, tree)},
p3 AS (SELECT d, l, share AS budget FROM s2),{_share_sql(3, tree)},
plan AS (SELECT d, l, s, CASE WHEN tokens > 0 THEN share // CAST(tokens AS HUGEINT) WHEN share > 0 THEN {epochs} ELSE 0 END AS whole, share, tokens FROM leaves JOIN s3 USING (d, l, s)),
placed AS (SELECT docs.*, whole, share - whole * tokens AS rest, CAST('0x' || substr(md5('{seed}:' || CAST(whole AS VARCHAR) || ':' || k), 1, {ORDER_BITS // 4}) AS BIGINT) AS o FROM docs JOIN plan USING (d, l, s)),
summed AS (SELECT *, sum(n) OVER (PARTITION BY d, l, s ORDER BY o RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM placed)
SELECT doc_id, d AS domain, lang, source, CAST(n AS BIGINT) AS n_tokens,
  CAST(CASE WHEN {weighted} > 0 THEN least({epochs}, whole + CASE WHEN whole < {epochs} AND rest > 0 AND upto <= rest THEN 1 ELSE 0 END) ELSE 0 END AS INT) AS copies
FROM summed"""
