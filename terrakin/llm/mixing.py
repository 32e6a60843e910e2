"""Mixing sources to target weights by hierarchical budgeting, in DataFrame functions alone.

Documents form a tree domain -> language -> source. A token budget goes down the tree: the
children of a node share its budget by their weights, none gets more than its leaves can
give (their tokens times ``max_epochs``), and what a child cannot give goes to its siblings
by their weights before anything is missing at the parent. Since a node never asks for more
than its leaves hold, shortages are made up among siblings first and among ancestors'
siblings only then. Budgets are whole tokens: siblings are filled in the order of capacity
per weight, all products are exact decimals, and rounding is by running totals, so the
children's budgets add up to the parent's.

A floor of whole epochs can be asked for. It counts towards the targets: what is shared out
beside it goes to children by how far the floor leaves them below their share of floor and
budget together, and to others only when those are full.

Each leaf's budget is a prefix of its stream of seeded epochs: in every epoch its documents
come in the order of md5(seed | epoch | id), then id, tokens and a hash of the text. All
earlier epochs are taken whole, the last one up to the token where the budget ends. The place
of that end is found without ordering a leaf in one task: token sums of 256 ranges of the
order (two hex digits), then of the 256 parts of the range where the budget ends, and so on
for six digits; then, over the few documents of that part, sums by the whole key, by the
number of tokens and by the hash. Rows are put in order one by one only where all of these
are equal, so rows that share an id, or have none, are no task's alone.

A token is a word ``[^\\x20\\x09-\\x0D]+``. Defined results: null domains, languages and
sources are the empty name; null and empty texts hold no tokens and take part in whole
epochs, and in the last one where their place is before the end; very long texts are counted
whole and cut at a token; repeated rows are ordered next to each other, and which of them the
end falls on is not defined, since they are equal; null ids are ordered like the empty text;
weights of 0 or less give nothing; extra columns are kept by ``mixed`` and ignored elsewhere;
an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from terrakin.llm.common import materialize

TREE = ["domain", "lang", "source"]
WORD = r"[^\x20\x09-\x0D]+"
EXACT = "decimal(38,0)"
#: Plans of up to so many leaves (some MB) are broadcast; larger ones meet salted rows.
FEW_LEAVES, SALTS = 20_000, 64


@dataclass(frozen=True)
class Targets:
    """Weights by name on each level of the tree (whole numbers, 1 where unnamed), the budget
    as thousandths of the corpus's tokens, and how often a token may be used at most.
    ``floor_epochs`` epochs of every leaf are taken beside the budget."""

    domain: dict[str, int] = field(default_factory=dict)
    lang: dict[str, int] = field(default_factory=dict)
    source: dict[str, int] = field(default_factory=dict)
    budget_permille: int = 1_000
    max_epochs: int = 4
    floor_epochs: int = 0
    seed: int = 42


def _weight(level: str, names: dict[str, int]) -> Column:
    w = F.lit(1)
    for name, value in sorted(names.items()):
        w = F.when(F.col(level) == name, value).otherwise(w)
    return w.cast(EXACT)


def _fill(nodes: DataFrame, parents: list[str], level: str, names: dict[str, int]) -> DataFrame:
    """Share each parent's ``budget`` among its children: the column becomes the child's.
    With ``floor`` (a child's tokens that are taken anyway) it counts towards the weights."""
    zero = F.lit(0).cast(EXACT)
    w = nodes.withColumn("w", _weight(level, names))
    if "floor" in nodes.columns:
        whole = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(1))
        w = w.withColumn("all_floor", F.sum("floor").over(whole).cast(EXACT)).withColumn("all_w", F.sum(F.greatest("w", zero)).over(whole).cast(EXACT))
        lack = F.greatest(zero, F.expr(f"cast((all_floor + budget) * w div all_w as {EXACT})") - F.col("floor"))
        w = w.withColumn("w", F.when(F.col("w") > 0, (lack * 1000).cast(EXACT) + F.col("w")).otherwise(zero).cast(EXACT)).drop("all_floor", "all_w")
    w = w.withColumn("cap", F.when(F.col("w") > 0, F.col("cap")).otherwise(zero)).withColumn("w", F.greatest("w", F.lit(1).cast(EXACT)))
    family = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(1))
    ranked = family.orderBy(F.col("cap").cast("double") / F.col("w").cast("double"), level)
    upto = lambda c: F.sum(c).over(ranked.rowsBetween(Window.unboundedPreceding, 0)).cast(EXACT)
    w = w.withColumn("all_w", F.sum("w").over(family).cast(EXACT))
    w = w.withColumn("cap_before", upto("cap") - F.col("cap")).withColumn("w_before", upto("w") - F.col("w"))
    w = w.withColumn("full", F.expr("cap * (all_w - w_before) <= (budget - cap_before) * w"))
    w = w.withColumn("left", F.col("budget") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(zero)).over(family).cast(EXACT))
    w = w.withColumn("open_w", F.when(F.col("full"), zero).otherwise(F.col("w")))
    w = w.withColumn("open_all", F.sum("open_w").over(family).cast(EXACT))
    w = w.withColumn("open_upto", F.sum("open_w").over(family.orderBy(level).rowsBetween(Window.unboundedPreceding, 0)).cast(EXACT))
    share = F.expr("cast((left * open_upto) div open_all as decimal(38,0)) - cast((left * (open_upto - open_w)) div open_all as decimal(38,0))")
    return w.withColumn("budget", F.when(F.col("full"), F.col("cap")).otherwise(share)).drop("w", "all_w", "cap_before", "w_before", "full", "left", "open_w", "open_all", "open_upto")


def allocate(leaves: DataFrame, targets: Targets) -> DataFrame:
    """(domain, lang, source, tokens, budget) of (domain, lang, source, tokens): how many
    tokens to take from each leaf beside the floor."""
    spare = max(0, targets.max_epochs - targets.floor_epochs)
    leaves = leaves.select(*TREE, F.col("tokens").cast(EXACT).alias("tokens"), (F.col("tokens").cast(EXACT) * spare).cast(EXACT).alias("cap"))
    langs = leaves.groupBy("domain", "lang").agg(F.sum("cap").cast(EXACT).alias("cap"), F.sum("tokens").cast(EXACT).alias("tokens"))
    if targets.floor_epochs:
        floor = (F.col("tokens") * targets.floor_epochs).cast(EXACT)
        leaves, langs = leaves.withColumn("floor", floor), langs.withColumn("floor", floor)
    domains = langs.groupBy("domain").agg(F.sum("cap").cast(EXACT).alias("cap"), F.sum("tokens").cast(EXACT).alias("tokens"))
    if targets.floor_epochs:
        domains = domains.withColumn("floor", floor)
    every = Window.partitionBy(F.lit(1))
    root = F.least((F.sum("tokens").over(every) * targets.budget_permille).cast(EXACT), F.sum("cap").over(every).cast(EXACT) * 1000)
    domains = domains.withColumn("root", root.cast(EXACT)).withColumn("budget", F.expr(f"cast(root div 1000 as {EXACT})")).drop("root")
    got = _fill(domains, [], "domain", targets.domain).select("domain", "budget")
    got = _fill(langs.join(got, "domain"), ["domain"], "lang", targets.lang).select("domain", "lang", "budget")
    return _fill(leaves.join(got, ["domain", "lang"]), ["domain", "lang"], "source", targets.source).select(*TREE, F.col("tokens").cast("long"), F.col("budget").cast("long"))


def leaf_columns(docs: DataFrame, domain: Column, id_col: str, text_col: str) -> list[Column]:
    """What the plan needs of a document, under names of its own."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [
        F.coalesce(domain, F.lit("")).alias("domain"),
        F.coalesce("lang", F.lit("")).alias("lang"),
        F.coalesce("source", F.lit("")).alias("source"),
        F.col(id_col).alias("id"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_tokens"),
        F.xxhash64(text).alias("tie"),
    ]


def _ordered(rows: DataFrame, plan: DataFrame, targets: Targets) -> DataFrame:
    """Rows with their leaf's plan and the hex key of the last epoch's order."""
    key = F.md5(F.concat_ws("|", F.lit(str(targets.seed)), F.col("epochs").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    if plan.count() <= FEW_LEAVES:
        met = rows.join(F.broadcast(plan), TREE)
    else:  # a hot leaf's rows go to SALTS tasks
        salted = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = rows.withColumn("salt", F.pmod(F.xxhash64("id", "tie"), F.lit(SALTS)).cast("int")).join(salted, [*TREE, "salt"]).drop("salt")
    return met.withColumn("key", key).withColumns({f"k{d}": F.substring("key", 2 * d - 1, 2) for d in DIGITS})


DIGITS = (1, 2, 3)
#: The order's parts, coarse to fine: ranges of the key, then what sorts rows within the last.
RANGES, WITHIN = [f"k{d}" for d in DIGITS], ["key", "n_tokens", "tie"]


def _at_end(parts: list[str]) -> Column:
    """Whether a row is in the parts of the order where its leaf's budget ends."""
    same = F.lit(True)
    for p in parts:
        same = same & (F.col(p) == F.col(f"end_{p}"))
    return same


def _narrowed(ends: DataFrame, rows: DataFrame, part: str) -> DataFrame:
    """``ends`` with ``end_part``, in which part of the order each leaf's budget ends, and
    ``base``, the tokens before it. ``rows`` are those where the coarser parts end."""
    sums = rows.groupBy(*TREE, part, "rest").agg(F.sum("n_tokens").alias("held"), F.first("base").alias("base"))
    upto = F.col("base") + F.sum("held").over(Window.partitionBy(*TREE).orderBy(part).rowsBetween(Window.unboundedPreceding, 0))
    over = sums.withColumn("upto", upto).filter(F.col("upto") > F.col("rest"))
    least = over.groupBy(*TREE).agg(F.min(F.struct(part, (F.col("upto") - F.col("held")).alias("before"))).alias("m"))
    found = least.select(*TREE, F.col(f"m.{part}").alias(f"end_{part}"), F.col("m.before").alias("now"))
    return ends.join(found, TREE, "left").withColumn("base", F.coalesce("now", "base")).drop("now")


def plan(rows: DataFrame, targets: Targets) -> DataFrame:
    """One row per leaf: whole ``epochs``, the tokens of the ``rest`` and where in the last
    epoch's order they end. ``rows`` has the leaf columns."""
    leaves = rows.groupBy(*TREE).agg(F.sum("n_tokens").alias("tokens"))
    budgets = materialize(allocate(leaves, targets), "mix_leaves")
    whole = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0)
    ends = budgets.select(*TREE, "tokens", "budget", (whole + targets.floor_epochs).cast("long").alias("epochs"), (F.col("budget") - whole * F.col("tokens")).cast("long").alias("rest"), F.lit(0).cast("long").alias("base"))
    for k, part in enumerate(RANGES):
        ends = materialize(_narrowed(ends, _ordered(rows, ends, targets).filter(_at_end(RANGES[:k])), part), "mix_ends")
    # What is left is a leaf's edge: a few rows, unless ids repeat.
    edge = materialize(_ordered(rows, ends, targets).filter(_at_end(RANGES)).select(*TREE, "id", *WITHIN), "mix_edge")
    for k, part in enumerate(WITHIN):
        met = edge.join(F.broadcast(ends) if ends.count() <= FEW_LEAVES else ends, TREE).filter(_at_end(WITHIN[:k]))
        ends = materialize(_narrowed(ends, met, part), "mix_ends")
    return ends


def _taken(rows: DataFrame, planned: DataFrame, targets: Targets) -> DataFrame:
    """Rows with ``epochs`` and ``prefix_tokens`` (of the last epoch)."""
    marked = _ordered(rows, planned, targets)
    parts = [*RANGES, *WITHIN]
    last = F.coalesce((F.col("rest") > 0) & _at_end(parts), F.lit(False))
    before, same = F.lit(False), F.lit(True)
    for p in parts:
        before = before | same & (F.col(p) < F.col(f"end_{p}"))
        same = same & (F.col(p) == F.col(f"end_{p}"))
    before = F.coalesce((F.col("rest") > 0) & before, F.lit(False))
    easy = marked.filter(~last).withColumn("prefix", before).withColumn("prefix_tokens", F.when(F.col("prefix"), F.col("n_tokens")).otherwise(F.lit(0).cast("long")))
    running = Window.partitionBy(*TREE).orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    edge = marked.filter(last).withColumn("start", F.col("base") + F.sum("n_tokens").over(running) - F.col("n_tokens"))
    edge = edge.withColumn("prefix", F.col("start") < F.col("rest")).withColumn("prefix_tokens", F.greatest(F.lit(0).cast("long"), F.least("n_tokens", F.col("rest") - F.col("start")))).drop("start")
    return easy.unionByName(edge)


def selection(docs: DataFrame, targets: Targets, domain: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, domain, lang, source, n_tokens, epochs, prefix_tokens, taken_tokens): one row per
    input row."""
    rows = materialize(docs.select(*leaf_columns(docs, domain, id_col, text_col)), "mix_rows")
    taken = _taken(rows, plan(rows, targets), targets)
    return taken.select("id", *TREE, "n_tokens", "epochs", "prefix_tokens", (F.col("epochs") * F.col("n_tokens") + F.col("prefix_tokens")).alias("taken_tokens"))


def first_tokens(text: Column, n: Column) -> Column:
    """A text up to the end of its n-th token."""
    tokens = F.slice(F.regexp_extract_all(text, F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0)), F.lit(1), n)
    return F.regexp_replace(F.concat(F.regexp_extract(text, r"^[\x20\x09-\x0D]*", 0), F.array_join(tokens, "")), r"[\x20\x09-\x0D]+$", "")


def mixed(docs: DataFrame, targets: Targets, domain: Column, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """The rows of ``docs``, each as often as its epochs take it; the document in which a leaf's
    last epoch ends is cut at the token where the budget ends, and ``length_col``, if named, is
    then the length of what is left."""
    planned = plan(materialize(docs.select(*leaf_columns(docs, domain, id_col, text_col)), "mix_rows"), targets)
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), *leaf_columns(docs, domain, id_col, text_col))
    taken = _taken(rows, planned, targets)
    copies = (F.col("epochs") + F.col("prefix").cast("long")).cast("int")
    each = taken.filter(copies > 0).select("row", "epochs", "n_tokens", F.col("prefix_tokens").cast("int").alias("upto"), F.explode(F.sequence(F.lit(1), copies)).alias("copy"))
    cut = (F.col("copy") > F.col("epochs")) & (F.col("upto") < F.col("n_tokens"))
    text = F.col("row")[text_col]
    out = each.select("row", F.when(cut, first_tokens(text, F.col("upto"))).otherwise(text).alias("text"), cut.alias("cut"))
    swap = {text_col: F.col("text")}
    if length_col:
        swap[length_col] = F.when(F.col("cut"), F.length("text").cast(docs.schema[length_col].dataType)).otherwise(F.col("row")[length_col])
    return out.select(*[swap.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
