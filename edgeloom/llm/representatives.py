"""Best representative of each duplicate group, by currency reasoning.

From groups whose rows have timestamps, the precedence of states is learned:
a precedes b where, in more groups, the last a is older than the first b than
the other way round, and along chains of such steps. In each group the dated
rows and this order make a partial order: a row without a timestamp is placed
after the newest dated row of its own state or of one that precedes it. Then
one aggregation picks, field by field, the most trusted, topologically latest
real value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.functions.text import ensg, folded, real_value
from edgeloom.plans.durable import materialise

#: States that give an accession, the most trusted first.
TRUSTED = ("mapeado_revisado", "mapeado_revisado_desempate", "mapeado_no_revisado", "mapeado_no_revisado_desempate")
#: The other states of the domain. Any further state counts as one, OTHER.
UNTRUSTED = ("sin_mapeo", "excluido")
OTHER = "?"


def state_precedence(rows: DataFrame, group: str, state: str, at: str) -> DataFrame:
    """(earlier, later, n_groups): in how many groups all of one state are older than all of the other.

    States outside the domain count as OTHER, so a group has at most seven and
    the table at most 42 rows, however many rows a group has.
    """
    spans = rows.filter(F.col(at).isNotNull()).groupBy(group, _known(F.col(state)).alias("_s")).agg(F.min(at).alias("_first"), F.max(at).alias("_last"))
    per_group = spans.groupBy(group).agg(F.collect_list(F.struct("_s", "_first", "_last")).alias("_all")).filter(F.size("_all") > 1)
    pairs = per_group.select(F.explode("_all").alias("a"), "_all").select("a", F.explode("_all").alias("b")).filter("a._last < b._first")
    return pairs.groupBy(F.col("a._s").alias("earlier"), F.col("b._s").alias("later")).agg(F.count("*").alias("n_groups"))


def partial_order(precedence: list[tuple[str, str, int]]) -> dict[str, set[str]]:
    """The states that come before each state: the closure of the majority relation of (earlier, later, n_groups).

    A state precedes another if it does so in more groups than the other way
    round, or if a chain of such steps leads to it. States of a cycle precede
    each other and hence can't be told apart; each is left out of its own set.
    """
    votes = {(a, b): n for a, b, n in precedence}
    before: dict[str, set[str]] = {s: set() for pair in votes for s in pair}
    for (a, b), n in votes.items():
        if n > votes.get((b, a), 0):
            before[b].add(a)
    for mid in before:
        for s in before.values():
            if mid in s:
                s |= before[mid]
    return {s: earlier - {s} for s, earlier in before.items()}


def layers(before: dict[str, set[str]]) -> dict[str, int]:
    """The topological layer of each state, from 0: the longest chain before it, the states of a cycle being one step."""
    later = lambda a, b: a in before[b] and b not in before[a]
    out: dict[str, int] = {}
    for s in sorted(before, key=lambda x: sum(later(a, x) for a in before)):
        out[s] = 1 + max((out[a] for a in before[s] if later(a, s)), default=-1)
    # The states of a cycle have the same strict predecessors, so they share a layer already.
    return out


def learned_order(rows: DataFrame, group: str, state: str, at: str) -> dict[str, set[str]]:
    """``partial_order`` of the table's dated rows; at most seven states and 42 pairs reach the driver."""
    return partial_order([(r.earlier, r.later, r.n_groups) for r in state_precedence(rows, group, state, at).collect()])


def _known(state: Column) -> Column:
    return F.when(state.isin(*TRUSTED, *UNTRUSTED), state).otherwise(F.lit(OTHER))


def _by_state(values: dict[str, Column], state: Column, default: Column) -> Column:
    out = default
    for s, v in values.items():
        out = F.when(state == s, v).otherwise(out)
    return out


def gene_rows(rows: DataFrame) -> DataFrame:
    """(gene, map_id, state, accession, symbol, at, _s): the cleaned rows of genes with a number, written once for the passes over them."""
    base = rows.select(
        ensg("graph_node_id").alias("gene"), "map_id", folded("estado_mapeo").alias("state"), real_value("uniprot_accession").alias("accession"),
        real_value("simbolo_genico").alias("symbol"), F.col("updated_at").alias("at"),
    )
    return materialise(base, "genes").filter("gene IS NOT NULL").withColumn("_s", _known(F.col("state")))


def placed_rows(base: DataFrame, before: dict[str, set[str]]) -> DataFrame:
    """``base`` with ``layer`` and ``undated``, and every undated row placed in its gene's partial order.

    An undated row stands right after its gene's newest dated row of its own
    state or of one that precedes it; states that the order doesn't compare
    with its own say nothing of its place. Where no such row is, its ``at``
    stays null, which is before all dated rows.
    """
    layer = _by_state({s: F.lit(n) for s, n in layers(before).items()}, F.col("_s"), F.lit(0))
    base = base.withColumn("layer", layer).withColumn("undated", F.col("at").isNull().cast("int"))
    lost = base.filter("at IS NULL")
    states = [*TRUSTED, *UNTRUSTED, OTHER]
    # One maximum a state, so a gene of any number of rows costs one row a task.
    newest = base.filter("at IS NOT NULL").join(lost.select("gene").distinct(), "gene", "left_semi").groupBy("gene").agg(*[F.max(F.when(F.col("_s") == s, F.col("at"))).alias(f"_t{i}") for i, s in enumerate(states)])
    at = lambda s: F.greatest(F.lit(None).cast("timestamp_ntz"), *[F.col(f"_t{i}") for i, t in enumerate(states) if t == s or t in before.get(s, ())])
    found = lost.join(newest, "gene", "left").withColumn("at", _by_state({s: at(s) for s in states}, F.col("_s"), F.lit(None).cast("timestamp_ntz")))
    return base.filter("at IS NOT NULL").unionByName(found.select(*base.columns))


#: The order of a gene's rows in time: place, learned layer, undated after dated, map_id. Null fields come first in a maximum of structs.
_WHEN = ("at", "layer", "undated", "map_id")


def best_genes(rows: DataFrame) -> DataFrame:
    """(graph_node_id, uniprot_accession, estado_mapeo, simbolo_genico) of each gene with two or more rows.

    Genes are equal by ENSG number; rows without one are left out. Accession
    and state come from the row with a real accession and the most trusted
    state, the newest among equals; without one the accession is '' and the
    state is the newest row's (null if that is null). The symbol is the newest
    real one or ''. Ties of time go to the learned later state, then to the
    undated row, then to the larger map_id. Rows without updated_at are placed
    by the learned order and are the oldest where it says nothing.
    """
    base = gene_rows(rows)
    every = placed_rows(base, learned_order(base, "gene", "state", "at"))
    trust = F.lit(0)
    for i, s in enumerate(reversed(TRUSTED), 1):
        trust = F.when(F.col("state") == s, F.lit(i)).otherwise(trust)
    every = every.withColumn("trust", trust)
    picked = every.groupBy("gene").agg(
        F.count("*").alias("n"),
        F.max(F.when((F.col("trust") > 0) & F.col("accession").isNotNull(), F.struct("trust", *_WHEN, "accession", "state"))).alias("best"),
        F.max(F.struct(*_WHEN, "state")).alias("newest"),
        F.max(F.when(F.col("symbol").isNotNull(), F.struct(*_WHEN, "symbol"))).alias("named"),
    )
    return picked.filter("n > 1").select(
        F.col("gene").alias("graph_node_id"),
        F.coalesce("best.accession", F.lit("")).alias("uniprot_accession"),
        F.when(F.col("best").isNotNull(), F.col("best.state")).otherwise(F.col("newest.state")).alias("estado_mapeo"),
        F.coalesce("named.symbol", F.lit("")).alias("simbolo_genico"),
    )


def latest_by_order(rows: DataFrame) -> DataFrame:
    """(graph_node_id, by_order, by_time, agree): of each gene with two or more rows, the states that the learned order calls latest, and the newest row's state.

    ``by_order`` looks at no timestamp of the gene: it lists, sorted, the
    gene's states that come before none of its others. Null and further
    states count as ``?``. ``by_time`` is null if no row has a time. ``agree``
    says whether the newest row's state is among the latest.
    """
    base = gene_rows(rows)
    before = learned_order(base, "gene", "state", "at")
    held = base.groupBy("gene").agg(F.count("*").alias("n"), F.collect_set("_s").alias("held"), F.max(F.when(F.col("at").isNotNull(), F.struct("at", "map_id", "_s"))).alias("newest"))
    none = F.array().cast("array<string>")
    later = {s: F.array(*[F.lit(t) for t in sorted(before) if s in before[t] and t not in before[s]]).cast("array<string>") for s in before}
    last = F.filter("held", lambda x: ~F.arrays_overlap("held", _by_state(later, x, none)))
    out = held.filter("n > 1").select(F.col("gene").alias("graph_node_id"), F.array_sort(last).alias("latest"), F.col("newest._s").alias("by_time"))
    return out.select("graph_node_id", F.array_join("latest", ",").alias("by_order"), "by_time", F.coalesce(F.array_contains("latest", F.col("by_time")), F.lit(False)).alias("agree"))
