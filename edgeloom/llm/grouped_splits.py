"""Splits that keep related records together, by grouped iterative stratification.

Records of a scope that share an entity are one component, whose label vector
counts its records by label. Components are placed with the rarest outstanding
label first, each into the split that needs that label most. Components with a
thousandth of their scope's records or more, of which a scope has at most a
thousand, are placed first, scope by scope; the demand they leave is shared
out to blocks of light components, which are placed in parallel.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.functions.text import alnum_key, given
from edgeloom.llm.match_groups import match_groups
from edgeloom.plans.durable import materialise
from edgeloom.plans.skew import join_hot

RATIOS = {"train": 0.7, "validation": 0.1, "test": 0.2}
#: A component with this share of its scope's records is heavy: at most 1 / HEAVY of them a scope.
HEAVY = 0.001
#: Light components of a block, about.
BLOCK = 20_000


def place(components: list[tuple[str, dict[str, float]]], demand: dict[str, list[float]]) -> dict[str, int]:
    """The split's index for each component (key, records by label), given the records each split still needs by label.

    Iterative stratification: of the labels with unplaced components the one
    with the fewest records is taken; its components, the largest first, go
    to the split with the greatest need of it, ties to the greatest need over
    all labels, then to the first split.
    """
    left: dict[str, float] = defaultdict(float)
    by_label: dict[str, list[int]] = defaultdict(list)
    for i, (_, vector) in enumerate(components):
        for label, n in vector.items():
            left[label] += n
            by_label[label].append(i)
    size = [sum(v.values()) for _, v in components]
    n_splits = len(next(iter(demand.values()))) if demand else 1
    total = [sum(d[s] for d in demand.values()) for s in range(n_splits)]
    out: dict[str, int] = {}
    while left:
        label = min(left, key=lambda x: (left[x], x))
        del left[label]
        need = demand.setdefault(label, [0.0] * n_splits)
        for i in sorted(by_label.pop(label), key=lambda i: (-size[i], components[i][0])):
            key, vector = components[i]
            if key in out:
                continue
            to = max(range(n_splits), key=lambda s: (need[s], total[s], -s))
            out[key] = to
            total[to] -= size[i]
            for other, n in vector.items():
                demand.setdefault(other, [0.0] * n_splits)[to] -= n
                if other in left:
                    left[other] -= n
    return out


def _placed(rows: pd.DataFrame, needs: pd.DataFrame) -> pd.DataFrame:
    demand = {r.label: [float(x) for x in r.need] for r in needs.itertuples()}
    components: dict[str, dict[str, float]] = defaultdict(dict)
    for r in rows.itertuples():
        components[r.component][r.label] = float(r.n)
    out = place(sorted(components.items()), demand)
    # Objects, not pandas' own strings, whose empty column Arrow refuses: a scope without a heavy component places none.
    scope = [rows["scope"].iloc[0]] * len(out) if out else []
    return pd.DataFrame({"scope": pd.Series(scope, dtype=object), "component": pd.Series(list(out), dtype=object), "to": pd.Series(list(out.values()), dtype="int32")})


def grouped_split(records: DataFrame, ratios: dict[str, float] = RATIOS) -> DataFrame:
    """``records`` (id, scope, component, label; none null) with ``split``, in the given shares of each scope and label.

    All records of one scope and component get one split. A component larger
    than a split's share still stays whole and goes where the need is
    greatest. An empty table gives no rows. One task holds all labels of a
    scope, so labels should be categories of which a scope has some thousands
    at most; records and components may be any number.
    """
    names, shares = list(ratios), [float(x) for x in ratios.values()]
    sizes = records.groupBy("scope", "component", "label").agg(F.count("*").alias("n"))
    vectors = materialise(sizes, "vectors")
    totals = vectors.groupBy("scope", "label").agg(F.sum("n").alias("rows"))
    scopes = totals.groupBy("scope").agg(F.sum("rows").alias("scope_rows"))
    whole = vectors.groupBy("scope", "component").agg(F.sum("n").alias("size"))
    heavy = whole.join(scopes, "scope").filter(F.col("size") >= HEAVY * F.col("scope_rows")).select("scope", "component")
    heavy = materialise(vectors.join(heavy, ["scope", "component"], "left_semi"), "heavy")
    needs = totals.select("scope", "label", F.array(*[F.col("rows") * F.lit(s) for s in shares]).alias("need"))
    form = "scope string, component string, to int"
    first = materialise(heavy.groupBy("scope").cogroup(needs.groupBy("scope")).applyInPandas(lambda a, b: _placed(a, b), form).filter("component IS NOT NULL"), "first")
    taken = heavy.join(first, ["scope", "component"]).groupBy("scope", "label").agg(F.array(*[F.sum(F.when(F.col("to") == i, F.col("n")).otherwise(0)) for i in range(len(names))]).alias("taken"), F.sum("n").alias("heavy_rows"))
    light = vectors.join(heavy.select("scope", "component").distinct(), ["scope", "component"], "left_anti")
    blocks = light.groupBy("scope").agg(F.ceil(F.count("*") / F.lit(float(BLOCK))).cast("int").alias("blocks"))
    light = light.join(blocks, "scope").withColumn("block", F.pmod(F.xxhash64("component"), F.col("blocks")).cast("int")).drop("blocks")
    zero = F.array(*[F.lit(0).cast("bigint") for _ in names])
    rest = needs.join(totals, ["scope", "label"]).join(taken, ["scope", "label"], "left").select(
        "scope", "label", F.zip_with("need", F.coalesce("taken", zero), lambda a, b: a - b).alias("need"), (F.col("rows") - F.coalesce("heavy_rows", F.lit(0))).alias("light_rows")
    )
    in_block = light.groupBy("scope", "block", "label").agg(F.sum("n").alias("block_rows"))
    shares_of = in_block.join(rest, ["scope", "label"]).select("scope", "block", "label", F.transform("need", lambda x: x * F.col("block_rows") / F.col("light_rows")).alias("need"))
    shared = materialise(shares_of, "demand")
    second = light.groupBy("scope", "block").cogroup(shared.groupBy("scope", "block")).applyInPandas(lambda a, b: _placed(a, b), form).filter("component IS NOT NULL")
    split = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("to") + 1)
    placed = materialise(first.unionByName(second).join(whole, ["scope", "component"]).select("scope", "component", "size", split.alias("split")), "placed")
    return join_hot(records, placed, ["scope", "component"], "size").drop("size")


def edge_records(edges: DataFrame) -> DataFrame:
    """(id, scope, component, label) of typed edges: the relation, node1 in any spelling, and the database.

    A null or blank node1 names nobody, so such an edge is a component of its
    own; a null relation or database counts as an empty one.
    """
    named = given("node1") & (alnum_key("node1") != "")
    return edges.select(
        F.col("edge_id").alias("id"), F.coalesce("relation", F.lit("")).alias("scope"),
        F.when(named, F.concat(F.lit("n:"), alnum_key("node1"))).otherwise(F.concat(F.lit("e:"), F.coalesce(F.col("edge_id").cast("string"), F.lit("")))).alias("component"),
        F.coalesce(alnum_key("database"), F.lit("")).alias("label"),
    )


def linked_components(records: DataFrame, record_id: str, keys: list[str]) -> DataFrame:
    """(id, component): one component for all records linked, directly or over others, by a value of any of the key columns.

    Null keys link nothing; a record without any key is its own component.
    Equal values of different columns don't link. The links are records
    against values, so a value that a third of the records share costs one
    link a record, never a pair of records.
    """
    name = F.concat(F.lit("r:"), F.col(record_id).cast("string"))
    values = [F.when(F.col(k).isNotNull(), F.concat(F.lit(f"k:{k}:"), F.col(k).cast("string"))) for k in keys]
    links = records.select(name.alias("a"), F.explode(F.array(name, *values)).alias("b")).filter("b IS NOT NULL")
    groups = match_groups(links, "a", "b")
    return groups.filter(F.col("node_id").startswith("r:")).select(F.substring("node_id", 3, 1 << 30).alias("id"), F.col("group_id").alias("component"))
