"""Filling containers of fixed capacity: hierarchical residual packing.

Documents longer than a container give as many full containers as fit and one rest; all else is
packed whole. Items are spread by hash over groups of about GROUP items; each group is packed
best-fit decreasing in one task. Containers filled to NEARLY are emitted; the others are items of
the next round, on a FACTOR-th of the groups, until a round has one group or no longer saves
containers. No group exceeds a bound whatever the data: the number of groups follows the number
of items, so nothing is collected into one task.

Best fit is found by a bit set of the free spaces, one step per item.

Defined results: null texts and texts of no tokens are in no container; equal documents are items
of their own; capacities of zero or less hold nothing; an empty table gives no container."""

from __future__ import annotations

import math
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelark.llm.tokens import token_counts
from sievelark.session import cut, table

#: Items packed in one task, about; share of a container that counts as nearly full; by how much the groups shrink a round; most rounds.
GROUP, NEARLY, FACTOR, ROUNDS = 40_000, 0.995, 8, 6

_BIN = "container_kind string, capacity int, used bigint, docs array<bigint>, pieces array<int>, tokens array<bigint>"


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """The container number of each item, items being put in descending order (given so) into the fullest container they fit."""
    free: dict[int, list[int]] = defaultdict(list)
    mask, n, out = 0, 0, []
    for s in sizes:
        above = mask >> s
        if above:
            room = s + (above & -above).bit_length() - 1
            c = free[room].pop()
            if not free[room]:
                mask &= ~(1 << room)
        else:
            room, c = capacity, n
            n += 1
        out.append(c)
        left = room - s
        free[left].append(c)
        mask |= 1 << left
    return out


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    """One group's items or containers into containers."""
    pdf = pdf.assign(first=[d[0] for d in pdf["docs"]], piece=[p[0] for p in pdf["pieces"]]).sort_values(["used", "first", "piece"], ascending=[False, True, True])
    kind, capacity = pdf["container_kind"].iloc[0], int(pdf["capacity"].iloc[0])
    where = best_fit(pdf["used"].tolist(), capacity)
    docs, pieces, tokens = defaultdict(list), defaultdict(list), defaultdict(list)
    for c, d, p, t in zip(where, pdf["docs"], pdf["pieces"], pdf["tokens"], strict=True):
        docs[c].extend(d)
        pieces[c].extend(p)
        tokens[c].extend(t)
    rows = [(kind, capacity, int(sum(tokens[c])), docs[c], pieces[c], tokens[c]) for c in docs]
    return pd.DataFrame(rows, columns=["container_kind", "capacity", "used", "docs", "pieces", "tokens"])


def items_of(counts: DataFrame, kinds: list[tuple[str, int]]) -> DataFrame:
    """The pieces of every document for every kind, as containers of one piece."""
    each = F.array(*[F.struct(F.lit(k).alias("container_kind"), F.lit(c).alias("capacity_tokens")) for k, c in kinds])
    x = counts.where("n_tokens > 0").select("doc_id", "n_tokens", F.explode(each).alias("k")).select("doc_id", "n_tokens", "k.*")
    cap = F.col("capacity_tokens").cast("bigint")
    x = x.withColumn("whole", F.floor((F.col("n_tokens") - 1) / cap))
    x = x.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("whole").cast("int"))))
    used = F.when(F.col("piece") < F.col("whole"), cap).otherwise(F.col("n_tokens") - F.col("whole") * cap)
    return x.select("container_kind", F.col("capacity_tokens").alias("capacity"), used.alias("used"), F.array("doc_id").alias("docs"), F.array("piece").alias("pieces"), F.array(used).alias("tokens"))


def packed(counts: DataFrame, containers: DataFrame, group: int = GROUP, nearly: float = NEARLY) -> DataFrame:
    """Containers (container_kind, capacity, used, docs, pieces, tokens) holding every document once for each kind.

    containers is a configuration table of a few rows; its rows become constants of the plan."""
    kinds = [(r.container_kind, r.capacity_tokens) for r in containers.select("container_kind", "capacity_tokens").distinct().collect() if (r.capacity_tokens or 0) > 0]
    if not kinds:
        return counts.sparkSession.createDataFrame([], _BIN)
    rest = cut(items_of(counts, kinds))
    done = rest.where(F.col("used") >= nearly * F.col("capacity"))
    rest = rest.where(F.col("used") < nearly * F.col("capacity"))
    before, shrink = None, 1
    for _ in range(ROUNDS):
        n = {r.container_kind: r["n"] for r in rest.groupBy("container_kind").agg(F.count("*").alias("n")).collect()}
        if not n or n == before:
            break
        groups = {k: max(1, math.ceil(v / group / shrink)) if shrink > 1 and v <= group * FACTOR else max(1, math.ceil(v / group)) for k, v in n.items()}
        sizes = F.create_map(*[x for k, g in groups.items() for x in (F.lit(k), F.lit(g))])
        part = F.pmod(F.xxhash64(F.col("docs")[0], F.col("pieces")[0], F.lit(shrink)), F.element_at(sizes, F.col("container_kind")))
        bins = cut(rest.withColumn("part", part).groupBy("container_kind", "part").applyInPandas(_pack, _BIN))
        done = done.unionByName(bins.where(F.col("used") >= nearly * F.col("capacity")))
        rest = bins.where(F.col("used") < nearly * F.col("capacity"))
        if max(groups.values()) == 1:
            break
        before, shrink = n, shrink * FACTOR
    return done.unionByName(rest)


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a piece of a document and kind of container: the container (named by its first piece), the piece and its tokens."""
    bins = packed(token_counts(table(spark, sf_dir, "documents")), table(spark, sf_dir, "containers"))
    each = bins.select("container_kind", F.concat_ws("-", F.col("docs")[0].cast("string"), F.col("pieces")[0].cast("string")).alias("container_id"), "used", F.explode(F.arrays_zip("docs", "pieces", "tokens")).alias("x"))
    return each.select("container_kind", "container_id", F.col("x.docs").alias("doc_id"), F.col("x.pieces").alias("piece_no"), F.col("x.tokens").alias("n_tokens"), F.col("used").alias("container_tokens"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each kind: containers, pieces, split documents, tokens, the share of space used and the least number of containers possible by volume."""
    bins = packed(token_counts(table(spark, sf_dir, "documents")), table(spark, sf_dir, "containers"))
    split = F.size(F.filter("pieces", lambda p: p == 1))
    g = bins.groupBy("container_kind", "capacity").agg(F.count("*").alias("n_containers"), F.sum(F.size("docs")).alias("n_pieces"), F.sum(split).alias("n_split_docs"), F.sum("used").alias("n_tokens"))
    return g.withColumn("fill", F.col("n_tokens") / (F.col("n_containers") * F.col("capacity"))).withColumn("least_containers", F.ceil(F.col("n_tokens") / F.col("capacity")))
