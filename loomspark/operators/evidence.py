"""Evidence for a question: where calls lead, stubs, and packing into a token budget.

Defined cases: null names and ids match nothing; a call that no tier resolves
gives no row; a question without hits gives no pack; equal ranks cannot occur.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.terms import identifier_parts

# Definitions of a compound or imported name, share of the budget for bodies, lines and signs of a stub
COMPOUND, IMPORTED = 2, 8
BODY_SHARE = 0.6
STUB_LINES, STUB_SIGNS = 3, 300
IMPORT = r"(?m)^[ \t]*(?:import|from|use|#include|export)\b([^\n;]*)"
TEST_PATH = r"(?i)(?:^|/)tests?/|(?:^|/)test_[^/]*$|_test\.(?:py|go)$|\.(?:test|spec)\.[jt]s$"


def imports(chunks: DataFrame) -> DataFrame:
    """``(filepath, word)``: the names in the import lines of every file."""
    lines = F.regexp_extract_all("content", F.lit(IMPORT), 1)
    words = F.regexp_extract_all(F.array_join(lines, " "), F.lit(r"([A-Za-z_]\w*)"), 1)
    return chunks.where("filepath IS NOT NULL AND content IS NOT NULL").select("filepath", F.explode(words).alias("word")).distinct()


def resolved(calls: DataFrame, definitions: DataFrame, imported: DataFrame) -> DataFrame:
    """``(caller_id, callee, definition_id, tier)`` for calls ``(caller_id, filepath, callee)``.

    Tier 1 is a definition in the same file, 2 one that the file imports by its
    name or by the name of its file, 3 the only definition there is, 4 the first
    two of a compound name.  The first tier that has any holds.  Every tier is a
    join by equality, and what a name gives is bounded before it.
    """
    defs = definitions.where("id IS NOT NULL AND name IS NOT NULL").groupBy("id").agg(F.max("name").alias("callee"), F.max("filepath").alias("def_path")).withColumnRenamed("id", "definition_id")
    calls = calls.select("caller_id", "filepath", "callee").distinct()
    order = Window.partitionBy("callee").orderBy("definition_id")
    first = defs.withColumn("k", F.row_number().over(order)).where(F.col("k") <= IMPORTED)
    pick = lambda df, tier: df.select("caller_id", "callee", "definition_id", F.lit(tier).alias("tier"))
    same = pick(calls.join(defs.withColumnRenamed("def_path", "filepath"), ["filepath", "callee"]), 1)
    stem = F.regexp_extract("def_path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    by_file = calls.join(imported, "filepath").join(defs.withColumn("word", stem), ["callee", "word"])
    by_name = calls.join(imported.withColumnRenamed("word", "callee"), ["filepath", "callee"]).join(first, "callee")
    linked = pick(by_file, 2).unionByName(pick(by_name, 2)).distinct()
    only = defs.groupBy("callee").agg(F.count("*").alias("n"), F.min("definition_id").alias("definition_id")).where("n = 1")
    unique = pick(calls.join(only, "callee"), 3)
    compound = pick(calls.join(first.where((F.col("k") <= COMPOUND) & (F.size(identifier_parts(F.col("callee"))) >= 2)), "callee"), 4)
    every = same.unionByName(linked).unionByName(unique).unionByName(compound)
    best = F.min("tier").over(Window.partitionBy("caller_id", "callee"))
    return every.withColumn("best", best).where("tier = best").drop("best")


def stub(body: Column) -> Column:
    """The first lines of a body, up to one that opens a block."""
    lines = F.filter(F.split(body, "\n"), lambda x: F.trim(x) != "")
    opens = F.array_position(F.transform(lines, lambda x: x.rlike(r"[:{]\s*$")), True)
    n = F.when(opens > 0, F.least(opens, F.lit(STUB_LINES))).otherwise(STUB_LINES).cast("int")
    return F.substring(F.array_join(F.slice(lines, 1, n), "\n"), 1, STUB_SIGNS)


def _packed(budget: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        used, forms, costs = 0, [], []
        for k, (body, short) in enumerate(zip(pdf["body_tokens"], pdf["stub_tokens"])):
            if used + body <= budget * BODY_SHARE:
                form, cost = "body", body
            elif used + short <= budget or not k:
                form, cost = "stub", short
            else:
                form, cost = "omitted", 0
            used += cost
            forms.append(form)
            costs.append(cost)
        return pd.DataFrame({"query_id": pdf["query_id"], "id": pdf["id"], "rank": pdf["rank"], "form": forms, "cost": costs})

    return run


def packed(hits: DataFrame, budget: int) -> DataFrame:
    """``(query_id, id, rank, form, cost)`` of hits ``(query_id, id, rank, body_tokens, stub_tokens)``.

    In the order of the ranks a hit is given whole while bodies take no more
    than their share of the budget, as a stub while the budget lasts, and left
    out after that; the first one is always given.  A group is the bounded list
    of one question.
    """
    return hits.groupBy("query_id").applyInPandas(_packed(budget), "query_id long, id long, rank int, form string, cost int")


# What a step from a seed leaves of its score, and the order of the roles
PARENT_FACTOR, CALL_FACTOR, MODULE_FACTOR = 0.5, 0.6, 0.3
ROLES = {"seed": 0, "parent": 1, "callee": 2, "caller": 3}
CALLS_PER_SEED = 10


def located(definitions: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(definition_id, id)``: the first chunk of the definition's file that has its name and line."""
    defs = definitions.where("id IS NOT NULL").select(F.col("id").alias("definition_id"), "filepath", F.col("name").alias("symbol_name"), "line").distinct()
    spans = chunks.where("id IS NOT NULL").select("id", "filepath", "symbol_name", "start_line", "end_line").distinct()
    both = defs.join(spans, ["filepath", "symbol_name"]).where("line BETWEEN start_line AND end_line")
    return both.groupBy("definition_id").agg(F.min("id").alias("id"))


def expanded(seeds: DataFrame, chunks: DataFrame, calls: DataFrame) -> DataFrame:
    """``(query_id, id, role, score)``: seeds and what stands next to them, each chunk once.

    ``seeds`` holds ``(query_id, id, score)``, ``calls`` ``(caller_id, callee_id,
    place)`` with the place of the call among those of its caller.  Seeds of
    whole modules keep a part of their score; parents that are class headers,
    callees and callers have a part of the seed's.  A chunk found twice has its
    greatest score and its first role.
    """
    kinds = chunks.where("id IS NOT NULL").groupBy("id").agg(F.max("chunk_type").alias("kind"), F.max("parent_id").alias("parent_id"))
    seeds = seeds.join(kinds, "id").withColumn("score", F.when(F.col("kind") == "module", F.col("score") * MODULE_FACTOR).otherwise(F.col("score")))
    item = lambda df, role, factor: df.select("query_id", "id", F.lit(role).alias("role"), (F.col("score") * factor).alias("score"))
    headers = kinds.where("kind = 'class_header'").select("id")
    parents = seeds.select("query_id", F.col("parent_id").alias("id"), "score").join(headers, "id", "left_semi")
    near = calls.where(F.col("place") <= CALLS_PER_SEED)
    callees = seeds.join(near, seeds["id"] == near["caller_id"]).select("query_id", F.col("callee_id").alias("id"), "score")
    callers = F.row_number().over(Window.partitionBy("callee_id").orderBy("caller_id"))
    back = calls.select("caller_id", "callee_id").distinct().withColumn("k", callers).where(F.col("k") <= CALLS_PER_SEED)
    called = seeds.join(back, seeds["id"] == back["callee_id"]).select("query_id", F.col("caller_id").alias("id"), "score")
    every = item(seeds, "seed", 1.0).unionByName(item(parents, "parent", PARENT_FACTOR)).unionByName(item(callees, "callee", CALL_FACTOR)).unionByName(item(called, "caller", CALL_FACTOR))
    order = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])[F.col("role")]
    return every.groupBy("query_id", "id").agg(F.min_by("role", order).alias("role"), F.max("score").alias("score"))
