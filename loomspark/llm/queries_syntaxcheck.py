"""Queries that flag source files which do not parse."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.llm import lexing as L
from loomspark.llm import syntaxcheck as S
from loomspark.sources.tables import table


def _invalid(spark, sf):
    return S.invalid_files(table(spark, sf, "files"), table(spark, sf, "raw_sources"))


def p4_found(spark, sf):
    """Files whose current text is not valid in its language."""
    return _invalid(spark, sf).select("filepath")


def p4_rates(spark, sf):
    """Share of invalid files per repository and language."""
    return S.rates(table(spark, sf, "files"), table(spark, sf, "chunks"), _invalid(spark, sf))


def p4_hinted(spark, sf):
    """Flagged files, their fault, and how many stored diagnostics name them."""
    return S.hinted(_invalid(spark, sf), table(spark, sf, "syntax_errors"))


def p4_scope(spark, sf):
    """Paths in a checked language, and flagged paths that are repeated or are none of them; rates that do not add up to these."""
    files = table(spark, sf, "files")
    checked = files.where("filepath IS NOT NULL").select("filepath").distinct().where(S.language_of(F.col("filepath")).isNotNull())
    flagged = _invalid(spark, sf).groupBy("filepath").agg(F.count("*").alias("k"))
    both = checked.withColumn("known", F.lit(1)).join(flagged, "filepath", "full_outer")
    return both.agg(
        F.count("known").alias("n_checked"), F.count(F.when(F.col("known").isNull(), 1)).alias("n_outside"), F.count(F.when(F.col("k") > 1, 1)).alias("n_repeated")
    )


QUERIES = {"p4_found": p4_found, "p4_rates": p4_rates, "p4_hinted": p4_hinted, "p4_scope": p4_scope}
# the invariants of a result that SQL cannot make
SQL = {
    "p4_scope": f"""SELECT count(DISTINCT filepath) AS n_checked, CAST(0 AS BIGINT) AS n_outside, CAST(0 AS BIGINT) AS n_repeated
FROM files WHERE lower(regexp_extract(filepath, '\\.(\\w+)$', 1)) IN ({', '.join(f"'{e}'" for e in L.LANGUAGE)})""",
}
