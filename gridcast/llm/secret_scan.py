"""Credentials in texts, judged by how widely their hashes are spread.

Candidates are found by pattern and at once replaced by their SHA-256.  A hash
seen at many owners is an example that people copy; one seen at a single
owner looks live.  A *repository* is the value of the source column, its
*owner* the part before the first slash (all of it, if there is none).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A hash at this many owners is taken for a widely copied example.
EXAMPLE_OWNERS = 3

#: (kind, literal that each match holds or None, pattern whose first group is the candidate)
PATTERNS = [
    ("aws_access_key", "A", r"\b((?:AKIA|ASIA)[0-9A-Z]{16})\b"),
    ("github_token", "gh", r"\b(gh[pousr]_[0-9A-Za-z]{36,})\b"),
    ("google_api_key", "AIza", r"\b(AIza[0-9A-Za-z_\-]{35})\b"),
    ("slack_token", "xox", r"\b(xox[abprs]-[0-9A-Za-z\-]{10,})\b"),
    ("stripe_key", "k_live_", r"\b([sr]k_live_[0-9A-Za-z]{16,})\b"),
    ("json_web_token", "eyJ", r"\b(eyJ[0-9A-Za-z_\-]{10,}\.[0-9A-Za-z_\-]{10,}\.[0-9A-Za-z_\-]{10,})\b"),
    ("private_key", "PRIVATE KEY", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----\s*([0-9A-Za-z+/=\s]{40,})-----END"),
    ("assigned_secret", None, r"""(?i)(?:password|passwd|pwd|secret|token|api[_\-]?key|access[_\-]?key)["']?\s*[:=]\s*["']?([0-9A-Za-z+/_\-]{12,})"""),
]

#: Candidates that nobody would take for real.
PLACEHOLDER_RE = r"(?i)example|sample|dummy|placeholder|changeme|your|xxxx|1234567|abcdef|^(?:0+|a+|x+)$"


def _named(kind: str) -> Callable[[Column], Column]:
    return lambda secret: F.struct(F.lit(kind).alias("kind"), secret.alias("secret"))


def _candidates(text: Column) -> Column:
    found = []
    for kind, literal, pattern in PATTERNS:
        hits = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), _named(kind))
        found.append(F.when(F.contains(text, F.lit(literal)), hits).otherwise(F.array().cast("array<struct<kind:string,secret:string>>")) if literal else hits)
    return F.concat(*found)


def ownership(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """A row for each distinct candidate of each kind.

    ``(kind, secret_sha256, n_occurrences, n_documents, n_repositories,
    n_owners, first_doc_id, verdict)``.  The verdict is ``placeholder`` where
    the candidate itself says so, ``example`` at ``example_owners`` owners or more,
    ``live`` at one owner, ``shared`` between, and ``unowned`` where no row has a source.

    Null and empty texts hold nothing.  Rows with a null id or source count as
    occurrences only.  A string that several patterns match has a row for each kind.  Repeated rows count as
    occurrences, not as further documents.  Candidates are hashed whole and texts read to their end, however long.
    An empty table gives no row.  Other columns, whatever their names, are ignored.
    """
    used = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("repository"), F.substring_index(F.col(source_col), "/", 1).alias("owner"), F.col(text_col).alias("text"))
    rows = used.select("doc_id", "repository", "owner", F.explode(_candidates(F.col("text"))).alias("c")).select(
        "doc_id", "repository", "owner", "c.kind", F.sha2(F.col("c.secret"), 256).alias("secret_sha256"), F.col("c.secret").rlike(PLACEHOLDER_RE).alias("placeholder")
    )
    counted = rows.groupBy("kind", "secret_sha256").agg(
        F.count(F.lit(1)).alias("n_occurrences"),
        F.count_distinct("doc_id").alias("n_documents"),
        F.count_distinct("repository").alias("n_repositories"),
        F.count_distinct("owner").alias("n_owners"),
        F.min("doc_id").alias("first_doc_id"),
        F.max("placeholder").alias("placeholder"),
    )
    verdict = (
        F.when(F.col("placeholder"), "placeholder").when(F.col("n_owners") >= example_owners, "example").when(F.col("n_owners") > 1, "shared").when(F.col("n_owners") == 1, "live").otherwise("unowned")
    )
    return counted.withColumn("verdict", verdict).drop("placeholder")


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


#: The same in DuckDB.
OWNERSHIP_SQL = f"""
WITH c AS ({" UNION ALL ".join(f"SELECT doc_id, source, {_quoted(kind)} AS kind, unnest(regexp_extract_all(text, {_quoted(pattern)}, 1)) AS secret FROM documents" for kind, _, pattern in PATTERNS)}),
r AS (SELECT doc_id, source AS repository, split_part(source, '/', 1) AS owner, kind, sha256(secret) AS secret_sha256, regexp_matches(secret, {_quoted(PLACEHOLDER_RE)}) AS placeholder FROM c),
g AS (SELECT kind, secret_sha256, count(*) AS n_occurrences, count(DISTINCT doc_id) AS n_documents, count(DISTINCT repository) AS n_repositories,
  count(DISTINCT owner) AS n_owners, min(doc_id) AS first_doc_id, bool_or(placeholder) AS placeholder FROM r GROUP BY kind, secret_sha256)
SELECT kind, secret_sha256, n_occurrences, n_documents, n_repositories, n_owners, first_doc_id,
  CASE WHEN placeholder THEN 'placeholder' WHEN n_owners >= {EXAMPLE_OWNERS} THEN 'example' WHEN n_owners > 1 THEN 'shared' WHEN n_owners = 1 THEN 'live' ELSE 'unowned' END AS verdict
FROM g
"""
