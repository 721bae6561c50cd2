"""Corpus-wide ownership frequency of secret candidates.

One scan takes the candidates out of every text with one alternation of patterns, and assignments with blanks, quotes or capitals with a
second one; only their hashes travel.  A private key is hashed with its body (without blanks and line ends), an assignment as name,
sign and value, however it is written; one whose value holds a candidate of another kind counts as that one.  Counts by
(hash, repository) are summed on the map side first, so a copied example costs a row for each task and repository, not for each copy; the
second aggregation has one row for each hash.  A hash that many owners have is a widely copied example; one of a single owner whose
value looks random is a live-looking credential.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

_HEADER = r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"
#: kind: pattern.  A private key goes up to its END (dashes are in a few header lines only, so a body never runs into another key);
#: without one, over the lines of its body that there are.
PATTERNS = {
    "access_key": r"AKIA[0-9A-Z]{16}",
    "forge_token": r"gh[pousr]_[A-Za-z0-9]{36}",
    "service_key": r"sk_live_[0-9a-zA-Z]{24}",
    "web_token": r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}",
    "private_key": _HEADER + r"(?:[^-]*(?:-[^-]+){0,12}-----END [A-Z ]{0,20}PRIVATE KEY-----|(?:(?:\s|\\[rn])+[A-Za-z0-9+/=]{40,}){0,1000})",
    "assignment": r"(?:password|passwd|secret|token|api_key|apikey)[=:][A-Za-z0-9/+_.-]{8,}",
    "hex_token": r"\b[0-9a-f]{40}\b",
}
ANY = "|".join(PATTERNS.values())
_SIGN = r"""["']?[ \t]*(?::=|=>|[=:])[ \t]*"""
#: An assignment in any case, with blanks and quotes.
WIDE = r"(?i:password|passwd|secret|token|api_key|apikey)" + _SIGN + r"""(?:"[^"\r\n]{8,}"|'[^'\r\n]{8,}'|[A-Za-z0-9/+_.-]{8,})"""
#: Owners from which on a value is an example, and distinct characters of a random-looking one.
EXAMPLE_OWNERS, DISTINCT = 3, 8


def kind(value: Column) -> Column:
    """The kind of what candidates() gives; null for an assignment of a value that needs quotes."""
    out = F.lit(None).cast("string")
    for k, p in reversed(PATTERNS.items()):
        out = F.when(value.startswith("-----BEGIN") if k == "private_key" else value.rlike("^(?:" + p + ")$"), k).otherwise(out)
    return out


def candidates(text: Column) -> Column:
    """What is hashed of each candidate of a text."""
    own = F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda v: F.when(v.startswith("-----BEGIN") & ~v.rlike("^" + _HEADER + "$"), F.regexp_replace(v, r"\s|\\[rn]", "")).otherwise(v))
    wide = F.filter(F.regexp_extract_all(text, F.lit(WIDE), F.lit(0)), lambda v: ~v.rlike(ANY))
    name, sign = (lambda v: F.lower(F.regexp_extract(v, "^[A-Za-z_]+", 0))), (lambda v: F.regexp_extract(v, "[=:]", 0))
    value = lambda v: F.regexp_extract(v, "^[A-Za-z_]+" + _SIGN + r"""(["']?)(.*)\1$""", 2)
    return F.concat(own, F.transform(wide, lambda v: F.concat(name(v), sign(v), value(v))))


def ownership(docs: DataFrame, repository: Column, owner: Column, text_col: str = "text", example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """secret_hash, kind, n_found, n_repositories, n_owners, verdict; one row for each distinct candidate.

    verdict: ``example`` (example_owners owners or more), else ``live`` (one owner, DISTINCT different characters at least), else
    ``shared`` (several owners) or ``weak``.  A null repository or owner is one of its own, named ''; null and empty texts
    have no candidates; a very long text is searched whole; repeated rows add to n_found only; values themselves aren't returned.  Texts that
    match two patterns at one place count as the first of PATTERNS.  Other columns don't matter, whatever their names.  An empty table
    gives an empty table.
    """
    own = docs.select(F.coalesce(repository.cast("string"), F.lit("")).alias("__repo"), F.coalesce(owner.cast("string"), F.lit("")).alias("__owner"), F.explode(candidates(docs[text_col])).alias("__v"))
    random = F.size(F.array_distinct(F.split(F.col("__v"), ""))) >= DISTINCT
    rows = own.select(F.sha2("__v", 256).alias("secret_hash"), F.coalesce(kind(F.col("__v")), F.lit("assignment")).alias("kind"), random.alias("__random"), "__repo", "__owner")
    per = rows.groupBy("secret_hash", "__owner", "__repo").agg(F.first("kind").alias("kind"), F.first("__random").alias("__random"), F.count("*").alias("__n"))
    per = per.groupBy("secret_hash", "__owner").agg(F.first("kind").alias("kind"), F.first("__random").alias("__random"), F.sum("__n").alias("__n"), F.count("*").alias("__repos"))
    out = per.groupBy("secret_hash").agg(F.first("kind").alias("kind"), F.first("__random").alias("__random"), F.sum("__n").alias("n_found"), F.sum("__repos").alias("n_repositories"), F.count("*").alias("n_owners"))
    verdict = F.when(F.col("n_owners") >= example_owners, "example").when(F.col("n_owners") > 1, "shared").when(F.col("__random"), "live").otherwise("weak")
    return out.select("secret_hash", "kind", "n_found", "n_repositories", "n_owners", verdict.alias("verdict"))


def op2_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' source is the owner, and its part in one language a repository of it."""
    docs = table(spark, sf_dir, "documents")
    return ownership(docs, F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))), docs["source"])


#: The SQL has patterns of its own: private keys by their first line, plain assignments only, bounded lengths.  Results agree on texts
#: without the other forms.
_SQL_PATTERNS = PATTERNS | {
    "web_token": r"eyJ[A-Za-z0-9_-]{10,200}\.[A-Za-z0-9_-]{10,400}\.[A-Za-z0-9_-]{10,200}",
    "private_key": _HEADER,
    "assignment": r"(?:password|passwd|secret|token|api_key|apikey)[=:][A-Za-z0-9/+_.-]{8,80}",
}
_SQL_ANY = "|".join(_SQL_PATTERNS.values())
_KINDS = " ".join(f"WHEN regexp_full_match(v, '{p}') THEN '{k}'" for k, p in _SQL_PATTERNS.items())
SQL = {
    "op2_secret_ownership": f"""
WITH c AS (SELECT coalesce(source, '') || '/' || coalesce(lang, '') AS repo, coalesce(source, '') AS owner, unnest(regexp_extract_all(text, '{_SQL_ANY}')) AS v FROM documents),
g AS (SELECT sha256(v) AS secret_hash, any_value(v) AS v, count(*) AS n_found, count(DISTINCT repo) AS n_repositories, count(DISTINCT owner) AS n_owners FROM c GROUP BY 1)
SELECT secret_hash, CASE {_KINDS} END AS kind, n_found, n_repositories, n_owners,
  CASE WHEN n_owners >= {EXAMPLE_OWNERS} THEN 'example' WHEN n_owners > 1 THEN 'shared' WHEN len(list_distinct(string_split(v, ''))) >= {DISTINCT} THEN 'live' ELSE 'weak' END AS verdict
FROM g
"""
}
QUERIES = {"op2_secret_ownership": op2_secret_ownership}
