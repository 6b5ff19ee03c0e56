"""Secrets in texts: a ledger of scanned blobs, in built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxweave.runtime import cut

#: The kinds in the order in which spans at one place are listed, their patterns, the group that is
#: measured and its least length. The first three are the base.
RULES = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
    ("private_key", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----", 0, 1),
    ("code_host", r"\bgh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("chat", r"\bxox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("web_token", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30),
]
BASE = ("assign", "access", "hex")
RULE_VERSION = 1
_SALTS = 16


def _steps(text: Column, place: int, pattern: str, group: int) -> Column:
    """Matches of a rule, leftmost and not overlapping: place in the list of kinds, length m of the match, length g of
    what is measured, length b of the text between it and the match before."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    measured = matches if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return F.zip_with(F.zip_with(matches, measured, lambda m, g: F.struct(F.length(m).alias("m"), F.length(g).alias("g"))),
                      F.slice(between, 1, F.size(matches)),
                      lambda x, b: F.struct(F.lit(place).alias("place"), x["m"].alias("m"), x["g"].alias("g"), F.length(b).alias("b")))


def _may_match(text: Column, kind: str, pattern: str) -> Column:
    """A cheap necessary condition, so that most texts are searched once and not split."""
    if kind == "assign":
        return text.rlike(r"(?i:passw|secret|token|api_?key)")
    fixed = {"access": "AKIA", "private_key": "-----BEGIN ", "code_host": "gh", "chat": "xox", "web_token": "eyJ"}
    return text.rlike(pattern) if kind == "hex" else text.contains(fixed[kind]) & text.rlike(pattern)


def find_secrets(blobs: DataFrame) -> DataFrame:
    """blobs(blob, text) -> blob, spans array<struct<start, place, kind, end, g>> sorted by start, then kind; only
    blobs with a span. Positions are code points, the end exclusive. blob is unique.

    A match starts where the lengths of all matches and gaps of its rule before it add up to: a running sum over rows,
    so that a text of n matches costs n log n. The rows of a blob stay where its text is.
    """
    none = F.array().cast("array<struct<place:int,m:int,g:int,b:int>>")
    parts = [F.when(_may_match(F.col("text"), k, p), _steps(F.col("text"), i, p, g)).otherwise(none) for i, (k, p, g, _) in enumerate(RULES)]
    steps = blobs.select("blob", F.posexplode(F.concat(*parts)).alias("i", "step")).select("blob", "i", "step.*")
    so_far = Window.partitionBy("blob", "place").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    ends = steps.withColumn("end", F.sum(F.col("b") + F.col("m")).over(so_far).cast("int"))
    of_rule = lambda k: F.element_at(F.array(*[F.lit(r[k]) for r in RULES]), F.col("place") + 1)
    span = F.struct((F.col("end") - F.col("m")).alias("start"), "place", of_rule(0).alias("kind"), "end", "g")
    return ends.where(F.col("g") >= of_rule(3)).groupBy("blob").agg(F.sort_array(F.collect_list(span)).alias("spans"))


def scan(docs: DataFrame, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Scan the contents of all versions of documents that no ledger lists yet.

    docs(doc_id, text, ...): each row is a version found at a path (the doc_id). ledger(blob binary, rule_version int,
    spans) lists what was scanned before; None: nothing. Returns (findings, new ledger rows).

    findings: one row per input row: doc_id, spans array<struct<start, place, kind, end, g>>. A content is addressed
    by its SHA-256; equal contents are scanned once per version of the rules, and the spans are joined back to all
    paths. Null and empty texts have the address of the empty text and no spans. Null or repeated doc_id: each row is
    a version. Empty table: no rows. Other columns are ignored. The ledger rows hold an empty list for clean blobs, so
    that they are not scanned again.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    addressed = docs.select("doc_id", "text", F.unhex(F.sha2("text", 256)).alias("blob"))
    versions = addressed.select("doc_id", "blob")
    blobs = addressed.select("blob", "text").dropDuplicates(["blob"])
    if ledger is not None:
        current = ledger.where(F.col("rule_version") == RULE_VERSION)
        blobs = blobs.join(current.select("blob"), "blob", "left_anti")
    found = cut(find_secrets(blobs))
    findings = found if ledger is None else found.unionByName(current.where(F.size("spans") > 0).select("blob", "spans"))
    # A content may be at very many paths: paths are dealt over salts, and the few findings are repeated for each.
    salted = versions.withColumn("salt", F.pmod(F.hash("doc_id"), F.lit(_SALTS)))
    repeated = findings.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    none = F.array().cast("array<struct<start:int,place:int,kind:string,end:int,g:int>>")
    by_path = salted.join(repeated, ["blob", "salt"], "left").select("doc_id", F.coalesce("spans", none).alias("spans"))
    seen = versions.select("blob").distinct()
    if ledger is not None:
        seen = seen.join(current.select("blob"), "blob", "left_anti")
    fresh = seen.join(found, "blob", "left").select("blob", F.lit(RULE_VERSION).alias("rule_version"), F.coalesce("spans", none).alias("spans"))
    return by_path, fresh
