"""Secret scans with an incremental ledger of content-addressed blobs.

Every historical version of a text is a blob, addressed by its SHA-256. The ledger holds one
row for each (blob, rule version) that has been scanned, with its findings. A run hashes all
versions, takes one version of each blob that the ledger lacks under the present rules, scans
only those, appends them to the ledger, and joins the ledger's findings back to all versions.
Copies are scanned once; a run after new versions arrive scans the new blobs only; a change
of the rules changes the rule version, so everything is scanned anew.

Only ids and hashes are grouped; the text is exchanged once, joined by hash table to the chosen
versions. A blob shared by a third of all versions is one row of the ledger; the join back to
its versions is left to adaptive skew handling.

Defined cases: a NULL text is the empty blob; repeated rows and NULL ids are returned like all
others; an empty table gives an empty result and an empty ledger.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fieldpulse.llm.dealing import join_dealt
from fieldpulse.llm.registry import query, table
from fieldpulse.session import materialize, scratch_path

# The base patterns, with the smallest length of the part that counts.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ASSIGN_LENGTH = 6
BASE_KINDS = ("assign", "access", "hex")
# Further kinds with a pattern and a literal that every match begins with.
MORE_KINDS = {
    "private_key": (r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", "-----BEGIN "),
    "forge_token": (r"gh[pousr]_[A-Za-z0-9]{36,}", "gh"),
    "chat_token": (r"xox[abprs]-[A-Za-z0-9-]{10,}", "xox"),
    "cloud_key": (r"AIza[0-9A-Za-z_-]{35}", "AIza"),
    "signed_token": (r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "eyJ"),
}
KINDS = (*BASE_KINDS, *MORE_KINDS)

_assign = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
# A run shorter than the bound can hold no later match, so the bound may stand in these two patterns.
_access = re.compile(r"AKIA[A-Z0-9]{16,}")
_hex = re.compile(r"[0-9a-f]{24,}")
_more = {kind: (re.compile(pattern), literal) for kind, (pattern, literal) in MORE_KINDS.items()}

RULE_VERSION = hashlib.sha256(repr((ASSIGN, ASSIGN_LENGTH, _access.pattern, _hex.pattern, MORE_KINDS)).encode()).hexdigest()[:16]

LEDGER = "blob string, rule_version string, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"


def find(text: str, raw: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all findings by start, then kind; code points, end exclusive."""
    found = []
    low = raw.lower()
    if any(word in low for word in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in _assign.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LENGTH]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _access.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _hex.finditer(text)]
    for kind, (pattern, literal) in enumerate(_more.values(), len(BASE_KINDS)):
        if literal in text:
            found += [(m.start(), kind, m.end()) for m in pattern.finditer(text)]
    return sorted(found)


def _listed(found: Iterable[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in found)


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for blob, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = raw.as_py() or b""
            found = find(raw.decode("utf-8", "replace"), raw)
            base = [f for f in found if f[1] < len(BASE_KINDS)]
            counts = [sum(f[1] == kind for f in base) for kind in range(len(BASE_KINDS))]
            rows.append((blob, RULE_VERSION, *counts, hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(found)))
        names = [c.split()[0] for c in LEDGER.split(", ")]
        types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def update_ledger(versions: DataFrame, ledger: str, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Scan what the ledger folder lacks, append it, and return (version id, blob) of all versions.

    A run that is repeated after a failure finds what was appended and scans the rest.
    """
    spark = versions.sparkSession
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = versions.select(F.col(row_id).alias("_id"), body.alias("_text")).withColumn("blob", F.sha2("_text", 256))
    hashed = materialize(rows.select("_id", "blob"), "versions")
    unseen = hashed.groupBy("blob").agg(F.min("_id").alias("_chosen"))
    seen = _read_ledger(spark, ledger)
    if seen is not None:
        unseen = unseen.join(seen.select("blob").distinct(), "blob", "left_anti")
    chosen = unseen.withColumnRenamed("blob", "_blob").hint("shuffle_hash")
    to_scan = rows.join(chosen, (F.col("blob") == F.col("_blob")) & F.col("_id").eqNullSafe(F.col("_chosen")))
    scanned = to_scan.select("blob", "_text").mapInArrow(_scan, LEDGER)
    # rows that agree in id and text were scanned alike
    scanned.dropDuplicates(["blob"]).write.mode("append").parquet(ledger)
    return hashed


def _read_ledger(spark, ledger: str) -> DataFrame | None:
    """The rows under the present rules, or None before the first run."""
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(LEDGER).parquet(ledger).filter(F.col("rule_version") == RULE_VERSION)


def scan_versions(versions: DataFrame, ledger: str | None = None, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for every version: doc_id, blob, counts, digest of the base spans, all spans.

    Without `ledger` a fresh one in the shared folder is used.
    """
    spark = versions.sparkSession
    ledger = ledger or scratch_path(spark, "ledger")
    hashed = update_ledger(versions, ledger, row_id, text)
    # runs that overlap may both have scanned a blob
    findings = _read_ledger(spark, ledger).drop("rule_version").dropDuplicates(["blob"])
    return join_dealt(hashed.withColumnRenamed("_id", "doc_id"), findings, ["blob"])


@query("op1_secret_scan")
def op1_secret_scan(spark, folder):
    found = scan_versions(table(spark, folder, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
