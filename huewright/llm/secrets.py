"""Secret scans over an incremental ledger of blobs.

Every historical version of a file is a blob, named by the SHA-256 of its content. The ledger holds one row for each
(blob, rule version) that has been scanned, with its findings. A run scans only the pairs that the ledger doesn't hold, once for
each distinct blob, appends them, and joins the findings back to all paths (rows) that hold the blob.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, code_points, few, map_rows, raw_texts, slices, unused, written

RULES_VERSION = "2024-2"
#: Kinds in the order in which spans of the same start are listed.
KINDS = ("assign", "access", "hex", "private_key", "github", "slack", "jwt", "url_password")
BASE = KINDS[:3]

# The patterns of the kinds, on UTF-8 bytes, so that classes and case are those of ASCII.
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{24,}")
# A key goes through its END line. Without one: header fields, then pieces of 32 base64 characters or more and whole lines of base64, between line ends
# (escaped ones too), quotes and quotation marks of replies, and the last short piece.
_KEY = rb"""-----BEGIN ((?:[A-Z0-9]+\x20)*PRIVATE\x20KEY(?:\x20BLOCK)?)-----(?:(?:[^-]|-(?!----))*+-----END\x20\1-----|(?:(?:\\[rn]|\s)+[A-Z][A-Za-z0-9-]*:\x20[^\n\\]*)*+(?:(?:(?:\\[rn]|[\s"'+,>|])*+(?:[A-Za-z0-9+/]{32,}+={0,2}|(?<=[\n>"'\x20\tn])=?[A-Za-z0-9+/]++={0,2}(?=["',]*(?:\s*?\n|\\[rn]|\s*\Z)))))*+)"""
_ADDED = {
    "private_key": (b"PRIVATE KEY", re.compile(_KEY)),
    "github": (b"gh", re.compile(rb"\bgh[opsur]_[A-Za-z0-9]{36,}")),
    "slack": (b"xox", re.compile(rb"\bxox[abprs]-[A-Za-z0-9-]{10,}")),
    "jwt": (b"eyJ", re.compile(rb"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
    "url_password": (b"://", re.compile(rb"\b[a-z][a-z0-9+.-]{1,20}://[^\s:@/]+:[^\s:@/]{4,}@")),
}
_WORDS = (b"passw", b"secret", b"token", b"api_key", b"apikey")


def find(raw: bytes | None) -> list[tuple[str, int, int]]:
    """Findings (kind, start, end) of a text in code points, by start, then by kind."""
    if not raw:
        return []
    out = []
    low = raw.translate(LOWER)
    if any(w in low for w in _WORDS):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(raw) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        out += [("access", *m.span()) for m in _ACCESS.finditer(raw) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in _HEX.finditer(raw)]
    for kind, (hint, pattern) in _ADDED.items():
        if hint in raw:
            out += [(kind, *m.span()) for m in pattern.finditer(raw)]
    if out:
        at = code_points(raw, (x for f in out for x in f[1:]))
        out = sorted(((k, at[a], at[b]) for k, a, b in out), key=lambda f: (f[1], KINDS.index(f[0]), f[2]))
    return out


_LEDGER = "blob string, findings array<struct<kind:string,start:long,end:long>>"


def _scan(batch: pa.RecordBatch) -> dict:
    """Findings of the distinct blobs of a batch."""
    blobs = dict(zip(batch.column(0).to_pylist(), raw_texts(batch, "text"), strict=True))
    return {"blob": list(blobs), "findings": [[{"kind": k, "start": a, "end": b} for k, a, b in find(raw)] for raw in blobs.values()]}


def blobs(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """docs with its blob: SHA-256 of the content, a null text counting as empty."""
    return docs.withColumn("blob", F.sha2(F.coalesce(F.col(text_column).cast("string"), F.lit("")), 256))


def update_ledger(docs: DataFrame, ledger: DataFrame | None = None, *, id_column: str = "doc_id", text_column: str = "text", rules_version: str = RULES_VERSION, broadcast_limit: int = 500_000) -> DataFrame:
    """New ledger rows (blob, rules_version, findings): one for each blob of docs that the ledger lacks under this rule version.

    Ids and digests alone are grouped to find unseen blobs and the row to read each from. Where these are no more than broadcast_limit they are sent
    to the tasks and the rows are scanned where they stand, so that no text is moved; else the texts are joined to them. Where the ledger
    knows all blobs, no text is read beyond its digest.
    """
    rows = blobs(docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text")))
    keys = rows.select("blob", "doc_id")
    if ledger is not None:
        keys = keys.join(ledger.where(F.col("rules_version") == rules_version).select("blob"), "blob", "left_anti")
    unseen = written(keys.groupBy("blob").agg(F.min("doc_id").alias("doc_id")))
    if unseen.isEmpty():
        found = docs.sparkSession.createDataFrame([], _LEDGER)
    else:
        r, u = rows.alias("r"), few(unseen, broadcast_limit).alias("u")
        here = r.join(u, (F.col("r.blob") == F.col("u.blob")) & F.col("r.doc_id").eqNullSafe(F.col("u.doc_id")), "left_semi")
        found = map_rows(here.select("blob", "text"), _scan, _LEDGER, 1000).dropDuplicates(["blob"])
    return found.select("blob", F.lit(rules_version).alias("rules_version"), "findings")


def scan_secrets(docs: DataFrame, ledger: DataFrame | None = None, *, id_column: str = "doc_id", text_column: str = "text", rules_version: str = RULES_VERSION, broadcast_limit: int = 500_000) -> tuple[DataFrame, DataFrame]:
    """(findings of every row, new ledger rows). A row: doc_id, blob, findings (by start; empty if there are none).

    Null and empty texts are the empty blob and have no findings. Repeated rows give repeated rows; an empty table gives none; other
    columns are not read. The new rows are written to the shared folder, so a lost executor doesn't cause a second scan.
    """
    new = written(update_ledger(docs, ledger, id_column=id_column, text_column=text_column, rules_version=rules_version, broadcast_limit=broadcast_limit))
    known = new if ledger is None else new.unionByName(ledger.where(F.col("rules_version") == rules_version).select("blob", "rules_version", "findings"))
    hits = known.where(F.size("findings") > 0).select("blob", "findings")
    paths = blobs(docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))).select("doc_id", "blob")
    empty = F.array().cast("array<struct<kind:string,start:long,end:long>>")
    return paths.join(hits, "blob", "left").select("doc_id", "blob", F.coalesce("findings", empty).alias("findings")), new


def _redact(text: str | None, findings: list[dict] | None) -> str | None:
    if text is None or not findings:
        return text
    out, at = [], 0
    for f in sorted(findings, key=lambda f: (f["start"], -f["end"])):
        if f["start"] >= at:
            out += [text[at : f["start"]], f"[{f['kind'].upper()}]"]
        at = max(at, f["end"])
    return "".join(out) + text[at:]


def redact(docs: DataFrame, ledger: DataFrame | None = None, *, id_column: str = "doc_id", text_column: str = "text", rules_version: str = RULES_VERSION, broadcast_limit: int = 500_000) -> DataFrame:
    """docs with every finding of scan_secrets in its text replaced by its kind in brackets; other columns, whatever their names, and all rows stay as they are.

    The findings are sent to the tasks where they are no more than broadcast_limit in all, else the rows are joined to them by blob. Null texts
    stay null and empty ones empty; ids may be null or repeated; an empty table gives none.
    """
    names, blob, findings = docs.columns, unused(docs, "blob"), unused(docs, "findings")
    found, _ = scan_secrets(docs, ledger, id_column=id_column, text_column=text_column, rules_version=rules_version, broadcast_limit=broadcast_limit)
    hits = written(found.where(F.size("findings") > 0).select(F.col("blob").alias(blob), F.col("findings").alias(findings)).dropDuplicates([blob]))
    rows = docs.withColumn(blob, F.sha2(F.coalesce(F.col(text_column).cast("string"), F.lit("")), 256))
    schema = docs.schema

    def run(batches):
        for batch in slices(batches):
            k = batch.schema.get_field_index(text_column)
            new = [_redact(x, y) for x, y in zip(batch.column(k).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)]
            columns = [batch.column(i) if i != k else pa.array(new, batch.schema.field(k).type) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.join(few(hits, broadcast_limit, F.size(findings)), blob, "left").select(*names, findings).mapInArrow(run, schema)


def digest_columns(findings: str = "findings"):
    """The counts, digest and span list of the findings as columns."""
    line = lambda kinds: F.array_join(F.transform(F.filter(findings, lambda f: f["kind"].isin(*kinds)), lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter(findings, lambda f: f["kind"] == kind)).cast("long")
    counts = [count(kind).alias(f"n_{kind}") for kind in BASE]
    return [*counts, F.sha2(line(BASE), 256).alias("base_sha256"), line(KINDS).alias("spans")]
