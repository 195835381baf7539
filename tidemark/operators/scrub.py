"""Secret scrubbing, fail-closed: scan, redact, verify, audit."""

from __future__ import annotations

import json
import re
import shutil
import subprocess
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import model
from tidemark.functions.batches import by_rows

MAX_SCAN_BYTES = 5_000_000
_PEM = "|".join(f"-----BEGIN {k}PRIVATE KEY-----.*?-----END {k}PRIVATE KEY-----" for k in ("RSA ", "DSA ", "EC ", "PGP ", "OPENSSH ", ""))
#: (secret type, rule, pattern), in scan order; all read the same in Java, Python and RE2.
PATTERNS = [
    ("aws_access_key_id", "aws-access-key", r"\bAKIA[A-Z0-9]{16}\b"),
    ("gcp_api_key", "gcp-api-key", r"\bAIza[\w-]{35}\b"),
    ("github_token", "github-pat", r"\bgh[oprsu]_[a-zA-Z0-9]{36,}\b"),
    ("slack_token", "slack-token", r"\bxox[abprs]-[a-zA-Z0-9-]{10,}\b"),
    ("jwt", "jwt", r"\beyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,}\b"),
    ("private_key", "private-key", f"(?s)(?:{_PEM})"),
    ("connection_string", "connection-string", r"(?:redis|amqp|mysql|mongodb(?:\+srv)?|postgres(?:ql)?)://[^\s:@/]+:[^\s@/]+@"),
    ("generic_secret", "generic-secret", r"""(?i)(?:passw(?:or)?d|secret|token|api[_-]?key)\s*[=:]\s*['"]?[^\s'"]{8,}['"]?"""),
]
#: What every match of a pattern holds: plain text, and for the last pattern how it begins.
LITERALS = ("AKIA", "AIza", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "eyJ", "-----BEGIN ", "://")
_GENERIC_START = r"(?i)(?:passw(?:or)?d|secret|token|api[_-]?key)\s*[=:]"
HIGH_CONFIDENCE = {t for t, _, _ in PATTERNS} - {"generic_secret"}
_COMPILED = [(t, r, re.compile(p.encode(), re.ASCII)) for t, r, p in PATTERNS]
RESULT = T.StructType([
    T.StructField("redacted_content", T.StringType()), T.StructField("findings", T.ArrayType(model.FINDING)), T.StructField("scrub_mode", T.StringType()),
    T.StructField("secrets_status", T.StringType()), T.StructField("cancel_reason", T.StringType()),
])


def scan(content: str) -> list[dict]:
    """All matches of all patterns, with byte offsets, in pattern order."""
    data = content.encode("utf-8", "surrogatepass")
    return [
        {"detector": "regex_scanner", "rule_id": rule, "secret_type": kind, "start": m.start(), "length": m.end() - m.start(), "match": m.group().decode("utf-8", "replace")}
        for kind, rule, pattern in _COMPILED
        for m in pattern.finditer(data)
    ]


def merged_spans(findings: list[dict]) -> list[tuple[int, int, str]]:
    """Spans by position; those that overlap or touch are one, named by the first."""
    spans: list[tuple[int, int, str]] = []
    for f in sorted(findings, key=lambda f: (f["start"], f["start"] + f["length"])):
        start, end = f["start"], f["start"] + f["length"]
        if spans and start <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(spans[-1][1], end), spans[-1][2])
        else:
            spans.append((start, end, f["secret_type"]))
    return spans


def redact(content: str, findings: list[dict]) -> str:
    data, out, at = content.encode("utf-8", "surrogatepass"), [], 0
    for start, end, kind in merged_spans(findings):
        out += [data[at:start], f"[REDACTED:{kind}]".encode()]
        at = end
    return b"".join([*out, data[at:]]).decode("utf-8", "replace")


def left_secret(findings: list[dict], redacted: str) -> bool:
    """Whether a high-confidence match is still there after redaction."""
    return any(f["match"] in redacted for f in findings if f["detector"] == "gitleaks" or f["secret_type"] in HIGH_CONFIDENCE)


def parse_gitleaks(report: str, content: str) -> list[dict]:
    """Findings of a gitleaks report; every occurrence of each reported secret counts."""
    data, out = content.encode("utf-8", "surrogatepass"), []
    for entry in json.loads(report or "[]") or []:
        secret = entry.get("Secret") or entry.get("Match") or ""
        raw = secret.encode()
        at = data.find(raw) if raw else -1
        while at >= 0:
            out.append({"detector": "gitleaks", "rule_id": entry.get("RuleID") or "unknown", "secret_type": entry.get("RuleID") or "unknown", "start": at, "length": len(raw), "match": secret})
            at = data.find(raw, at + len(raw))
    return out


def gitleaks(content: str, command: str = "gitleaks") -> list[dict] | None:
    """Findings of the gitleaks program, None if it is missing or broken (the caller degrades)."""
    path = shutil.which(command)
    if path is None:
        return None
    try:
        with tempfile.TemporaryDirectory() as private:
            source, report = Path(private, "content"), Path(private, "report.json")
            source.write_text(content)
            done = subprocess.run([path, "detect", "--no-git", "--source", source, "--report-format", "json", "--report-path", report], capture_output=True, timeout=60)
            if done.returncode == 0:
                return []
            return parse_gitleaks(report.read_text(), content) if done.returncode == 1 else None
    except (OSError, ValueError, subprocess.SubprocessError):
        return None


def scrub(content: str | None, source_type: str) -> dict:
    """The scrub policy for one content: cancelled content comes back null with a reason."""
    empty = dict.fromkeys(("redacted_content", "findings", "scrub_mode", "secrets_status", "cancel_reason"))
    if content is None:
        return empty
    if len(content.encode("utf-8", "surrogatepass")) > MAX_SCAN_BYTES:
        return empty | {"cancel_reason": "content_too_large"}
    found, mode = None, "regex"
    if source_type == "git_repo":
        found, mode = gitleaks(content), "gitleaks"
    if found is None:
        mode = "gitleaks_degraded_regex" if source_type == "git_repo" else "regex"
        try:
            found = scan(content)
        except (RecursionError, re.error, MemoryError, ValueError):
            return empty | {"cancel_reason": "scrub_unavailable"}
    redacted = redact(content, found) if found else content
    if left_secret(found, redacted):
        return empty | {"cancel_reason": "unredactable_secret"}
    return {"redacted_content": redacted, "findings": found, "scrub_mode": mode, "secrets_status": "redacted" if found else "clean", "cancel_reason": None}


scrub_udf = by_rows(scrub, RESULT)


def may_hold_secret(content: Column) -> Column:
    """A JVM-side test that no content with a finding fails, so that the others skip Python. It asks
    for less than the patterns do: only what each match holds in any case, never for word edges or
    lengths, which the JVM counts in characters and scan() in bytes."""
    out = content.rlike(_GENERIC_START)
    for literal in LITERALS:
        out = out | content.contains(literal)
    return out


def scrub_rows(raw: DataFrame, observation: Observation | None = None) -> DataFrame:
    """raw (raw_content, source_type, ...) with a struct column `scrub`, in one pass. Only contents
    that may hold a secret go to Python, and all of git sources where gitleaks is installed; too
    large ones are cancelled unread. observation counts degraded scans."""
    git = F.col("source_type") == "git_repo"
    need = may_hold_secret(F.col("raw_content"))
    if shutil.which("gitleaks"):
        need = need | git
    large = F.octet_length("raw_content") > MAX_SCAN_BYTES
    marked = raw.withColumn("_state", F.when(F.col("raw_content").isNull(), "null").when(large, "large").when(need, "scan").otherwise("clean"))
    sent = F.when(F.col("_state") == "scan", F.col("raw_content"))
    scanned = marked.withColumn("_scan", scrub_udf(sent, F.coalesce("source_type", F.lit(""))))
    mode = F.when(git, "gitleaks_degraded_regex").otherwise("regex")
    text, findings = F.lit(None).cast("string"), T.ArrayType(model.FINDING)
    clean = F.struct(F.col("raw_content").alias("redacted_content"), F.array().cast(findings).alias("findings"), mode.alias("scrub_mode"), F.lit("clean").alias("secrets_status"), text.alias("cancel_reason"))
    reason = F.when(F.col("_state") == "large", "content_too_large")
    none = F.struct(text.alias("redacted_content"), F.lit(None).cast(findings).alias("findings"), text.alias("scrub_mode"), text.alias("secrets_status"), reason.alias("cancel_reason"))
    out = scanned.withColumn("scrub", F.when(F.col("_state") == "scan", F.col("_scan")).when(F.col("_state") == "clean", clean).otherwise(none)).drop("_state", "_scan")
    if observation is not None:
        out = out.observe(observation, F.count_if(F.col("scrub.scrub_mode") == "gitleaks_degraded_regex").alias("degraded"))
    return out


def audit(scrubbed: DataFrame) -> DataFrame:
    """Audit rows of all findings, with the time of the scan; they hold a hash of the match, never
    the match."""
    keep = [c for c in ("source_id", "natural_key") if c in scrubbed.columns]
    rows = scrubbed.select(*keep, F.explode("scrub.findings").alias("f"))
    column = lambda c: F.col(c) if c in scrubbed.columns else F.lit(None).cast("string")
    return rows.select(
        column("source_id").alias("source_id"), F.lit(None).cast("string").alias("chunk_id"), column("natural_key").alias("file_reference"), "f.detector", "f.rule_id", "f.secret_type",
        F.struct("f.start", "f.length").alias("span"), F.sha2("f.match", 256).alias("match_hash"), F.lit("redacted").alias("action"), F.current_timestamp().alias("detected_at"),
    )
