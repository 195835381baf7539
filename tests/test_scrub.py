"""Secret scrubbing: every pattern, spans, the policy, and that nothing skips the scan that holds a secret."""

import hashlib
import json
import random

import pytest
from pyspark.sql import Observation

from tidemark.operators import scrub
from tidemark.runtime import ship

KEY = "AKIA" + "0123456789ABCDEF"
PROBES = {
    "aws_access_key_id": [KEY, f"\u00e9{KEY}", f"id={KEY};"],
    "gcp_api_key": ["AIza" + "b_-" * 11 + "Zz"],
    "github_token": ["ghp_" + "a1" * 18, "ghr_" + "Z" * 40],
    "slack_token": ["xoxb-1234567890-x"],
    "jwt": ["eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl"],
    "private_key": [f"-----BEGIN {k} PRIVATE KEY-----\nMIIB\nxyz\n-----END {k} PRIVATE KEY-----" for k in ("RSA", "EC", "OPENSSH")],
    "connection_string": ["postgres://u:p@h/d", "Xredis://u:p@h", "mongodb+srv://me:pw@h"],
    "generic_secret": ["password:\tabcdefgh12", "TOKEN\n=\n'abcdefgh12'", "password=\u00e9\u00e9\u00e9\u00e9\u00e9\u00e9", "api-key : 12345678", 'passwd = "hunter2xx"', "secret=abcd\u00e9efg"],
}
ALL = [(kind, text) for kind, texts in PROBES.items() for text in texts]
CLEAN = ["a sentence about databases", "", "token of esteem: yes", "AKIA0123", "secret=short", "http://host/path", "password", "xox", "rapid apical"]


@pytest.mark.parametrize("kind, text", ALL)
def test_each_pattern_finds_its_secret_and_nothing_is_left(kind, text):
    found = scrub.scan(f"before {text} after")
    assert kind in {f["secret_type"] for f in found}
    for f in found:
        raw = f"before {text} after".encode()[f["start"] : f["start"] + f["length"]]
        assert raw.decode("utf-8", "replace") == f["match"]
    out = scrub.scrub(f"before {text} after", "jira_project")
    assert out["secrets_status"] == "redacted" and out["redacted_content"].startswith("before ") and not scrub.left_secret(found, out["redacted_content"])


def test_rows_agree_with_the_policy_on_every_probe(spark):
    """No prefilter stands between a secret and its scan."""
    ship(spark)
    rng = random.Random(4)
    glue = ["", " ", "\u00e9", "x", "\n", "=", '"', "\u2003", "_", "-"]
    texts = [t for _, t in ALL] + CLEAN + [rng.choice(glue).join([rng.choice(CLEAN), rng.choice(ALL)[1], rng.choice(CLEAN)]) for _ in range(300)]
    rows = [(i, t, ("git_repo", "jira_project", "drive_folder")[i % 3]) for i, t in enumerate(texts)] + [(-1, None, "git_repo"), (-2, "x" * 5_000_001, "jira_project")]
    seen = Observation()
    got = {r["id"]: r["scrub"] for r in scrub.scrub_rows(spark.createDataFrame(rows, "id long, raw_content string, source_type string"), seen).collect()}
    assert len(got) == len(rows) and seen.get["degraded"] == sum(r["scrub_mode"] == "gitleaks_degraded_regex" for r in got.values()) > 0
    for i, text, kind in rows:
        want = scrub.scrub(text, kind)
        findings = [f.asDict() for f in got[i]["findings"]] if got[i]["findings"] is not None else None
        assert got[i].asDict() | {"findings": findings} == want, text


def test_scan_is_quiet_on_clean_text_and_finds_every_occurrence():
    assert [scrub.scan(t) for t in CLEAN] == [[]] * len(CLEAN)
    a, b = scrub.scan(f"a {KEY} b {KEY} c")
    assert a["start"] != b["start"] and KEY not in scrub.redact(f"a {KEY} b {KEY} c", [a, b])


def test_redaction_of_several_overlapping_and_multibyte_spans():
    content = f"a {KEY} b ghp_{'Q' * 36} c"
    assert scrub.redact(content, scrub.scan(content)) == "a [REDACTED:aws_access_key_id] b [REDACTED:github_token] c"
    content = f"\u20ac prefix {KEY} suffix"
    assert scrub.redact(content, scrub.scan(content)) == "\u20ac prefix [REDACTED:aws_access_key_id] suffix"
    spans = [{"start": 3, "length": 20, "secret_type": "aws_access_key_id"}, {"start": 10, "length": 13, "secret_type": "generic_secret"}]
    assert scrub.redact(f"xx {KEY} yy", spans) == scrub.redact(f"xx {KEY} yy", spans[::-1]) == "xx [REDACTED:aws_access_key_id] yy"


@pytest.mark.parametrize("detector, kind, match, left, survives", [
    ("regex_scanner", "aws_access_key_id", KEY, f"left {KEY}", True), ("gitleaks", "custom-rule", "s3cr3t", "s3cr3t here", True),
    ("regex_scanner", "aws_access_key_id", KEY, "clean", False), ("regex_scanner", "generic_secret", "hunter2xx", "hunter2xx", False),
])
def test_what_may_survive(detector, kind, match, left, survives):
    assert scrub.left_secret([{"detector": detector, "secret_type": kind, "match": match}], left) is survives


def test_policy(monkeypatch):
    monkeypatch.setattr(scrub.shutil, "which", lambda _: None)
    out = scrub.scrub(f"token {KEY}\n", "git_repo")
    assert out["scrub_mode"] == "gitleaks_degraded_regex" and out["secrets_status"] == "redacted" and KEY not in out["redacted_content"]
    assert scrub.scrub("a comment", "jira_project")["secrets_status"] == "clean"
    assert scrub.scrub("x" * 5_000_001, "jira_project")["cancel_reason"] == "content_too_large"
    monkeypatch.setattr(scrub, "redact", lambda content, found: content)
    assert scrub.scrub(KEY, "jira_project")["cancel_reason"] == "unredactable_secret"
    monkeypatch.setattr(scrub, "scan", lambda content: (_ for _ in ()).throw(MemoryError()))
    assert scrub.scrub(KEY, "jira_project")["cancel_reason"] == "scrub_unavailable"


def test_gitleaks_report():
    content = f"line\nsecret is {KEY} here {KEY}\n"
    found = scrub.parse_gitleaks(json.dumps([{"RuleID": "aws", "Secret": KEY}, {"RuleID": "x", "Secret": "NOT THERE"}]), content)
    assert [content.encode()[f["start"] : f["start"] + f["length"]].decode() for f in found] == [KEY, KEY] and {f["detector"] for f in found} == {"gitleaks"}
    assert scrub.parse_gitleaks("", content) == scrub.parse_gitleaks("null", content) == []


def test_audit_rows_hold_no_secret(spark):
    ship(spark)
    raw = spark.createDataFrame([("s", "k", f"key {KEY}", "git_repo"), ("s", "l", "clean", "git_repo")], "source_id string, natural_key string, raw_content string, source_type string")
    (row,) = scrub.audit(scrub.scrub_rows(raw)).collect()
    assert row["match_hash"] == hashlib.sha256(KEY.encode()).hexdigest() and row["secret_type"] == "aws_access_key_id" and row["detected_at"] is not None
    assert KEY not in str(row)
