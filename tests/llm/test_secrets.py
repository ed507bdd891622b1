"""The secret scan against a scan character by character, planted layers with their places, awkward tables, and time."""

import base64
import hashlib
import textwrap
import time
import zlib

import pytest
from awkward import ROWS

from chainlake.llm import secrets

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def b64(text: str | bytes) -> str:
    return base64.b64encode(text.encode() if isinstance(text, str) else text).decode()


def run_of(text, i, allowed):
    j = i
    while j < len(text) and text[j] in allowed:
        j += 1
    return j


def brute_base(text):
    """(start, end, kind) from the words of the contract, without a pattern."""
    low = "".join(c.lower() if c in UPPER else c for c in text)
    out = []
    i = 0
    while i < len(text):
        word = next((w for w in ("password", "passwd", "secret", "token", "api_key", "apikey") if low.startswith(w, i)), None)
        end = None
        if word:
            j = i + len(word)
            j += j < len(text) and text[j] in "\"'"
            j = run_of(text, j, " ")
            if j < len(text) and text[j] in ":=":
                j = run_of(text, j + 1, " ")
                j += j < len(text) and text[j] in "\"'"
                end = run_of(text, j, UPPER + LOWER + DIGITS + "+/_.=-")
                if end == j:
                    end = None
                elif end - j >= 6:
                    out.append((i, end, "assign"))
        i = end or i + 1
    i = 0
    while (i := text.find("AKIA", i)) >= 0:
        end = run_of(text, i + 4, UPPER + DIGITS)
        if end - i >= 20:
            out.append((i, end, "access"))
        i = end if end > i + 4 else i + 1
    i = 0
    while i < len(text):
        end = run_of(text, i, DIGITS + "abcdef")
        if end - i >= 24:
            out.append((i, end, "hex"))
        i = max(end, i + 1)
    return sorted(out, key=lambda s: (s[0], secrets.KINDS.index(s[2])))


def test_query_equals_brute_force(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()}
    got = secrets.op7_secret_scan(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(texts)
    some = 0
    for r in got:
        base = brute_base(texts[r["doc_id"]])
        said = [f"{k}:{s}:{e}" for s, e, k in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(b[2] == k for b in base) for k in secrets.KINDS]
        assert set(said) <= set(r["spans"].split(",")) | ({""} if not said else set())
        some += len(base)
    assert some > 0


@pytest.mark.parametrize("text", ["AKIAAKIA" + "A" * 20, "token='x' token = 'abcdefgh'", 'passwd": "secret=abcdef"', "AKIA AKIA" + "B" * 16 + "c", "api_key:token=abcdef", "Token : " + "0" * 24, "a" * 24 + "g" + "b" * 23])
def test_base_spans_equal_brute_force(text):
    assert secrets.base_spans(text) == brute_base(text)


def test_all_findings_of_a_run_are_kept_with_their_places():
    def found(text):
        return [(f.value, text[f.start : f.end], f.depth) for f in secrets.scan_text(text)]

    assert found(f"x {b64('hello password=abcdef123 and token=zzzzzzzz99 end')} y") == [("password=abcdef123", "cGFzc3dvcmQ9YWJjZGVmMTIz", 1), ("token=zzzzzzzz99", "B0b2tlbj16enp6enp6ejk5", 1)]
    assert found("caf%C3%A9%20password%3Dhunter22%26token%3Dabcdefg z") == [("password=hunter22", "password%3Dhunter22", 1), ("token=abcdefg", "token%3Dabcdefg", 1)]
    assert found("\\ud83d\\ude00\\u0070assword=hunter22 y") == [("password=hunter22", "\\u0070assword=hunter22", 1)]
    # A base span that a decoding holds as well is one finding.
    assert found("password=hunter22%20x") == [("password=hunter22", "password=hunter22", 0)]
    inner = "password=abcdef1 token=qwertyui " + b64("password=inner11 secret=inner22")
    assert sorted(f.value for f in secrets.scan_text("z " + b64(zlib.compress(inner.encode())))) == ["password=abcdef1", "password=inner11", "secret=inner22", "token=qwertyui"]
    wrapped = "\n".join(textwrap.wrap(b64("some long filler " * 6 + "password=hunter22 more words"), 60))
    assert [f.value for f in secrets.scan_text(f"mail:\n{wrapped}\nend")] == ["password=hunter22"]


def test_a_decoding_that_leads_back_ends():
    text = "password%253Dhunter22"
    assert [(f.value, f.depth, f.start, f.end) for f in secrets.scan_text(text)] == [("password=hunter22", 2, 0, len(text))]
    quine = b64("%25" * 50)
    assert secrets.scan_text(quine) == []


def test_time_grows_with_the_text():
    n = 40_000
    texts = ("a" * n + "%", "a" * n + " %41", "\\x41" + " a" * (n // 2) + "{", "A-" * (n // 2), "%25" * (n // 3), "password" * (n // 8), "token" + " " * n, ("a" * 50 + "\n") * (n // 50), "AKIA" * (n // 4))
    for text in texts:
        took = []
        for k in (1, 8):
            began = time.perf_counter()
            secrets.scan_text(text * k)
            took.append(time.perf_counter() - began)
        assert took[0] < 0.5 and took[1] < 16 * max(took[0], 0.02), text[:20]


def test_awkward_tables(spark, odd, empty):
    got = secrets.findings(odd).collect()
    assert len(got) == len(ROWS)
    kinds = sorted((r["doc_id"] or -1, [f["kind"] for f in r["findings"]]) for r in got)
    assert kinds[0] == (-1, ["assign", "access"]) and all(not k for i, k in kinds if i != -1)
    assert secrets.findings(empty).count() == 0
