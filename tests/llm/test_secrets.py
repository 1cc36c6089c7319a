"""Spans against a scanner that goes character by character, and ownership counted plainly."""

import hashlib
import random
from collections import defaultdict

import pytest

from rolloom.llm import secrets

ALNUM = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
VALUE, TOKEN = ALNUM | set("+/_.=-"), ALNUM | set("+_=-")
NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey")


def run(text, at, chars):
    end = at
    while end < len(text) and text[end] in chars:
        end += 1
    return end


def assign_at(text, at):
    """End of key and value of an assignment at ``at``, by trying what may be left out."""
    low = "".join(c.lower() if c.isascii() else c for c in text[at : at + 8])
    for name in NAMES:
        if low.startswith(name):
            k = at + len(name)
            k += text[k : k + 1] in ('"', "'") and text[k : k + 1] != ""
            k = run(text, k, {" "})
            if text[k : k + 1] not in (":", "=") or k >= len(text):
                continue
            k = run(text, k + 1, {" "})
            k += text[k : k + 1] in ('"', "'") and text[k : k + 1] != ""
            end = run(text, k, VALUE)
            if end > k:
                return k, end
    return None


def plain_spans(text):
    spans, at = [], 0
    while at < len(text):
        got = assign_at(text, at)
        if got:
            if got[1] - got[0] >= 6:
                spans.append((at, 0, got[1]))
            at = got[1]
        else:
            at += 1
    for kind, chars, least in ((1, set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 20), (2, set("0123456789abcdef"), 24)):
        at = 0
        while at < len(text):
            begins = text.startswith("AKIA", at) if kind == 1 else text[at] in chars
            end = run(text, at, chars) if begins else at
            if end > at + (4 if kind == 1 else 0):
                if end - at >= least:
                    spans.append((at, kind, end))
                at = end
            else:
                at += 1
    return sorted(spans)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(51)
    bits = ["password", "Token", "api_key", "apikey", "SECRET", "=", ":", " ", "  ", '"', "'", "abc123xyz", "q8Zk3Xv9Lm2Rt5Yw7Bn4", "AKIA", "A1B2C3D4E5F6G7H8", "0123456789abcdef", "ab", "\n", "é", "ſ", ".", "/", "-_", "word", "copied0Example7Token5", "x" * 20]
    made = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(120)]
    return [*made, None, "", "token=" * 3 + "abcdefg", " ".join(["q8Zk3Xv9Lm2Rt5Yw7Bn4", "secret=abcdef0"] * 4000)]


def test_spans_and_classes_match_plain_code(spark, texts):
    rng = random.Random(53)
    source = [rng.choice(["a", "b", "c", "d", None]) for _ in texts]
    lang = [rng.choice(["en", "de", None]) for _ in texts]
    rows = [(i, t, lang[i], source[i], 0, 0, "") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, row int, hash int, spans string")
    found, owners, repos = [], defaultdict(set), defaultdict(set)
    for i, t in enumerate(texts):
        t = t or ""
        base = plain_spans(t)
        tokens, at = [], 0
        while at < len(t):
            end = run(t, at, TOKEN)
            if end - at >= 16 and secrets.looks_random(t[at:end]) and not any(a < end and at < b for a, _, b in base):
                tokens.append((at, 3, end))
            at = max(end, at + 1)
        values = [(s, t[assign_at(t, s[0])[0] : s[2]] if s[1] == 0 else t[s[0] : s[2]]) for s in base + tokens]
        for _, v in values:
            owners[v].add(source[i])
            repos[v].add((source[i] or "", lang[i] or ""))
        found.append((base, values))
    few = {v for v in owners if len(owners[v]) <= 2 and len(repos[v]) <= 3}
    for hot_rows in (50_000, 3):
        got = {r.doc_id: r for r in secrets.scan_secrets(docs, hot_rows=hot_rows).collect()}
        assert len(got) == len(texts)
        for i, (base, values) in enumerate(found):
            line = lambda spans: ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
            assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(k == n for _, k, _ in base) for n in range(3)], i
            assert got[i].base_sha256 == hashlib.sha256(line(base).encode()).hexdigest()
            assert got[i].spans == line([s for s, v in values if s[1] < 3 or v in few]), i


def test_repeated_rows_add_no_owner(spark):
    docs = spark.createDataFrame([(1, "key q8Zk3Xv9Lm2Rt5Yw7Bn4", "en", "me")] * 9 + [(None, None, None, None)], "doc_id long, text string, lang string, source string")
    got = secrets.scan_secrets(docs).collect()
    assert len(got) == 10 and sum(r.spans == "bare:4:24" and r.n_live == 1 for r in got) == 9


def test_many_spans_of_one_text_stay_small(spark, monkeypatch):
    """What is grouped grows with the spans, not with their square."""
    made = {}
    inner = secrets.materialize

    def sized(df, name):
        out = inner(df, name)
        made.setdefault(name, []).append(out)
        return out

    monkeypatch.setattr(secrets, "materialize", sized)
    rng = random.Random(5)
    text = "\n".join("%032x" % rng.getrandbits(128) for _ in range(50_000))
    docs = spark.createDataFrame([(1, text, "a", "en", 0, 0), (2, None, "b", "de", 0, 0)], "doc_id long, text string, source string, lang string, row int, hash int")
    got = {r.doc_id: r for r in secrets.scan_secrets(docs).collect()}
    assert got[1].n_hex == len(got[1].spans.split(",")) == 50_000 and got[2].spans == ""
    assert got[1].base_sha256 == hashlib.sha256(got[1].spans.encode()).hexdigest()
    assert len(made["secret-candidates"][0].where("__id = 1").first().base) == 64
