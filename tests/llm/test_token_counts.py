"""Token counts against the tokenizer's own library."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rolloom.llm import token_counts as tc

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def spec():
    return tc.read_tokenizer(PATH)


@pytest.fixture(scope="module")
def counted():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def odd_texts():
    rng = random.Random(12)
    out = [
        "", " ", "   ", "a", "  a", "a  ", "a\n", "\n\n x\t\ty \n", "it's we're I'll 'tis ''s 's don't'll 're'r'e 'l 'll'v 've 'v", "a 's a' s 's's't 1's !'s \n's",
        "<|endoftext|>", "  <|endoftext|>  a<|endoftext|><|endoftext|>b", "<|endoftext", "x" * 3000, "é" * 300 + "!!!" + "'" * 7 + "s", "日本語 12３４ ½", "👍🏽👍 c\x1cd\x85e", "\0a\0",
    ]
    letters = "ab 's'tr've'll elmd\n\t 1!2é日<"
    out += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(800)]
    out += ["".join(chr(rng.choice([rng.randint(1, 127), rng.randint(128, 0x2FFF), rng.randint(0x10000, 0x1FFFF)])) for _ in range(rng.randint(0, 50))) for _ in range(200)]
    return out


def test_counts_are_the_librarys(spec, counted):
    texts = odd_texts()
    assert tc.Counter(spec).count(texts) == counted(texts)


@pytest.mark.parametrize("stretch", [7, 64, 700])
def test_texts_beyond_a_stretch(spec, counted, monkeypatch, stretch):
    monkeypatch.setattr(tc, "STRETCH", stretch)
    texts = odd_texts()
    assert tc.Counter(spec).count(texts) == counted(texts)


def test_what_was_compiled_may_be_forgotten(spec, counted, monkeypatch):
    monkeypatch.setattr(tc, "MOST_STATES", 50)
    monkeypatch.setattr(tc, "MOST_WORDS", 20)
    counter, texts = tc.Counter(spec), odd_texts()
    assert [counter.count([t])[0] for t in texts] == counted(texts)
    assert len(counter.merger.states) < 3000


def test_chunks_learn_their_entry_state(spec):
    step, out = tc.splitter()
    rng = random.Random(3)
    symbols = tc.np.array([rng.choice([0, 0, 0, 1, 2, 3, 4, 5, 6, 7, 7, 8, 9]) for _ in range(tc.CHUNK * 9 + 31)], tc.np.uint8)
    starts, state = tc.word_starts(symbols, step, out, tc.BREAK)
    now, marks = tc.BREAK, [0] * (len(symbols) + 1)
    for i, c in enumerate(symbols):
        at = now * tc.SYMBOLS + int(c)
        marks[i + 1], now = int(out[at]), int(step[at])
    assert now == state
    assert starts.tolist() == [bool(marks[i + 1] & tc.HERE) or bool(i + 2 < len(marks) and marks[i + 2] & tc.BEFORE) for i in range(len(symbols))]


def test_odd_rows(spark, counted):
    texts = [None, "", " ", "It's <|endoftext|> here", "long " * 40_000, "It's <|endoftext|> here"]
    rows = [(i if i else None, t, "x", 5, "y") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, n_bytes int, special string")
    got = tc.count_tokens(docs, PATH).collect()
    want = counted(texts)
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == [(i, len((t or "").encode()), want[i], want[i] > 1024) for i, t in enumerate(texts)]
    assert tc.count_tokens(docs.where("false"), PATH).collect() == []
