import random

import pytest

from glyphlake.llm import tokens

from . import cases

sentencepiece = pytest.importorskip("sentencepiece")
public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(tokens.DEFAULT_MODEL))


def test_counts_are_the_librarys_at_every_prefix(library):
    rng = random.Random(3)
    parts = ["a", "b", " ", "  ", "the", "ing", "\n", "é", "▁", "0", "12", "aaa", "!!", "漢", "\x00", "🎉", "².", "tion", "<s>", "　", '="', "http://"]
    counter = tokens.counter(None)
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        known = tokens.counts_at(counter.table(text))
        assert [int(x) for x in known] == [len(library.encode(text[:k])) for k in range(len(text) + 1)], text
        assert counter.count(text) == known[-1]


def test_truncation_to_a_budget(library):
    text = "The quick brown fox jumps over the lazy dog. " * 4
    table = tokens.counter(None).table(text)
    for budget in (0, 1, 7, 20, 1000):
        k = tokens.longest_prefix(table, budget)
        assert len(library.encode(text[:k])) <= budget
        assert k == len(text) or len(library.encode(text[: k + 1])) > budget or any(len(library.encode(text[:j])) > budget for j in range(k + 1, len(text) + 1))


def test_every_row_has_its_count(spark, library):
    rows = cases.rows()
    got = tokens.prefix_token_counts(cases.frame(spark), limit=50, with_table=True).collect()
    want = sorted(((r[0], len((r[1] or "").encode()), len(library.encode(r[1] or ""))) for r in rows), key=repr)
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=repr) == want
    assert all(r.over_limit == (r.n_tokens > 50) and int(tokens.counts_at(bytes(r.prefix_table))[-1]) == r.n_tokens for r in got)
    assert tokens.prefix_token_counts(cases.empty(spark)).collect() == []
