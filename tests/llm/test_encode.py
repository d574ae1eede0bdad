import base64
import random

import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tracelake.llm.bpe import PATTERN, VOCABULARY, RankQueue, Tokenizer
from tracelake.llm.encode import token_counts, token_ids

OWN = Tokenizer()
with open(VOCABULARY, "rb") as lines:
    RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
OTHER = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(st.text())
def test_ids_match_the_library(text):
    assert OWN.encode(text) == OTHER.encode_ordinary(text)


def test_long_pretokens_and_special_strings():
    rng = random.Random(1)
    for text in ("a" * 20_000, "".join(rng.choice("abcdef") for _ in range(20_000)), "é漢🙂" * 3000, "<|endoftext|> <s> [INST]", "\x00\t\n   "):
        ids = OWN.encode(text)
        assert ids == OTHER.encode_ordinary(text)
        assert b"".join(OWN.tokens[i] for i in ids).decode() == text


def test_rank_queue_is_a_priority_queue():
    rng = random.Random(2)
    queue, plain = RankQueue(50_256), {}
    for _ in range(5000):
        if plain and rng.random() < 0.4:
            rank, positions = queue.take()
            assert rank == min(plain) and positions == plain.pop(rank)
        else:
            rank, position = rng.choice([0, 63, 64, 4095, 4096, 50_255, rng.randrange(50_256)]), rng.randrange(1000)
            queue.add(rank, position)
            plain.setdefault(rank, []).append(position)
    while plain:
        assert queue.take()[0] == min(plain) and plain.pop(min(plain))
    assert queue.take() is None


def test_documents(spark):
    rows = [(1, "hello world", "a", 5), (2, "", "a", 6), (3, None, None, 7), (1, "hello world", "a", 5), (None, "  ", "b", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, ids int")
    got = sorted((str(r.doc_id), r.ids) for r in token_ids(df).collect())
    want = sorted((str(d), OTHER.encode_ordinary(t) if t else []) for d, t, _, _ in rows)
    assert got == want
    assert token_ids(df.limit(0)).count() == 0 and token_ids(df).schema.simpleString() == "struct<doc_id:bigint,ids:array<int>>"
    assert {(r.doc_id, r.n_tokens) for r in token_counts(df).collect()} == {(1, 2), (2, 0), (3, 0), (None, 2 if len(OTHER.encode_ordinary("  ")) == 2 else 1)}
