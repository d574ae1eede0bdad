import random

from tracelake.llm.mix import mix_shares, mixed_documents

TARGETS = "mix_name string, source string, target_share double, max_repeats int, n_tokens int"


def corpus(spark, n=400):
    rng = random.Random(3)
    rows = [(i, " ".join(["word"] * rng.randint(1, 60)), rng.choice("aaaaaabbc")) for i in range(n)] + [(n, None, "a"), (n + 1, "", "b"), (n + 2, "x", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_budgets_are_met_to_half_a_document(spark):
    docs = corpus(spark)
    targets = spark.createDataFrame(
        [("even", "a", 1.0, 1, 0), ("even", "b", 1.0, 4, 0), ("even", "c", 2.0, 9, 0), ("gone", "a", 0.5, 1, 0), ("gone", "zzz", 0.5, 3, 0), ("odd", "b", -1.0, 2, 0), ("odd", "c", 0.3, None, 0)], TARGETS
    )
    shares = {(r.mix_name, r.source): r for r in mix_shares(docs, targets).collect()}
    total = sum(len((r.text or "").split()) for r in docs.collect())
    for key, r in shares.items():
        if r.available_tokens * r.max_repeats >= r.wanted_tokens:
            assert abs(r.reached_tokens - r.wanted_tokens) <= 30, key
        else:
            assert r.reached_tokens == r.available_tokens * r.max_repeats, key
        assert r.most_repeats <= r.max_repeats
        assert abs(r.reached_share - r.reached_tokens / total) < 1e-9
    assert abs(shares["even", "c"].target_share - 0.5) < 1e-12 and shares["gone", "zzz"].reached_tokens == 0 == shares["odd", "b"].reached_tokens
    taken = mixed_documents(docs, targets).collect()
    for key, r in shares.items():
        own = [t for t in taken if (t.mix_name, t.source) == key]
        assert sum(t.repeats * t.n_tokens for t in own) == r.reached_tokens and len({t.doc_id for t in own}) == len(own) == r.documents


def test_same_choice_whatever_the_number_of_ranges(spark):
    docs = corpus(spark)
    targets = spark.createDataFrame([("m", "a", 0.2, 1, 0), ("m", "b", 0.8, 2, 0)], TARGETS)
    pick = lambda n: {tuple(r) for r in mixed_documents(docs, targets, partitions=n).collect()}
    assert pick(1) == pick(7) == pick(64)
    assert mixed_documents(docs.limit(0), targets).count() == 0 == mixed_documents(docs, targets.limit(0)).count()
