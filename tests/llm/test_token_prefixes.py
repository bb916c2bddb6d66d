import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.llm import token_prefixes as tp

FILE = public_tokenizers.path(tp.MODEL)


def encoded(text):
    return len(tp.counter(FILE).model.encode(text))


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("aab  eth\n\té▁中文ing,. "), max_size=60))
def test_every_prefix_has_the_count_of_its_encoding(text):
    counts, steps = tp.counter(FILE).steps(pa.array([text]))
    assert counts == [encoded(text)]
    sums = np.cumsum(np.frombuffer(steps[0], "<i2")).tolist()
    assert sums == [encoded(text[: i + 1]) for i in range(len(text))]


def test_long_words_are_walked_like_short_ones():
    word = "transformationalistically" * 12
    counts, steps = tp.counter(FILE).steps(pa.array([word, "a " + word[:70]]))
    assert counts == [encoded(word), encoded("a " + word[:70])]
    sums = np.cumsum(np.frombuffer(steps[0], "<i2")).tolist()
    assert sums[::17] == [encoded(word[: i + 1]) for i in range(0, len(word), 17)]


def test_counts_and_budgets(documents, odd, prose):
    rows = [(i, prose(50)) for i in range(20)] + odd
    found = tp.prefix_counts(documents(rows, extra=("steps", "n_tokens")), FILE)
    got = sorted(((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in found.collect()))
    assert got == sorted((i or 0, len((t or "").encode()), encoded(t or "")) for i, t in rows)
    answers = found.select("doc_id", tp.longest_within("steps", F.lit(30)).alias("n"), tp.tokens_before("steps", F.lit(9)).alias("m"))
    texts = {i: t or "" for i, t in rows}
    for r in answers.where("doc_id < 20 OR doc_id = 91").collect():
        text = texts[r["doc_id"]]
        assert r["n"] == max((i for i in range(len(text) + 1) if encoded(text[:i]) <= 30))
        assert r["m"] == encoded(text[:9])
    assert tp.prefix_counts(documents([]), FILE).count() == 0
