import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quire.llm import packing
from quire.llm.byte_bpe import byte_bpe

FILES = public_tokenizers.path(packing.TOKENIZER), public_tokenizers.path(packing.RANKS)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab 's\t\n é1²中_.<|endoftext|>"), max_size=40), max_size=6))
def test_ids_are_those_of_the_tokenizer(texts):
    tokenizer = Tokenizer.from_file(FILES[0])
    texts = [*texts, "x <|endoftext|> y", "two  spaces   three \n\n end  ", None]
    got = byte_bpe(*FILES).encode(pa.array(texts, pa.string()))
    assert [x.tolist() for x in got] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_patterns_hold_every_piece_once():
    rng = random.Random(1)
    for counts, share in (
        ({n: rng.randint(1, 50) for n in rng.sample(range(1, 1025), 300)}, 0.94),
        (Counter(min(1024, int(rng.expovariate(1 / 300)) + 1) for _ in range(20_000)), 0.995),  # as documents are
        ({}, 0),
    ):
        check_patterns(counts, share)


def check_patterns(counts, share):
    patterns = packing.pack_histogram(counts, 1024)
    held = Counter()
    for pattern, count in patterns:
        assert sum(pattern) <= 1024
        for n in pattern:
            held[n] += count
    assert held == counts
    used = sum(n * c for n, c in counts.items())
    assert used >= share * 1024 * sum(c for _, c in patterns)


def check(rows, df, length=1024):
    tokenizer = Tokenizer.from_file(FILES[0])
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in df.collect():
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    for places in sequences.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= length
    want = defaultdict(list)
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for a in range(0, len(ids), length):
            part = ids[a : a + length]
            want[i].append((a, len(part), zlib.crc32(part.tobytes()), len(ids)))
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}


def test_pack_against_brute_force(documents, odd, prose, monkeypatch):
    rows = [(i, prose(10 + 37 * i % 900)) for i in range(60)] + [(100 + i, "one and the same") for i in range(40)] + odd
    df = documents(rows, extra=("start", "length", "rank", "part"))
    check(rows, packing.pack(df, *FILES))
    monkeypatch.setattr(packing, "RANKED_ROWS", 5)
    monkeypatch.setattr(packing.ranked, "__defaults__", (5,))
    check(rows, packing.pack(df, *FILES))
    assert packing.pack(documents([]), *FILES).count() == 0
