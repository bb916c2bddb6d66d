"""Token counts at every prefix of a text, by dynamic programming over the pieces of a BPE vocabulary."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from quire.llm.hashing import slices
from quire.llm.registry import load, query

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
SPACE = "▁"
MOST_WORDS, MOST_PAIRS = 250_000, 2_000_000
BASE = np.uint64(0xD6E8FEB86659FD93)
SHORT = 64  # words up to this length are worked out side by side


class PrefixCounter:
    """Exact token counts of every prefix, for a ``sentencepiece`` BPE model without normalisation.

    The tokens of a prefix end in the one token whose pair with the token before it is left unmerged by the merges: a
    list of tokens is the encoding of a text exactly if each neighbouring pair is the encoding of its own text. So
    count[i] = count[i - len(t)] + 1 for that token t, found by walking back over the pieces that end at i. No piece
    crosses from a character to a following space, so words repeat and each is worked out once.
    """

    def __init__(self, model_file: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = self.model.vocab_size()
        whole = range(n)
        usable = [i for i in whole if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i))]
        self.score = {self.model.id_to_piece(i): self.model.get_score(i) for i in usable}
        if any(SPACE in p.lstrip(SPACE) for p in self.score) or self.model.normalize("a  ﬁ") != f"{SPACE}a{SPACE} ﬁ":
            raise ValueError("the model must keep spaces in front of words and not normalise")
        self.whole = {p for p in self.score if len(self._merge(p)) == 1}
        self.sizes = sorted({len(p) for p in self.whole}, reverse=True)
        self.names = sorted(self.whole)
        self.by_size = self._hashed()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.codes: dict[int, bool] = {}
        self.words: dict[str, tuple[int, bytes]] = {}

    def _merge(self, text: str) -> list[str]:
        """Merge the best-scored neighbours, leftmost first, until none is a piece."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _apart(self, a: str, b: str) -> bool:
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            found = self.pairs[a, b] = self._merge(a + b) == [a, b]
        return found

    def _walk(self, text: str) -> list[int]:
        """Tokens of every prefix of ``text``, in which spaces are marks."""
        whole, sizes, apart = self.whole, self.sizes, self._apart
        last, counts = [""], [0]
        for end in range(1, len(text) + 1):
            for size in sizes:
                if size <= end and (token := text[end - size : end]) in whole:
                    before = last[end - size]
                    if not before or apart(before, token):
                        last.append(token)
                        counts.append(counts[end - size] + 1)
                        break
            else:  # a character outside the vocabulary: its bytes
                char = text[end - 1]
                last.append(char)
                counts.append(counts[end - 1] + len(char.encode("utf-8", "surrogatepass")))
        return counts[1:]

    def _hashed(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """For each length the sorted hashes of the pieces and their numbers."""
        out = {}
        for size in self.sizes:
            own = [i for i, n in enumerate(self.names) if len(n) == size]
            points = _points("".join(self.names[i] for i in own)).reshape(-1, size)
            with np.errstate(over="ignore"):
                hashes = points[:, 0]
                for k in range(1, size):
                    hashes = hashes * BASE + points[:, k]
            order = np.argsort(hashes)
            out[size] = hashes[order], np.array(own, dtype=np.int64)[order]
        return out

    def _learn(self, words: list[str]) -> None:
        """Work out a space and each word, all words by one position at a time."""
        texts = [SPACE + w for w in words]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        starts, points = np.cumsum(lengths) - lengths, _points("".join(texts))
        tokens, hashes = {}, points
        for size in range(1, min(self.sizes[0], int(lengths.max())) + 1):
            if size > 1:
                with np.errstate(over="ignore"):
                    hashes = np.concatenate([hashes[:1], hashes[:-1] * BASE + points[1:]])
            if size in self.by_size:
                known, numbers = self.by_size[size]
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                tokens[size] = np.where(known[at] == hashes, numbers[at], -1)
        last, counts = np.full(len(points), -1), np.zeros(len(points), dtype=np.int64)
        widths = np.array([1, 2, 3, 4])[np.searchsorted([0x80, 0x800, 0x10000], _points("".join(texts), False), side="right")]
        for end in range(1, int(lengths.max()) + 1):
            open_ = starts[lengths >= end] + end - 1
            for size in sorted((x for x in tokens if x <= end), reverse=True):
                own = tokens[size][open_]
                some = np.flatnonzero(own >= 0)
                if not len(some):
                    continue
                at, own = open_[some], own[some]
                if size == end:
                    good, before = np.ones(len(at), dtype=bool), 0
                else:
                    good, before = self._all_apart(last[at - size], own), counts[at - size]
                    before = before[good]
                at = at[good]
                last[at], counts[at] = own[good], before + 1
                rest = np.ones(len(open_), dtype=bool)
                rest[some[good]] = False
                open_ = open_[rest]
            counts[open_] = (counts[open_ - 1] if end > 1 else 0) + widths[open_]  # outside the vocabulary: its bytes
        steps = counts.copy()
        steps[1:] -= counts[:-1]
        steps[starts] = counts[starts]
        steps, ends = steps.astype("<i2").tobytes(), starts + lengths
        for word, a, b, n in zip(words, starts.tolist(), ends.tolist(), counts[ends - 1].tolist()):
            self.words[word] = n, steps[2 * a : 2 * b]

    def _all_apart(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        codes, where = np.unique(np.where(before < 0, -1, before * len(self.names) + token), return_inverse=True)
        found = []
        for code in codes.tolist():
            good = self.codes.get(code)
            if good is None:
                if len(self.codes) >= MOST_PAIRS:
                    self.codes.clear()
                a, b = divmod(code, len(self.names))
                good = self.codes[code] = code < 0 or self._merge(self.names[a] + self.names[b]) == [self.names[a], self.names[b]]
            found.append(good)
        return np.array(found, dtype=bool)[where]

    def _words(self, words: list[str]) -> list[tuple[int, bytes]]:
        """Of a space and each word: the tokens, and what each character adds to the count, as 16-bit steps."""
        if len(self.words) >= MOST_WORDS:
            self.words.clear()
        new = [w for w in words if w not in self.words]
        if short := [w for w in new if len(w) <= SHORT]:
            self._learn(short)
        for word in new:
            if len(word) > SHORT:
                counts = self._walk(SPACE + word)
                self.words[word] = counts[-1], np.diff(counts, prepend=0).astype("<i2").tobytes()
        return [self.words[w] for w in words]

    def steps(self, texts: pa.Array) -> tuple[list[int], list[bytes]]:
        """For each text its tokens and, for each character, by how much the prefix that ends there has more tokens than
        the one before; the first also counts what the space put in front of every text costs.

        Words that follow a single space are worked out alone. Texts with other runs of spaces are walked whole.
        """
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, f"^ |  | $|{SPACE}").to_pylist()
        pieces = pc.split_pattern(texts, " ")
        offsets = (np.asarray(pieces.offsets) - pieces.offsets[0].as_py()).tolist()
        coded = pieces.flatten().dictionary_encode()
        words = self._words(coded.dictionary.to_pylist())
        where = np.asarray(coded.indices)
        totals, each = np.array([w[0] for w in words], dtype=np.int64)[where], [w[1] for w in words]
        sums, whole = np.concatenate([[0], np.cumsum(totals)]), where.tolist()
        counts, out = [], []
        for i in range(len(texts)):
            a, b = offsets[i], offsets[i + 1]
            if odd[i]:
                found = self._walk(SPACE + texts[i].as_py().replace(" ", SPACE))
                counts.append(found[-1])
                out.append(_without_front(np.diff(found, prepend=0).astype("<i2").tobytes()))
            elif not len(texts[i].as_py()):
                counts.append(0)
                out.append(b"")
            else:
                counts.append(int(sums[b] - sums[a]))
                out.append(_without_front(b"".join([each[k] for k in whole[a:b]])))
        return counts, out


def _points(text: str, mixed: bool = True) -> np.ndarray:
    """Code points, spread over 64 bits for hashing."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    return points * np.uint64(0x9E3779B97F4A7C15) if mixed else points


def _without_front(steps: bytes) -> bytes:
    """Steps by character of the text alone: what the front space costs goes to the first character."""
    first = np.frombuffer(steps[:4], "<i2")
    return first.sum(dtype="<i2").tobytes() + steps[4:]


@cache
def counter(model_file: str) -> PrefixCounter:
    """One for each worker."""
    return PrefixCounter(model_file)


def prefix_counts(docs: DataFrame, model_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens, steps): exact token counts of whole texts and of all their prefixes.

    ``steps`` holds a 16-bit step for each character; ``tokens_before`` and ``longest_within`` answer from it how many
    tokens a prefix has and how far a text may go within a budget, without encoding anything again. Null and empty texts
    have no tokens. Repeated rows and null keys stay. An empty table gives none. Other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(model_file)
        for batch in slices(batches, "text", 4 << 20):
            texts = batch.column("text")
            counts, steps = own.steps(texts)
            sizes = pc.cast(pc.fill_null(pc.binary_length(texts), 0), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), sizes, pa.array(counts, pa.int64()), pa.array(steps, pa.binary())],
                ["key", "n_bytes", "n_tokens", "steps"],
            )

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, n_bytes long, n_tokens long, steps binary").withColumnRenamed("key", key)


def _answers(steps: pa.Array, asked: pa.Array, answer) -> pa.Array:
    found = [
        None if s is None or x is None else answer(np.cumsum(np.frombuffer(s, "<i2"), dtype=np.int64), x)
        for s, x in zip(steps.to_pylist(), asked.to_pylist())
    ]
    return pa.array(found, pa.int64())


@F.arrow_udf(LongType())
def tokens_before(steps: pa.Array, chars: pa.Array) -> pa.Array:
    """Tokens of the first ``chars`` characters."""
    return _answers(steps, chars, lambda counts, n: int(counts[min(n, len(counts)) - 1]) if n > 0 and len(counts) else 0)


@F.arrow_udf(LongType())
def longest_within(steps: pa.Array, budget: pa.Array) -> pa.Array:
    """Characters of the longest prefix of at most ``budget`` tokens; a longer prefix may have fewer tokens."""
    return _answers(steps, budget, lambda counts, n: int(np.flatnonzero(counts <= n)[-1]) + 1 if (counts <= n).any() else 0)


@query("op7_token_counts")
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = prefix_counts(load(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
