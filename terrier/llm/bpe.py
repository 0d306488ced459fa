"""BPE encoding and decoding with a compiled lexicon of frequent words.

One pass counts the words of all texts. Words above a rate (so at most its
inverse are kept, whatever the corpus) are merged once, compiled with their ids
into a minimal acyclic transducer, and put as one file beside the checkpoints;
Spark hands it to every executor, whose workers memory-map it. Words that are not
in it are merged exactly, so the lexicon only saves time.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrier.llm.common import slices
from terrier.llm.lexicon import Lexicon, compile_words
from terrier.session import scratch_dir, staged

#: A word is compiled if it makes up this share of all words or more: at most 1,000,000 words.
LEXICON_RATE = 1e-6
#: Chunks of texts that a worker remembers.
MEMO_ENTRIES = 400_000
#: Distinct words a counting task holds before it hands its counts on.
COUNT_ENTRIES = 200_000


def vocabulary_path() -> str:
    """The vocabulary file where none is given: ``TERRIER_TOKENIZER``, or the public one installed."""
    if "TERRIER_TOKENIZER" in os.environ:
        return os.environ["TERRIER_TOKENIZER"]
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """The visible character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 characters stand for themselves, the others follow from U+0100 in order.
    """
    shown = [chr(b) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173 else "" for b in range(256)]
    free = iter(range(256, 512))
    return [c or chr(next(free)) for c in shown]


class WordBpe:
    """A word-level BPE vocabulary with word ends, read from its JSON text."""

    def __init__(self, definition: str) -> None:
        model = json.loads(definition)
        self.specials = {t["content"]: t["id"] for t in model["added_tokens"]}
        pattern = model["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        model = model["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"]
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.pieces = regex.compile(pattern)
        self.special = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")") if self.specials else None
        self.symbols = byte_symbols()
        self.tokens = {i: t for t, i in {**self.vocab, **self.specials}.items()}
        # the same as arrays: ids of bytes within and at the end of a word, and merges by pair of ids
        self.inner = np.array([self.vocab.get(s, -1) for s in self.symbols])
        self.outer = np.array([self.vocab.get(s + self.end, -1) for s in self.symbols])
        rules = sorted((self.vocab[a] << 32 | self.vocab[b], i, self.vocab[a + b]) for (a, b), i in self.ranks.items())
        self.pairs, self.order, self.merged = np.array(rules, np.int64).reshape(-1, 3).T.copy()

    def chunks(self, text: str) -> list[str]:
        """Normalised stretches between white space; a special token is one with a blank before it."""
        if self.special is None or "<" not in text:
            return self._plain(text)
        out: list[str] = []
        for part in self.special.split(text):
            out += [" " + part] if part in self.specials else self._plain(part)
        return out

    _separators = re.compile("[\x1c-\x1f]")
    _spaces = regex.compile(r"[^\s]+")

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # each character by itself, without the final form of sigma
                text = text.replace("Σ", "σ")
        text = text.lower()
        # str.split also cuts at the four information separators, which are no white space here
        return self._spaces.findall(text) if self._separators.search(text) else text.split()

    def words(self, chunk: str) -> list[str]:
        """The words of one chunk, by the Unicode tables of the ``regex`` module."""
        return [chunk] if chunk.isascii() and chunk.isalpha() else self.pieces.findall(chunk)

    def merge(self, word: str) -> tuple[int, ...]:
        """Ids of one word: the lowest-ranked pair merges first, from the left."""
        parts = [self.symbols[b] for b in word.encode("utf-8", "surrogatepass")]
        parts[-1] += self.end
        if len(parts) > 48:
            return self._merge_long(parts)
        none, get = len(self.ranks), self.ranks.get
        order = [get(pair, none) for pair in zip(parts, parts[1:])]
        while order:
            best = min(order)
            if best == none:
                break
            at = order.index(best)
            parts[at: at + 2] = [parts[at] + parts[at + 1]]
            del order[at]
            if at < len(order):
                order[at] = get((parts[at], parts[at + 1]), none)
            if at:
                order[at - 1] = get((parts[at - 1], parts[at]), none)
        return tuple([self.vocab[p] for p in parts if p in self.vocab])

    def _rules(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, the number of merges where there is no merge."""
        key = left << 32 | right
        spot = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[spot] == key, self.order[spot], len(self.pairs))

    def merge_many(self, words: list[str]) -> list[bytes]:
        """Packed ids of many words: words of one length merge their best pairs side by side."""
        out: list[bytes] = [b""] * len(words)
        by_length: dict[int, list[int]] = {}
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        complete = len(self.pairs) and self.inner.min() >= 0 and self.outer.min() >= 0
        for i, data in enumerate(raw):
            if complete and len(data) <= 48:
                by_length.setdefault(len(data), []).append(i)
            else:
                out[i] = np.array(self.merge(words[i]), "<u4").tobytes()
        by_rank = np.argsort(self.order)
        for width, members in by_length.items():
            rows = np.array(members)
            codes = np.frombuffer(b"".join([raw[i] for i in members]), np.uint8).reshape(-1, width)
            ids = self.inner[codes]
            ids[:, -1] = self.outer[codes[:, -1]]
            ranks = self._rules(ids[:, :-1], ids[:, 1:])
            while len(rows):
                size = ids.shape[1]
                best = ranks.argmin(axis=1) if size > 1 else np.zeros(len(rows), np.int64)
                least = ranks[np.arange(len(rows)), best] if size > 1 else np.full(len(rows), len(self.pairs))
                done = least == len(self.pairs)
                if done.any():
                    packed = ids[done].astype("<u4").tobytes()
                    for k, i in enumerate(rows[done].tolist()):
                        out[i] = packed[4 * size * k: 4 * size * (k + 1)]
                    rows, ids, ranks, best, least = (x[~done] for x in (rows, ids, ranks, best, least))
                if not len(rows):
                    break
                every = np.arange(len(rows))
                ids[every, best] = self.merged[by_rank[least]]
                stay = np.arange(size)[None, :] != best[:, None] + 1
                ids = ids[stay].reshape(len(rows), size - 1)
                ranks = ranks[np.arange(size - 1)[None, :] != best[:, None]].reshape(len(rows), size - 2)
                if size > 2:
                    for at in (best - 1, best):  # the pairs on both sides of what was merged
                        good = (at >= 0) & (at < size - 2)
                        r, c = every[good], at[good]
                        ranks[r, c] = self._rules(ids[r, c], ids[r, c + 1])
        return out

    def _merge_long(self, parts: list[str | None]) -> tuple[int, ...]:
        """The same with a heap and links, for words of any length."""
        ranks, n = self.ranks, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(ranks[p], i, p) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if parts[i] != pair[0] or j >= n or parts[j] != pair[1]:
                continue
            parts[i], parts[j] = pair[0] + pair[1], None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (p := (parts[left], parts[right])) in ranks:
                    heapq.heappush(heap, (ranks[p], left, p))
        return tuple(self.vocab[p] for p in parts if p is not None and p in self.vocab)


def _counter(definition) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, held = WordBpe(definition.value), Counter()

        def counted() -> pa.RecordBatch:
            words = Counter({c: n for c, n in held.items() if c.isascii() and c.isalpha()})
            for chunk, n in held.items():
                if not (chunk.isascii() and chunk.isalpha()) and chunk[0] != " ":
                    for word in bpe.words(chunk):
                        words[word] += n
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(words.keys(), pa.string()),
                                               pa.array(words.values(), pa.int64())], ["word", "n"])
        for batch in batches:
            for text in batch.column(0):
                held.update(bpe.chunks(text.as_py() or ""))
                if len(held) >= COUNT_ENTRIES:
                    yield counted()
        if held:
            yield counted()
    return count


def word_counts(docs: DataFrame, definition, text: str = "text") -> DataFrame:
    """word, n over all texts, summed before and after the shuffle."""
    return (docs.select(text).mapInArrow(_counter(definition), "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")))


def text_of_ids(ids: bytes, tokens: dict[int, str]) -> str:
    """Tokens of packed ids, joined by blanks; ids of no token are left out."""
    numbers = np.frombuffer(ids, "<u4").tolist()
    try:
        return " ".join(map(tokens.__getitem__, numbers))
    except KeyError:
        return " ".join([tokens[i] for i in numbers if i in tokens])


def put_file(spark: SparkSession, data: bytes) -> str:
    """Write ``data`` to the shared folder and have Spark copy it to each executor; its name there."""
    name = f"lexicon-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark)}/terrier/{name}")
    stream = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place)
    stream.write(data)
    stream.close()
    spark.sparkContext.addFile(place.toString() if place.toUri().getScheme() else f"file://{place.toString()}")
    return name


class Codec:
    """Encodes and decodes columns with one vocabulary file and one corpus's lexicon."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            self._definition = spark.sparkContext.broadcast(file.read())  # the vocabulary: a few MB
        self._spark, self._lexicon = spark, None

    def fit_lexicon(self, docs: DataFrame, text: str = "text", rate: float = LEXICON_RATE) -> Codec:
        """Compile the words that make up ``rate`` or more of all words of ``docs``."""
        counts = staged(word_counts(docs, self._definition, text))
        total = counts.agg(F.sum("n")).first()[0] or 0
        frequent = counts.filter(F.col("n") >= F.lit(rate * total)).select("word")
        bpe = WordBpe(self._definition.value)
        words = sorted(r.word for r in frequent.toLocalIterator())  # at most 1 / rate words
        self._lexicon = put_file(self._spark, compile_words((w, bpe.merge(w)) for w in words))
        return self

    def encode(self, docs: DataFrame, text: str = "text", drop: tuple[str, ...] = (),
               decoded: str | None = None) -> DataFrame:
        """``docs`` without ``drop``, and with ``n_tokens`` and ``ids``.

        ``ids`` is binary: ids as little-endian unsigned 32-bit integers. Null and
        empty texts have none. With ``decoded``, a column of that name has what the ids
        decode to, as ``decode`` gives it. Repeated rows each give a row. Columns of
        these names that are there already are replaced. Texts are encoded whole.
        """
        more = ["n_tokens", "ids"] + [decoded] * bool(decoded)
        kept = [c for c in docs.columns if c not in (*drop, *more)]
        source = docs.select(*kept, F.col(text).alias("__text"))
        schema = source.drop("__text").withColumns({c: v for c, v in zip(
            more, (F.lit(0).cast("long"), F.lit(b""), F.lit("")))}).schema
        definition, lexicon = self._definition, self._lexicon

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bpe = WordBpe(definition.value)
            known = Lexicon(SparkFiles.get(lexicon)) if lexicon else None
            preset = {" " + t: np.uint32(i).tobytes() for t, i in bpe.specials.items()}
            memo = dict(preset)  # of chunks, and of words, which are chunks of their own

            def learn(chunks: set[str]) -> None:
                mixed = {c: bpe.words(c) for c in chunks if not (c.isascii() and c.isalpha())}
                new = list(set(chain.from_iterable(mixed.values())).union(chunks.difference(mixed)).difference(memo))
                memo.update(zip(new, known.find(new) if known else [None] * len(new)))
                unseen = [w for w in new if memo[w] is None]
                memo.update(zip(unseen, bpe.merge_many(unseen)))
                for chunk, words in mixed.items():
                    memo[chunk] = b"".join([memo[w] for w in words])

            for batch in batches:
                for rows, texts in slices(batch):
                    if len(memo) > MEMO_ENTRIES:
                        memo = dict(preset)
                    cut = [bpe.chunks(t) for t in texts]
                    learn(set().union(*cut).difference(memo))
                    out = [b"".join(map(memo.__getitem__, c)) for c in cut]
                    columns = [pa.array([len(x) // 4 for x in out], pa.int64()), pa.array(out, pa.binary())]
                    if decoded:
                        columns.append(pa.array([text_of_ids(x, bpe.tokens) for x in out], pa.string()))
                    yield pa.RecordBatch.from_arrays(rows.columns[:-1] + columns, rows.schema.names[:-1] + more)
        return source.mapInArrow(encode, schema)

    def decode(self, encoded: DataFrame, ids: str = "ids", into: str = "decoded",
               drop: tuple[str, ...] = ()) -> DataFrame:
        """``encoded`` without ``drop`` and with the text ``into`` of its ids.

        The vocabulary names no decoder, so tokens are joined by blanks, word ends
        and special tokens shown. Null ids give empty text; ids of no token are left out.
        """
        kept = [c for c in encoded.columns if c not in (*drop, into, "__ids")]
        source = encoded.select(*kept, F.col(ids).alias("__ids"))
        schema = source.drop("__ids").withColumn(into, F.lit("")).schema
        definition = self._definition

        def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tokens = WordBpe(definition.value).tokens
            for batch in batches:
                out = [text_of_ids(v.as_py() or b"", tokens) for v in batch.column(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays(batch.columns[:-1] + [pa.array(out, pa.string())],
                                                 batch.schema.names[:-1] + [into])
        return source.mapInArrow(decode, schema)
