"""Interpolated modified Kneser-Ney bigram model: counted in Spark, stored as sorted hash arrays, memory-mapped by workers.

Tokens are a text's words and one end. Counting is map-side first: a partition
turns its tokens into sorted distinct keys with counts and sends one compressed
run per key range; a range's runs are merged in one task and written as arrays.

1. Words: ranges of the 64-bit word hash. A word's id is its place in the
   sorted hashes, so ids need no dictionary and order no collisions.
2. Bigrams: keys id(w1) << 32 | id(w2), dealt by a hash of the context; contexts
   with a large part of all tokens are dealt by the whole key, so no frequent
   word lands in one task. Each range also sends on what it knows of its
   contexts (tokens, and followers seen once, twice, more often) and its
   words (distinct predecessors).
3. Those are summed by word range and written beside the word hashes.

The numbers of ranges and of bigram parts follow the bytes and tokens counted, so
what a task merges stays as large as it is. Word ids are 32 bits wide: a corpus of
over four billion distinct words is refused.

The driver sees per range a few totals only. Discounts follow Chen and Goodman
from the counts of counts; the lower order uses continuation counts and is
interpolated with 1 / (V + 1), so unknown words have a probability. Scoring maps
the arrays and looks up the distinct words and bigrams of a batch in sorted
order. The files lie in the shared folder, which for memory-mapping must be a
mounted one (no scheme, or file:); they are written under another name and
renamed, so tasks that run twice do no harm.

Null and empty texts consist of the end alone. An empty training set gives the
uniform model over the unknown word. Rows are scored one by one, repeated or
not; other columns are ignored. A null doc_id is never held out.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, shared_dir
from .hashing import in_blocks, mix, word_hashes

END_HASH = np.uint64(0x9AE16A3B2F90404F)
FLUSH = 3_000_000
#: A context with more than this share of a range's mean load is dealt by the whole key.
HOT_SHARE = 0.25
#: What one task merges, at most about: the words of so many bytes of text, the bigrams of so many tokens.
RANGE_BYTES, SEGMENT_TOKENS = 64 << 20, 2_000_000
#: A word's statistics: its count, of the bigrams it begins the tokens and the kinds seen once, twice, more often, and its predecessors.
STATS = ("count", "tokens", "once", "twice", "more", "before")
#: Arrays that a worker keeps mapped.
MAPPED = 1024


def held_out(key: Column, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == fold, F.lit(False))


def tokens(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, token hashes with ends, tokens of each text) by blocks."""
    for first, _, block in in_blocks(texts):
        words, counts = word_hashes(block)
        ends = np.cumsum(counts + 1) - 1
        out = np.empty(len(words) + len(block), np.uint64)
        is_word = np.ones(len(out), bool)
        is_word[ends] = False
        out[is_word], out[ends] = words, END_HASH
        yield first, out, counts + 1


def _packed(keys: np.ndarray, *values: np.ndarray) -> bytes:
    """Sorted keys as differences, bytes of equal weight together; values after them."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    parts = [np.array([len(keys)], np.uint64).tobytes(), gaps.view(np.uint8).reshape(-1, 8).T.tobytes()]
    parts += [v.astype(np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes() for v in values]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpacked(blob: bytes, columns: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n = int(raw[:8].view(np.uint64)[0])
    out = [np.ascontiguousarray(raw[8 + 8 * n * c : 8 + 8 * n * (c + 1)].reshape(8, n).T).view(np.uint64).ravel() for c in range(columns)]
    out[0] = np.cumsum(out[0])
    return out


def _summed(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    if not len(keys):
        return [keys, *values]
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return [keys[first], *(np.add.reduceat(v[order], first) for v in values)]


def _merged(blobs: list[bytes], columns: int) -> list[np.ndarray]:
    parts = [_unpacked(b, columns) for b in blobs]
    if not parts:
        return [np.zeros(0, np.uint64)] * columns
    return _summed(*(np.concatenate([p[c] for p in parts]) for c in range(columns)))


class _Counter:
    """Distinct keys with summed counts, bounded: flush() when full."""

    def __init__(self) -> None:
        self.runs: list[list[np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> None:
        k, n = np.unique(keys, return_counts=True)
        self.runs.append([k, n.astype(np.uint64)])
        self.size += len(k)

    def full(self) -> bool:
        if self.size > FLUSH:
            self.runs = [self.take()]
            self.size = len(self.runs[0][0])
        return self.size > FLUSH // 2

    def take(self) -> list[np.ndarray]:
        runs, self.runs, self.size = self.runs, [], 0
        return _summed(*(np.concatenate([r[c] for r in runs]) for c in (0, 1))) if runs else [np.zeros(0, np.uint64)] * 2


def _save(folder: str, name: str, array: np.ndarray) -> None:
    path = os.path.join(folder, name)
    with open(part := f"{path}.{uuid.uuid4().hex}", "wb") as f:
        np.save(f, array)
    os.replace(part, path)


@dataclass
class Model:
    """Where the arrays are, and the totals that go with them."""

    folder: str
    ranges: int  # a power of two; of word hashes
    segments: int
    base: np.ndarray  # first id of each range, and the number of words
    tokens: int
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    discounts: np.ndarray = field(default_factory=lambda: np.zeros(4))  # of bigrams seen 0, 1, 2, 3+ times
    low_discounts: np.ndarray = field(default_factory=lambda: np.zeros(4))
    low_total: float = 0.0
    low_gamma: float = 1.0
    files: dict = field(default_factory=dict, repr=False, compare=False)

    def __getstate__(self):
        return {**self.__dict__, "files": {}}

    @property
    def words(self) -> int:
        return int(self.base[-1])

    def array(self, name: str) -> np.ndarray:
        found = self.files.pop(name, None)
        if found is None:
            if len(self.files) >= MAPPED:
                self.files.pop(next(iter(self.files)))  # the one not used for longest
            found = np.load(os.path.join(self.folder, name), mmap_mode="r")
        self.files[name] = found
        return found

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of sorted distinct hashes; words (their number) where unknown."""
        out = np.full(len(hashes), np.uint64(self.words))
        if not len(hashes):
            return out
        parts = hashes >> np.uint64(64 - self.ranges.bit_length() + 1) if self.ranges > 1 else np.zeros(len(hashes), np.uint64)
        some, starts = np.unique(parts, return_index=True)
        for r, a, z in zip(some.astype(int), starts, [*starts[1:], len(hashes)]):
            if self.base[r + 1] > self.base[r]:
                known = self.array(f"words-{r}.npy")
                at = np.minimum(np.searchsorted(known, hashes[a:z]), len(known) - 1)
                hit = known[at] == hashes[a:z]
                out[a:z][hit] = at[hit].astype(np.uint64) + np.uint64(self.base[r])
        return out

    def by_id(self, ids: np.ndarray) -> np.ndarray:
        """A row of every statistic in STATS for sorted ids; 0 for unknown words and the start."""
        out = np.zeros((len(STATS), len(ids)), np.int64)
        edges = np.searchsorted(ids, self.base.astype(np.uint64))
        for r in np.flatnonzero(np.diff(edges)):
            a, z = edges[r], edges[r + 1]
            out[:, a:z] = self.array(f"stats-{r}.npy")[:, (ids[a:z] - np.uint64(self.base[r])).astype(np.int64)]
        return out

    def segment(self, keys: np.ndarray) -> np.ndarray:
        context = keys >> np.uint64(32)
        hot = self.hot[np.minimum(np.searchsorted(self.hot, context), len(self.hot) - 1)] == context if len(self.hot) else np.zeros(len(keys), bool)
        return mix(np.where(hot, keys, context), 3) % np.uint64(self.segments)

    def bigram_counts(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted distinct keys."""
        out, segment = np.zeros(len(keys), np.int64), self.segment(keys)
        order = np.argsort(segment, kind="stable")
        some, starts = np.unique(segment[order], return_index=True)
        for s, a, z in zip(some, starts, [*starts[1:], len(order)]):
            at, known = order[a:z], self.array(f"bigrams-{s}.npy")
            if len(known):
                i = np.minimum(np.searchsorted(known, keys[at]), len(known) - 1)
                hit = known[i] == keys[at]
                out[at[hit]] = self.array(f"counts-{s}.npy")[i[hit]]
        return out

    def low_probability(self, continuations: np.ndarray) -> np.ndarray:
        uniform = 1.0 / (self.words + 1)
        if not self.low_total:
            return np.full(len(continuations), uniform)
        c = continuations.astype(float)
        return np.maximum(c - self.low_discounts[np.minimum(continuations, 3).astype(int)], 0) / self.low_total + self.low_gamma * uniform


def discounts(n: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2, 3+ from n[1..4], the counts of counts; kept inside (0, count)."""
    out = np.array([0.0, 0.5, 0.75, 1.0])
    if n[1] and n[2]:
        y = n[1] / (n[1] + 2 * n[2])
        for c in (1, 2, 3):
            if n[c]:
                out[c] = c - (c + 1) * y * n[c + 1] / n[c]
    return np.clip(out, [0, 0.05, 0.05, 0.05], [0, 0.95, 1.95, 2.95])


def _local(folder: str) -> str:
    at = urlparse(folder)
    if at.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped models need a mounted spark.checkpoint.dir, not {at.scheme}:")
    return at.path


def _counts_of_counts(n: np.ndarray) -> list[int]:
    return [int(x) for x in np.bincount(np.minimum(n, 5).astype(np.int64), minlength=6)[1:5]]


def train(texts: DataFrame, ranges: int | None = None) -> Model:
    """The model of the texts in texts(text)."""
    spark = texts.sparkSession
    prepare(spark)
    # as many tasks as the session asks for, as long as a task gets between a quarter of its most and all of it
    wanted = tasks = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    wanted = max(min(wanted, 1 + 4 * size // RANGE_BYTES), -(-size // RANGE_BYTES))
    ranges = 1 << max(0, (wanted - 1).bit_length())
    folder = _local(shared_dir(spark))
    os.makedirs(folder, exist_ok=True)
    shift = np.uint64(64 - ranges.bit_length() + 1)
    schema = "part int, blob binary"

    def runs(parts: np.ndarray, keys: np.ndarray, *values: np.ndarray) -> pa.RecordBatch:
        """Keys with values, one packed run per part; keys are sorted inside a part."""
        order = np.argsort(parts, kind="stable")
        names, starts = np.unique(parts[order], return_index=True)
        edges = [*starts, len(keys)]
        blobs = [_packed(keys[o], *(v[o] for v in values)) for o in (order[a:z] for a, z in zip(edges, edges[1:]))]
        return pa.record_batch([pa.array(names.astype(np.int32)), pa.array(blobs, pa.binary())], ["part", "blob"])

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Counter()
        for batch in batches:
            for _, t, _ in tokens(batch.column(0).to_pylist()):
                seen.add(t)
            if seen.full():
                k, n = seen.take()
                yield runs(k >> shift if ranges > 1 else np.zeros(len(k), np.uint64), k, n)
        k, n = seen.take()
        yield runs(k >> shift if ranges > 1 else np.zeros(len(k), np.uint64), k, n)

    def write_words(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        k, n = _merged(table["blob"].to_pylist(), 2)
        _save(folder, f"words-{part}.npy", k)
        _save(folder, f"unigrams-{part}.npy", n.astype(np.int64))
        return pa.table({"part": pa.array([part], pa.int32()), "n": [len(k)], "total": [int(n.sum())], "most": [k[np.argsort(n)[::-1][:16]].view(np.int64)], "counts": [np.sort(n)[::-1][:16].astype(np.int64)]})

    got = texts.select("text").mapInArrow(count_words, schema).groupBy("part").applyInArrow(write_words, "part int, n long, total long, most array<long>, counts array<long>").collect()
    sizes, total = np.zeros(ranges, np.int64), sum(r.total for r in got)
    for r in got:
        sizes[r.part] = r.n
    segments = max(1, min(tasks, 1 + 4 * total // SEGMENT_TOKENS), -(-total // SEGMENT_TOKENS))
    model = Model(folder, ranges, segments, np.concatenate([[0], np.cumsum(sizes)]), total)
    if model.words >= 2**32 - 1:
        raise ValueError("more distinct words than 32-bit ids")
    # frequent words are few: at most segments / HOT_SHARE pass this bound
    often = np.array(sorted(np.array([h for r in got for h, c in zip(r.most, r.counts) if c * segments > HOT_SHARE * total], np.int64).view(np.uint64)), np.uint64)
    start = np.uint64(model.words)  # the id of the start, and of unknown words in scoring
    model.hot = np.unique(np.append(model.ids(often), start))

    def count_bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Counter()
        for batch in batches:
            for _, t, n in tokens(batch.column(0).to_pylist()):
                seen.add(bigrams(model, t, n)[0])
            if seen.full():
                k, n = seen.take()
                yield runs(model.segment(k), k, n)
        k, n = seen.take()
        yield runs(model.segment(k), k, n)

    def write_bigrams(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        k, n = _merged(table["blob"].to_pylist(), 2)
        _save(folder, f"bigrams-{part}.npy", k)
        _save(folder, f"counts-{part}.npy", n.astype(np.uint8 if n.max(initial=0) < 256 else np.uint32 if n.max() < 2**32 else np.int64))
        context, word = k >> np.uint64(32), k & np.uint64(0xFFFFFFFF)
        one = np.ones(len(k), np.uint64)
        sent = []
        # per context: tokens, followers seen once, twice, more often; per word: predecessors
        c = _summed(context, n, one * (n == 1), one * (n == 2), one * (n > 2), one * 0)
        w = _summed(word, one)
        z = np.zeros(len(w[0]), np.uint64)
        ids, *values = _summed(np.concatenate([c[0], w[0]]), *(np.concatenate([a, b]) for a, b in zip(c[1:], (z, z, z, z, w[1]))))
        edges = np.searchsorted(ids, np.append(model.base[:-1], 2**33).astype(np.uint64))
        for r in range(ranges):
            a, e = edges[r], edges[r + 1]
            if a < e:
                sent.append((r, _packed(ids[a:e], *(v[a:e] for v in values))))
        sums = _counts_of_counts(n)
        return pa.table({"part": pa.array([-1, *(r for r, _ in sent)], pa.int32()), "blob": pa.array([np.array(sums, np.int64).tobytes(), *(b for _, b in sent)], pa.binary())})

    def write_contexts(table: pa.Table) -> pa.Table:
        part, blobs = table["part"][0].as_py(), table["blob"].to_pylist()
        if part < 0:  # the counts of counts of the segments
            sums = np.sum([np.frombuffer(b, np.int64) for b in blobs], axis=0)
            return pa.table({"part": pa.array([part], pa.int32()), "sums": [sums], "total": [0]})
        ids, tot, n1, n2, n3, cont = _merged(blobs, 6)
        # the last range also holds the start, after its words
        size = int(sizes[part]) + (part == ranges - 1)
        at = (ids - np.uint64(model.base[part])).astype(np.int64)
        stats = np.zeros((len(STATS), size), np.int64)
        counted = np.load(os.path.join(folder, f"unigrams-{part}.npy")) if sizes[part] else np.zeros(0, np.int64)
        stats[0, : len(counted)] = counted
        for row, v in enumerate((tot, n1, n2, n3, cont), 1):
            stats[row, at] = v
        _save(folder, f"stats-{part}.npy", stats if stats.max(initial=0) >= 2**32 else stats.astype(np.uint32))
        return pa.table({"part": pa.array([part], pa.int32()), "sums": [_counts_of_counts(cont[cont > 0])], "total": [int(cont.sum())]})

    pairs = texts.select("text").mapInArrow(count_bigrams, schema).groupBy("part").applyInArrow(write_bigrams, schema)
    got = pairs.groupBy("part").applyInArrow(write_contexts, "part int, sums array<long>, total long").collect()
    high, low = np.zeros(5), np.zeros(5)
    for r in got:
        if r.part < 0:
            high[1:] += r.sums
        else:
            low[1:] += r.sums
            model.low_total += r.total
    model.discounts, model.low_discounts = discounts(high), discounts(low)
    if model.low_total:
        d, n = model.low_discounts, low
        words_cont = model.words  # every word has a predecessor, the start included
        model.low_gamma = float(d[1] * n[1] + d[2] * n[2] + d[3] * (words_cont - n[1] - n[2])) / model.low_total
    for r in range(ranges):  # ranges of which nothing was sent
        if not os.path.exists(os.path.join(folder, f"stats-{r}.npy")):
            _save(folder, f"stats-{r}.npy", np.zeros((len(STATS), int(sizes[r]) + (r == ranges - 1)), np.uint32))
    for s in range(segments):
        if not os.path.exists(os.path.join(folder, f"bigrams-{s}.npy")):
            _save(folder, f"bigrams-{s}.npy", np.zeros(0, np.uint64))
    return model


def bigrams(model: Model, t: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bigram keys of a block's tokens, distinct word ids, each token's place among them, word ids of tokens)."""
    distinct, at = np.unique(t, return_inverse=True)
    known = model.ids(distinct)
    ids = known[at]
    context = np.concatenate([[np.uint64(model.words)], ids[:-1]])
    starts = np.cumsum(n) - n
    context[starts] = np.uint64(model.words)
    return context << np.uint64(32) | ids, known, at, ids


def score_tokens(model: Model, t: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text of a block: tokens known, base score, model score."""
    keys, _, _, ids = bigrams(model, t, n)
    words, at_word = np.unique(ids, return_inverse=True)
    unigram, *_, before = model.by_id(words)  # unknown words and the start are no words here
    unigram, before = np.where(words < model.words, unigram, 0), np.where(words < model.words, before, 0)
    starts = np.cumsum(n) - n
    base = np.log10((unigram + 0.5) / (model.tokens + 0.5 * (model.words + 1)))
    # an unknown word as context is not the start: it has no followers
    unknown_context = np.concatenate([[False], ids[:-1] >= model.words])
    unknown_context[starts] = False
    pairs, at = np.unique(keys, return_inverse=True)
    context, word = pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)
    contexts, at_context = np.unique(context, return_inverse=True)
    of_context = model.by_id(contexts)
    if model.words:  # the start stands behind the last range's words
        of_context[:, contexts == model.words] = model.array(f"stats-{model.ranges - 1}.npy")[:, -1:]
    else:
        of_context[:, contexts == model.words] = 0
    tokens_, once, twice, more = of_context[1:5, at_context].astype(float)
    low = model.low_probability(before)[np.searchsorted(words, word)]
    c = model.bigram_counts(pairs)
    d = model.discounts
    total = np.maximum(tokens_, 1)
    gamma = (d[1] * once + d[2] * twice + d[3] * more) / total
    p = np.where(tokens_ > 0, np.maximum(c - d[np.minimum(c, 3)], 0) / total + gamma * low, low)
    logs = np.log10(p)[at]
    if unknown_context.any():
        logs[unknown_context] = np.log10(low)[at[unknown_context]]
    add = lambda x: np.add.reduceat(x, starts)  # noqa: E731  every text has a token
    return add((unigram > 0)[at_word].astype(np.int64)), add(base[at_word]), add(logs)


def score_documents(docs: DataFrame, folds: int = 5, fold: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of every row."""
    prepare(docs.sparkSession)
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id"), folds, fold).alias("held_out"))
    model = train(rows.where(~F.col("held_out")).select("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, t, n in tokens(batch.column(1).to_pylist()):
                known, base, score = score_tokens(model, t, n)
                b = batch.slice(first, len(n))
                yield pa.record_batch([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(n), model.tokens, np.int64)), pa.array(base), pa.array(score), pa.array(10 ** (-score / n))], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    return rows.mapInArrow(run, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
