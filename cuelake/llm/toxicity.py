"""Toxicity by a small convolutional text classifier in numpy, trained by Spark on all labelled texts.

A word's embedding is the sum of hashed embeddings of the word and of its first four and six bytes (A-Z in lower
case), so words never seen still share their beginnings with known ones; buckets that fewer than ``LEAST_TEXTS`` labelled texts have
stay zero, so chance words carry nothing. Filters of widths one, two and three run over
the whole text; the greatest response of each filter goes to a logistic unit. Only the words that win the pooling carry
gradients. ``FOLDS`` such networks are trained, each without a fifth of the labelled texts of its own, and the surer of them counts. Thresholds come from those
fifths, scored by the network that did not see them: by the language guessed from
function words in the text, the raw probability at which toxic and other texts part best is moved to ``CUT``. A language's own
threshold is drawn towards that of all languages, the more so the fewer toxic texts it has there.

Every labelled text is learnt from, whole. Texts are dealt by a hash of the id to shards of about ``SHARD_BYTES`` of text. In each of
``EPOCHS`` rounds a task takes a shard through a network, ``CHUNK_WORDS`` words at a time (one text, if that is longer), and Spark averages what the shards make of the
parameters, a row of the embeddings over the shards that changed it. Texts that fit one chunk are learnt in one round, as nothing
is to be averaged. The driver holds the parameters alone (13 MB a network whatever the input), the threshold's histogram and two counts a shard.

Defined results: null, empty and wordless texts get the score of a text without any response; without labels of both kinds
every score is 0; rows that share a doc_id are scored each for itself, and the least of their texts is learnt from; an empty table gives no rows; a row without
an id is not held out. Only doc_id and text, and doc_id and toxic of the labels, are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks, labelled
from .common import cut, table

BUCKETS = 1 << 16
LEAST_TEXTS = 2
FOLDS, FIFTHS = 2, 5
DIM, FILTERS, WIDTHS = 16, 8, (1, 2, 3)
#: At least so many steps are made on small samples, at least so many epochs on large ones.
STEPS, EPOCHS, BATCH, RATE = 300, 8, 32, 0.08
CUT = 0.7
#: Bytes of text of a shard, words that a task holds at once and words whose responses it holds at once.
SHARD_BYTES, CHUNK_WORDS, AT_ONCE = 192 << 20, 4_000_000, 1 << 15
#: Parts in which a network's embeddings travel, and bins of raw probabilities for the thresholds.
PARTS, BINS = 16, 1 << 14
#: Bytes of text scored at once.
BLOCK = 1 << 19
#: Toxic texts of a language at which its own threshold weighs as much as that of all languages.
LANGUAGE_LEAST = 12
#: Function words by language.
FUNCTION_WORDS = {
    "en": "the of and to in is that for was with on as it by from this be are".split(),
    "de": "der die und das von zu den mit ist im nicht ein eine auf für dem des".split(),
    "es": "el la los las de que y en por con una un del se para como".split(),
    "fr": "le la les de des et est que pour dans un une du au qui sur par avec".split(),
}
LANGUAGES = tuple(FUNCTION_WORDS)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _features(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(three bucket numbers of each word, bounds of texts in words, language of each text: its number or -1)."""
    low = _LOWER[data]
    start, end, bound = blocks.find_words(offsets, low)
    n_docs = len(offsets) - 1
    if not len(start):
        return np.zeros((0, 3), dtype=np.int32), bound, np.full(n_docs, -1)
    prefix = blocks.prefixes(blocks.byte_codes()[low])
    ids = np.empty((len(start), 3), dtype=np.int32)
    whole = blocks.mix64(blocks.slide(prefix, start, end))
    for k, h in enumerate((whole, *(blocks.mix64(blocks.slide(prefix, start, np.minimum(end, start + w)) + np.uint64(w)) for w in (4, 6)))):
        ids[:, k] = (h % np.uint64(BUCKETS)).astype(np.int32) + k * BUCKETS
    which = np.repeat(np.arange(n_docs), np.diff(bound))
    hits = np.zeros((len(LANGUAGES), n_docs))
    for k, hashes in enumerate(_function_hashes()):
        at = np.minimum(np.searchsorted(hashes, whole), len(hashes) - 1)
        hits[k] = np.bincount(which[hashes[at] == whole], minlength=n_docs)
    language = np.where(hits.max(axis=0) > 0, hits.argmax(axis=0), -1)
    return ids, bound, language


_HASHES: list[np.ndarray] = []


def _function_hashes() -> list[np.ndarray]:
    if not _HASHES:
        for words in FUNCTION_WORDS.values():
            raw = [w.encode() for w in words]
            data = np.frombuffer(b"".join(raw), dtype=np.uint8)
            end = np.cumsum([len(w) for w in raw])
            start = end - np.array([len(w) for w in raw])
            prefix = blocks.prefixes(blocks.byte_codes()[data])
            _HASHES.append(np.sort(blocks.mix64(blocks.slide(prefix, start, end))))
    return _HASHES


@dataclass
class Network:
    table: np.ndarray  # (3 * BUCKETS, DIM)
    kernel: np.ndarray  # (DIM, taps * FILTERS): for each width, its taps in turn
    bias: np.ndarray  # (pooled,)
    out: np.ndarray  # (pooled,)
    shift: float

    def responses(self, x: np.ndarray) -> np.ndarray:
        """(positions, filters) of embedded words, each text followed by two zero rows."""
        y = x @ self.kernel
        parts, at = [], 0
        for w in WIDTHS:
            r = y[:, at : at + FILTERS].copy()
            for j in range(1, w):
                r[:-j] += y[j:, at + j * FILTERS : at + (j + 1) * FILTERS]
            parts.append(r)
            at += w * FILTERS
        return np.concatenate(parts, axis=1)

    def embed(self, ids: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(embedded words with two zero rows after each text, rows of the words, first row of each text)."""
        n = np.diff(bound)
        first = bound[:-1] - bound[0] + 2 * np.arange(len(n))
        rows = blocks.ragged(first, n)
        x = np.zeros((int(n.sum()) + 2 * len(n), DIM), dtype=np.float32)
        x[rows] = self.table[ids[:, 0]] + self.table[ids[:, 1]] + self.table[ids[:, 2]]
        return x, rows, first

    def raw(self, ids: np.ndarray, bound: np.ndarray) -> np.ndarray:
        x, rows, first = self.embed(ids, bound)
        r = self.responses(x)
        pads = np.ones(len(x), dtype=bool)
        pads[rows] = False
        r[pads] = -1e9
        pooled = np.maximum(np.maximum.reduceat(r, first, axis=0) + self.bias, 0) if len(first) else np.zeros((0, len(self.bias)))
        return 1 / (1 + np.exp(-np.clip(pooled @ self.out + self.shift, -30, 30)))


@dataclass
class Model:
    networks: list[Network]
    cuts: dict[int, float]  # by language, -1 for all others

    def raw(self, ids: np.ndarray, bound: np.ndarray) -> np.ndarray:
        return np.max([n.raw(ids, bound) for n in self.networks], axis=0)

    def score(self, raw: np.ndarray, language: np.ndarray) -> np.ndarray:
        """Raw probabilities, stretched so that the language's threshold lies at CUT."""
        cut = np.array([self.cuts.get(k, self.cuts[-1]) for k in range(-1, len(LANGUAGES))])[language + 1]
        return np.where(raw >= cut, CUT + (1 - CUT) * (raw - cut) / np.maximum(1 - cut, 1e-9), CUT * raw / np.maximum(cut, 1e-9)).clip(0, 1)


def _taps() -> list[tuple[int, int, int]]:
    """(first filter, first kernel column, width) by width."""
    out, col = [], 0
    for k, w in enumerate(WIDTHS):
        out.append((k * FILTERS, col, w))
        col += w * FILTERS
    return out


_SHIFT = np.arange(3, dtype=np.int32) * BUCKETS
_POOLED = FILTERS * len(WIDTHS)


@dataclass
class State:
    """A network in training: which embeddings may move, and sums of squared gradients."""

    network: Network
    live: np.ndarray
    rows: np.ndarray
    rest: np.ndarray

    @classmethod
    def start(cls, live: np.ndarray, seed: int) -> State:
        rng = np.random.default_rng(seed)
        m = Network(
            rng.normal(0, 0.1, (3 * BUCKETS, DIM)).astype(np.float32),
            rng.normal(0, 0.3, (DIM, FILTERS * sum(WIDTHS))).astype(np.float32),
            np.zeros(_POOLED, dtype=np.float32),
            rng.normal(0, 0.3, _POOLED).astype(np.float32),
            float(-1.0),
        )
        m.table[~live] = 0
        return cls(m, live, np.full(m.table.shape, 1e-6, dtype=np.float32), np.full(m.kernel.size + 2 * _POOLED + 1, 1e-6, dtype=np.float32))

    def dense(self) -> np.ndarray:
        """All but the embeddings, with sums."""
        m = self.network
        return np.concatenate([m.kernel.ravel(), m.bias, m.out, [m.shift], self.rest]).astype(np.float32)

    def set_dense(self, flat: np.ndarray) -> None:
        m, n = self.network, self.network.kernel.size
        m.kernel = flat[:n].reshape(m.kernel.shape).copy()
        m.bias, m.out = flat[n : n + _POOLED].copy(), flat[n + _POOLED : n + 2 * _POOLED].copy()
        m.shift, self.rest = float(flat[n + 2 * _POOLED]), flat[n + 2 * _POOLED + 1 :].copy()

    def packed(self, at: np.ndarray) -> bytes:
        """Some rows of the embeddings with their sums."""
        return packed(at, self.network.table[at], self.rows[at])

    def put(self, raw: bytes) -> np.ndarray:
        """Puts packed rows in their places, and says which."""
        at, values, sums = unpacked(raw)
        self.network.table[at], self.rows[at] = values, sums
        return at

    def given(self) -> tuple[list[bytes], np.ndarray]:
        """What a task needs to go on, the embeddings in parts, as packing and unpacking take copies."""
        return [self.packed(at) for at in np.array_split(np.flatnonzero(self.live), PARTS)], self.dense()

    @classmethod
    def taken(cls, parts: list[bytes], flat: np.ndarray) -> State:
        zeros = (np.zeros(s, dtype=np.float32) for s in ((3 * BUCKETS, DIM), (DIM, FILTERS * sum(WIDTHS)), _POOLED, _POOLED))
        state = cls(Network(*zeros, 0.0), np.zeros(3 * BUCKETS, dtype=bool), np.full((3 * BUCKETS, DIM), 1e-6, dtype=np.float32), np.zeros(0))
        for raw in parts:
            state.live[state.put(raw)] = True
        state.set_dense(flat)
        return state


def packed(at: np.ndarray, values: np.ndarray, sums: np.ndarray) -> bytes:
    """Rows, embeddings and sums; the sums as half-precision logarithms, as they only scale steps."""
    return at.astype("<i4").tobytes() + values.astype("<f4").tobytes() + np.log2(sums).astype("<f2").tobytes()


def unpacked(raw: bytes | pa.Buffer) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, embeddings, sums)."""
    n = len(raw) // (4 + 6 * DIM)
    values = np.frombuffer(raw, "<f4", n * DIM, 4 * n).reshape(n, DIM)
    sums = np.exp2(np.frombuffer(raw, "<f2", n * DIM, 4 * n * (1 + DIM)).astype(np.float32)).reshape(n, DIM)
    return np.frombuffer(raw, "<i4", n), values, sums


def winners(m: Network, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(greatest response of each filter, the word where it begins) for texts of bucket numbers (words, 3) without shifts, some words at a time."""
    top = np.full((len(texts), _POOLED), -np.inf, dtype=np.float32)
    place = np.zeros((len(texts), _POOLED), dtype=np.int64)

    def flush(pieces: list[tuple[int, int, int]]) -> None:
        # a piece goes with the words behind it that its last windows reach
        parts = [texts[k][a : b + max(WIDTHS) - 1] for k, a, b in pieces]
        bound = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        x, _, first = m.embed(np.concatenate(parts).astype(np.int32) + _SHIFT, bound)
        r = m.responses(x)
        for (k, a, b), at in zip(pieces, first.tolist(), strict=True):
            own = r[at : at + b - a]
            best = own.argmax(axis=0)
            value = own[best, np.arange(_POOLED)]
            more = value > top[k]
            top[k, more], place[k, more] = value[more], best[more] + a

    pieces, held = [], 0
    for k, ids in enumerate(texts):
        for a in range(0, len(ids), AT_ONCE):
            b = min(a + AT_ONCE, len(ids))
            if pieces and held + b - a > AT_ONCE:
                flush(pieces)
                pieces, held = [], 0
            pieces.append((k, a, b))
            held += b - a
    if pieces:
        flush(pieces)
    return top, place


def _activity(m: Network, top: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(activity of the filters, probability)."""
    act = np.maximum(np.where(n[:, None] > 0, top + m.bias, 0), 0)
    return act, 1 / (1 + np.exp(-np.clip(act @ m.out + m.shift, -30, 30)))


def step(state: State, texts: list[np.ndarray], label: np.ndarray, weight: np.ndarray, touched: np.ndarray) -> None:
    """One step on a few texts; rows of the embeddings that it moves are marked."""
    m = state.network
    n = np.array([len(t) for t in texts])
    first = np.cumsum(n) - n
    ids = np.concatenate(texts)
    top, win = winners(m, texts)
    act, p = _activity(m, top, n)
    d = ((p - label) * weight / len(texts)).astype(np.float32)
    d_out, d_shift = act.T @ d, float(d.sum())
    d_act = d[:, None] * m.out * (act > 0)
    d_kernel = np.zeros_like(m.kernel)
    words, grads = [], []
    for f0, col, w in _taps():
        g, pos = d_act[:, f0 : f0 + FILTERS], win[:, f0 : f0 + FILTERS]
        for j in range(w):
            c = col + j * FILTERS
            live = (pos + j < n[:, None]) & (g != 0)
            if not live.any():
                continue
            q = (first[:, None] + pos + j)[live]
            some = ids[q].astype(np.int32) + _SHIFT
            xi = np.zeros((*g.shape, DIM), dtype=np.float32)
            xi[live] = m.table[some].sum(axis=1)
            d_kernel[:, c : c + FILTERS] = np.einsum("bfd,bf->df", xi, g)
            words.append(some)
            grads.append((g[:, :, None] * m.kernel[:, c : c + FILTERS].T[None])[live])
    if words:
        idx, g = np.concatenate(words).ravel(), np.repeat(np.concatenate(grads), 3, axis=0)
        o = np.argsort(idx, kind="stable")
        u, s = np.unique(idx[o], return_index=True)
        total = np.add.reduceat(g[o], s, axis=0)
        u, total = u[state.live[u]], total[state.live[u]]
        state.rows[u] += total**2
        m.table[u] -= RATE * total / np.sqrt(state.rows[u])
        touched[u] = True
    grad = np.concatenate([d_kernel.ravel(), d_act.sum(axis=0), d_out, [d_shift]]).astype(np.float32)
    state.rest += grad**2
    move = RATE * grad / np.sqrt(state.rest)
    k = m.kernel.size
    m.kernel -= move[:k].reshape(m.kernel.shape)
    m.bias -= move[k : k + _POOLED]
    m.out -= move[k + _POOLED : k + 2 * _POOLED]
    m.shift -= float(move[-1])


def best_cut(low: np.ndarray, high: np.ndarray, clean: np.ndarray, toxic: np.ndarray) -> float:
    """The threshold with the best F1, of those between the bins of a histogram (least and greatest value, texts of either label); the middle of the gap it lies in, at least a half."""
    cuts = np.concatenate([[low[0]], (low[1:] + high[:-1]) / 2, [(high[-1] + 1) / 2]])
    hit, said = (np.concatenate([np.cumsum(x[::-1])[::-1], [0]]) for x in (toxic, clean + toxic))
    f1 = 2 * hit / np.maximum(1, said + toxic.sum())
    gaps = np.concatenate([low, [1.0]]) - np.concatenate([[0.0], high])
    best = np.flatnonzero(f1 == f1.max())
    return float(np.clip(cuts[best[gaps[best].argmax()]], 0.5, 0.98))


def within_budget(label: np.ndarray, n: np.ndarray, place: np.ndarray, most: int) -> np.ndarray:
    """Which texts fit: for each label those that fit, by place, into ``most`` words, at least one. ``fit`` doesn't bound its texts any more."""
    take = np.zeros(len(n), dtype=bool)
    for y in (0, 1):
        spent = 0
        own = np.flatnonzero(label == y)
        for k in own[np.lexsort((place[own], n[own] > most))].tolist():
            if spent == 0 or spent + n[k] <= most:
                take[k] = True
                spent += max(1, int(n[k]))
    return take


def calibrated(seen: np.ndarray) -> dict[int, float]:
    """Thresholds by language from bins (language, bin, least, greatest raw probability, texts of either label) of texts that were not learnt from; -1 for all others."""

    def cut_of(some: np.ndarray) -> float:
        bins, which = np.unique(some[:, 1], return_inverse=True)
        low, high = np.full(len(bins), np.inf), np.full(len(bins), -np.inf)
        np.minimum.at(low, which, some[:, 2])
        np.maximum.at(high, which, some[:, 3])
        return best_cut(low, high, *(np.bincount(which, some[:, k], len(bins)) for k in (4, 5)))

    cuts = {-1: cut_of(seen)}
    for k in range(len(LANGUAGES)):
        own = seen[seen[:, 0] == k]
        toxic = own[:, 5].sum()
        if toxic and own[:, 4].sum():
            cuts[k] = float((toxic * cut_of(own) + LANGUAGE_LEAST * cuts[-1]) / (toxic + LANGUAGE_LEAST))
    return cuts


def shards(docs: DataFrame, labels: DataFrame, learn: Column, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(shard, label, language, n, ids) of every labelled text, dealt and ordered by shard, computed once."""
    known = labelled.known(labels, "toxic", learn)
    n_bytes, n_docs = docs.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    n_shards = max(1, -(-int((n_bytes or 0) * min(1.0, known.count() / max(1, n_docs))) // shard_bytes))

    @blocks.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            fresh = []
            for i in batch.column(2).to_pylist():
                fresh.append(i != last)
                last = i
            batch = batch.filter(pa.array(fresh, pa.bool_()))
            for a, b, offsets, data in blocks.text_blocks(batch.column(4), BLOCK):
                ids, bound, language = _features(offsets, data)
                short = (ids - _SHIFT).astype("<u2")
                payload = [pa.compress(short[x:y].tobytes(), "zstd", asbytes=True) for x, y in zip(bound[:-1], bound[1:], strict=True)]
                kept = [batch.column(k).slice(a, b - a) for k in (0, 3)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(language, pa.int32()), pa.array(np.diff(bound), pa.int64()), pa.array(payload, pa.binary())], names=["shard", "label", "language", "n", "ids"])

    shard = F.pmod(F.xxhash64(F.lit("shard"), F.col("doc_id")), F.lit(n_shards)).cast("int")
    found = labelled.texts(docs, known).select(shard.alias("shard"), F.xxhash64("doc_id").alias("place"), "doc_id", "label", "text")
    # the least text of an id comes first and is the one that stays
    dealt = found.repartition("shard").sortWithinPartitions("shard", "place", "doc_id", "text")
    return cut(dealt.mapInArrow(run, "shard int, label int, language int, n long, ids binary"))


def _texts(batches: Iterator[pa.RecordBatch], before: dict[tuple[int, int], int]) -> Iterator[tuple[int, int, int, int, np.ndarray]]:
    """(shard, fifth, label, language, bucket numbers); before: texts of a label in earlier shards. Each label is dealt to the fifths in turn."""
    count = Counter(before)
    for batch in blocks.slices(batches):
        for shard, label, language, n, ids in zip(*(batch.column(k) for k in range(5)), strict=True):
            shard, label, n = shard.as_py(), label.as_py(), n.as_py()
            found = np.frombuffer(pa.decompress(ids.as_buffer(), 6 * n, "zstd"), "<u2").reshape(-1, 3) if n else np.zeros((0, 3), dtype="<u2")
            yield shard, count[shard, label] % FIFTHS, label, language.as_py(), found
            count[shard, label] += 1


def known_buckets(texts: DataFrame, before: dict[tuple[int, int], int], held: list[bool], least: list[int]) -> list[np.ndarray]:
    """For each network, which buckets enough of its texts have."""
    size = 3 * BUCKETS

    @blocks.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((FOLDS, size), dtype=np.int64)
        for _, fifth, _, _, ids in _texts(batches, before):
            have = np.unique(ids.astype(np.int32) + _SHIFT)
            for net in range(FOLDS):
                if not (held[net] and fifth == net):
                    count[net, have] += 1
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count.ravel()[at])], names=["at", "n"])

    enough = F.when(F.col("at") < size, least[0])
    for net in range(1, FOLDS):
        enough = enough.when(F.col("at") < (net + 1) * size, least[net])
    sums = texts.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).filter(F.col("n") >= enough)
    live = np.zeros(FOLDS * size, dtype=bool)
    live[sums.select("at").toPandas()["at"].to_numpy(dtype=np.int64)] = True
    return list(live.reshape(FOLDS, size))


def one_round(texts: DataFrame, states: list[State], before: dict[tuple[int, int], int], held: list[bool], weights: list[np.ndarray], passes: list[int], number: int) -> None:
    """Every shard goes through every network; the networks become the averages of what the shards made of them."""
    sc = texts.sparkSession.sparkContext
    # one for each network: the driver packs one at a time, and a task reads its own
    given = [sc.broadcast(s.given()) for s in states]

    def through(net: int) -> DataFrame:
        own = given[net]

        @blocks.tidy
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def begin(shard: int) -> tuple[State, np.ndarray, np.random.Generator]:
                return State.taken(*own.value), np.zeros(3 * BUCKETS, dtype=bool), np.random.default_rng((net, number, shard))

            def learn(chunk: list[np.ndarray], label: list[int]) -> None:
                y = np.array(label)
                for _ in range(passes[net]):
                    order = rng.permutation(len(chunk))
                    for at in range(0, len(order), BATCH):
                        some = order[at : at + BATCH]
                        step(state, [chunk[k] for k in some], y[some], weights[net][y[some]], touched)

            def out() -> pa.RecordBatch:
                moved = np.flatnonzero(touched)
                payload = [state.packed(moved[moved % PARTS == p]) for p in range(PARTS)]
                return pa.RecordBatch.from_arrays([pa.array([net] * (PARTS + 1), pa.int32()), pa.array(range(PARTS + 1), pa.int32()), pa.array([*payload, state.dense().astype("<f4").tobytes()], pa.binary())], names=["net", "part", "payload"])

            now, chunk, label, words = None, [], [], 0
            for shard, fifth, y, _, ids in _texts(batches, before):
                if held[net] and fifth == net:
                    continue
                if chunk and (shard != now or words + len(ids) > CHUNK_WORDS):
                    learn(chunk, label)
                    chunk, label, words = [], [], 0
                if shard != now:
                    if now is not None:
                        yield out()
                    now = shard
                    state, touched, rng = begin(shard)
                chunk.append(ids)
                label.append(y)
                words += len(ids)
            if now is not None:
                learn(chunk, label)
                yield out()

        return texts.mapInArrow(run, "net int, part int, payload binary")

    @blocks.tidy
    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(key: tuple[int, int], total: np.ndarray, count: np.ndarray | int) -> pa.RecordBatch:
            if key[1] < PARTS:
                moved = np.flatnonzero(count)
                payload = packed(moved, *(total[:, moved] / count[moved, None]))
            else:
                payload = (total / count).astype("<f4").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([payload], pa.binary())], names=["net", "part", "payload"])

        key = None
        for batch in batches:
            for net, part, payload in zip(*(batch.column(k) for k in range(3)), strict=True):
                if (net.as_py(), part.as_py()) != key:
                    if key is not None:
                        yield out(key, total, count)
                    key = net.as_py(), part.as_py()
                    total, count = (np.zeros((2, 3 * BUCKETS, DIM), dtype=np.float32), np.zeros(3 * BUCKETS, dtype=np.float32)) if key[1] < PARTS else (0.0, 0)
                raw = payload.as_buffer()
                if key[1] < PARTS:
                    at, values, sums = unpacked(raw)
                    total[0, at] += values
                    total[1, at] += sums
                    count[at] += 1
                else:
                    total, count = total + np.frombuffer(raw, "<f4").astype(float), count + 1
        if key is not None:
            yield out(key, total, count)

    moved = through(0)
    for net in range(1, FOLDS):
        moved = moved.unionByName(through(net))
    means = moved.repartition(FOLDS * PARTS, "net", "part").sortWithinPartitions("net", "part").mapInArrow(mean, "net int, part int, payload binary")
    # Arrow batches reach the driver task by task and are read where they lie; rows would be decoded and pickled, all at once, in its heap
    for batch in means.toArrow().to_batches():
        for net, part, payload in zip(*(batch.column(k) for k in range(3)), strict=True):
            state = states[net.as_py()]
            if part.as_py() < PARTS:
                state.put(payload.as_buffer())
            else:
                state.set_dense(np.frombuffer(payload.as_buffer(), "<f4"))
    for g in given:
        g.destroy()


def held_out(texts: DataFrame, networks: list[Network | None], before: dict[tuple[int, int], int]) -> np.ndarray:
    """Bins (language, bin, least, greatest raw probability, texts of either label) of the fifths, each scored by the network that did not learn from it; None: has learnt from all."""
    given = texts.sparkSession.sparkContext.broadcast(networks)

    @blocks.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, fifth, label, language, ids in _texts(batches, before):
            m = given.value[fifth] if fifth < len(given.value) else None
            if m is not None:
                raw = float(_activity(m, winners(m, [ids])[0], np.array([len(ids)]))[1][0])
                yield pa.RecordBatch.from_arrays([pa.array([language], pa.int32()), pa.array([label], pa.int32()), pa.array([raw], pa.float64())], names=["language", "label", "raw"])

    scored = texts.mapInArrow(run, "language int, label int, raw double")
    bins = scored.groupBy("language", F.floor(F.col("raw") * BINS).alias("bin")).agg(F.min("raw"), F.max("raw"), F.sum(1 - F.col("label")), F.sum("label"))
    found = bins.toPandas().to_numpy(dtype=float)
    given.destroy()
    return found


def fit(docs: DataFrame, labels: DataFrame, learn: Column, shard_bytes: int = SHARD_BYTES) -> Model | None:
    """A model from all labelled texts, or None without labels of both kinds."""
    texts = shards(docs, labels, learn, shard_bytes)
    sizes = texts.groupBy("shard", "label").agg(F.count("*").alias("texts"), F.sum("n").alias("words")).orderBy("shard", "label").collect()
    total, before = [0, 0], {}
    for r in sizes:
        before[r["shard"], r["label"]] = total[r["label"]]
        total[r["label"]] += r["texts"]
    if not all(total):
        return None
    held, weights, counts = [], [], []
    for net in range(FOLDS):
        away = [len(range(net, n, FIFTHS)) for n in total]
        held.append(all(0 < a < n for a, n in zip(away, total, strict=True)))
        own = [n - a * held[-1] for a, n in zip(away, total, strict=True)]
        counts.append(sum(own))
        weights.append(np.array([0.5 * counts[-1] / n for n in own]))
    live = known_buckets(texts, before, held, [min(LEAST_TEXTS, n) for n in counts])
    states = [State.start(live[net], net) for net in range(FOLDS)]
    rounds = 1 if sum(r["words"] for r in sizes) <= CHUNK_WORDS and len({r["shard"] for r in sizes}) == 1 else EPOCHS
    passes = [-(-max(EPOCHS, STEPS * BATCH // n) // rounds) for n in counts]
    for number in range(rounds):
        one_round(texts, states, before, held, weights, passes, number)
    networks = [s.network for s in states]
    del states  # the sums go
    seen = held_out(texts, [m if h else None for m, h in zip(networks, held, strict=True)], before) if any(held) else []
    blocks.give_back()
    return Model(networks, calibrated(seen) if len(seen) else {-1: 0.5})


def score(docs: DataFrame, model: Model | None, name: str = "score") -> DataFrame:
    """docs (doc_id, text and more) with the score, a double, under a name; a column of that name is replaced."""
    # written straight to the broadcast's file; in the function's closure it would first be a string of bytes, and written after
    given = docs.sparkSession.sparkContext.broadcast(model)

    @blocks.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros(batch.num_rows)
            if (model := given.value) is not None:
                text = batch.column(batch.schema.get_field_index("text"))
                for a, b, offsets, data in blocks.text_blocks(text, BLOCK):
                    ids, bound, language = _features(offsets, data)
                    found[a:b] = model.score(model.raw(ids, bound), language)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, name])

    docs = docs.select(*[c for c in docs.columns if c.lower() != name.lower()])
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"), labelled.id_crc(3) != 1)
    return score(docs, model).select(
        "doc_id", F.coalesce(labelled.id_crc(3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )
