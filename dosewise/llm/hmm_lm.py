"""Language-model scoring: a hidden Markov model trained by Baum-Welch, beside a unigram base.

The corpus's word counts are summed by Spark.  Words of at least a ``1 / KNOWN``
share of all tokens (at most ``KNOWN``) are symbols of their own from the start;
the others are tied to ``CLASSES`` symbols by their ending while the states are
found.  Texts are coded once, in books of about ``BOOK`` tokens, each a row of
a stored table that lists its words once: an expectation step reads these rows
and sends on expected counts of the symbols alone, so no text is shuffled.

Training is incremental Baum-Welch: texts are dealt to ``SLICES`` slices by
their hash, each a column of the books; each slice's expected counts are kept,
and the model is made anew from the counts of all slices after each one.  Every
sweep goes over all training text, until a sweep gains next to nothing.  A last
sweep unties the words: every word seen at least ``OWN`` times, however many
there are, gets its expected count in every state, summed by Spark; only words
seen less often keep their class's, times the word's smoothed share of the
class's count, so text of any vocabulary has an exact probability.

The last sweep sends, for each book and part of the vocabulary, one row: the
book's words of that part that are not broadcast, and their expected counts
where they may have some.  Where a part's rows meet, the counts are summed and
each book gets its words' sums back, for the scaled forward recursion over each
whole text.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from dosewise.llm.common import id_text, per_batch, ship, stored

OWN, CLASSES, KNOWN = 8, 64, 1 << 15
STATES, SLICES = 8, 24
#: Slices taken together in the first sweep, the second, and all later ones: the model is made anew after each group.
TOGETHER = (1, 3, 6)
#: Baum-Welch ends when a sweep gains less than so much natural log probability a training token.
TOLERANCE = 0.01
END = b""
#: Words held in a task before they are sent on, tokens whose state probabilities are held at once, and tokens of a book.
FLUSH, HELD, BOOK = 1 << 20, 1 << 18, 1 << 21
#: Bytes of texts that are split into words at once.
SPLIT = 1 << 23
#: Tokens of a long text that are walked in one go.
PIECE = 256
#: Steps after which what is walked is scaled.
EVERY = 3
ADD = 0.1
#: Occurrences by which a word's states are drawn towards those of all tokens.
DRAW = 1.0
#: Bits of the set of words that may be seen ``OWN`` times: a task leaves out most others.  Words of a part of the vocabulary.
SEEN_BITS, PART = 1 << 25, 100_000


def words(text: str) -> list[bytes]:
    return text.encode().lower().split()  # of bytes: ASCII letters and white space


def word_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % CLASSES


def _some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, in pieces of about ``SPLIT`` bytes of ``text`` (or one text)."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SPLIT, "right")))
            yield batch.slice(at, to - at)
            at = to


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """How many words each text has, and all words as places among the different ones, which come last."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = split.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    before = np.cumsum(np.append(0, full.to_numpy(zero_copy_only=False)), dtype=np.int64)[split.offsets.to_numpy()]
    coded = flat.filter(full).cast(pa.binary()).dictionary_encode()
    return np.diff(before), coded.indices.to_numpy(), coded.dictionary


def word_counts(texts: DataFrame) -> DataFrame:
    """``token binary, n, class`` over all ``text``; the end of a text is the empty token."""
    most = FLUSH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, ends = [], 0

        def summed():
            got = pa.concat_tables(seen).group_by("token", use_threads=False).aggregate([("n", "sum")])
            return pa.table({"token": got["token"], "n": got["n_sum"]})

        for batch in _some(batches):
            _, places, names = _tokens(batch.column("text"))
            ends += batch.num_rows
            seen.append(pa.table({"token": names, "n": pa.array(np.bincount(places, minlength=len(names)), pa.int64())}))
            if sum(x.num_rows for x in seen) > most:
                seen = [summed()]
                if seen[0].num_rows > most // 2:
                    yield from seen[0].to_batches()
                    seen.clear()
        if ends:
            seen.append(pa.table({"token": pa.array([END], pa.binary()), "n": pa.array([ends], pa.int64())}))
            yield from summed().to_batches()

    counted = per_batch(texts.select("text"), run, "token binary, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    return counted.select("token", "n", (F.crc32(F.expr("substring(token, -2, 2)")) % CLASSES).cast("int").alias("class"))


@dataclass
class Alphabet:
    tokens: int  # all training tokens
    types: int  # distinct ones
    own: int  # times a word is seen that has expected counts of its own in the end
    words: list[bytes]  # the broadcast ones
    known: dict[bytes, int]  # their places
    count: np.ndarray
    tied_count: np.ndarray  # of each class: all words that are not broadcast
    tied_add: np.ndarray  # what smoothing adds
    class_count: np.ndarray  # of each class: those seen less than ``own`` times
    class_add: np.ndarray


def alphabet(counts: DataFrame) -> Alphabet:
    """``counts`` is a stored result of ``word_counts``.  What is collected has at most ``KNOWN + 1 + CLASSES`` rows."""
    total = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = int(total.n or 0), int(total.v)
    common = (F.col("n") * KNOWN >= n) | (F.col("token") == F.lit(END))
    rows = counts.where(common).select("token", "n").toArrow()
    listed = sorted(zip(rows["token"].to_pylist(), rows["n"].to_pylist()), key=lambda r: (-r[1], r[0]))
    if END not in {t for t, _ in listed}:
        listed.append((END, 0))
    seldom = F.when(F.col("n") < OWN, F.col("n"))
    sums = {r["class"]: r for r in counts.where(~common).groupBy("class").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"), F.sum(seldom).alias("rn"), F.count(seldom).alias("rv")).collect()}
    of = lambda c: np.array([(sums[k][c] or 0) if k in sums else 0 for k in range(CLASSES)], dtype=float)
    return Alphabet(n, v, OWN, [t for t, _ in listed], {t: i for i, (t, _) in enumerate(listed)}, np.array([c for _, c in listed], dtype=float),
                    of("n"), ADD * (of("v") + 1), of("rn"), ADD * (of("rv") + 1))


#: A book's columns of coded texts: a slice each, and one of the texts that are held out.
SLICED = [f"t{i}" for i in range(SLICES)]
CODED = f"book bigint, ids array<bigint>, held array<boolean>, rare binary, kinds binary, {', '.join(f'{c} binary' for c in SLICED)}, out binary"


def _packed(values: np.ndarray) -> bytes:
    """Compressed, first bytes first."""
    raw = np.frombuffer(values.tobytes(), np.uint8).reshape(-1, values.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(data: bytes | None, kind: str) -> np.ndarray:
    if not data:
        return np.zeros(0, kind)
    raw = np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def _joined(names: list[bytes]) -> bytes:
    return _packed(np.frombuffer(b" ".join(names), np.uint8))


def _parted(data: bytes) -> list[bytes]:
    """Words hold no blanks."""
    return _unpacked(data, "u1").tobytes().split()


def coded(texts: DataFrame, letters: Alphabet) -> DataFrame:
    """A row per book of ``doc_id, held_out, text``: ids, whether held out, its words that are not broadcast, their classes ``kinds``, and the symbols of its texts by slice.

    A symbol is a broadcast word's place or, from their number on, a place in
    the book's ``rare`` words.  The ids are in the order of the columns of
    symbols; every text there ends with the end's symbol, which no word has.
    """
    sent = texts.sparkSession.sparkContext.broadcast(letters)
    book_tokens, book_words, slices, classes = BOOK, FLUSH, SLICES, CLASSES
    columns = [*SLICED, "out"]
    kind = pa.schema([("book", pa.int64()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("rare", pa.binary()), ("kinds", pa.binary()), *((c, pa.binary()) for c in columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = sent.value
        end, first, number = a.known[END], len(a.words), itertools.count(TaskContext.get().partitionId() << 33)
        fresh = lambda: ([[] for _ in columns], [[] for _ in columns], {}, 0)
        ids, symbols, rare, size = fresh()

        def done():
            names = list(rare)
            kinds = np.fromiter((zlib.crc32(w[-2:]) % classes for w in names), np.uint8, len(names))
            row = {"book": next(number), "ids": [i for x in ids for i, _ in x], "held": [out for x in ids for _, out in x], "rare": _joined(names), "kinds": _packed(kinds)}
            return pa.RecordBatch.from_pylist([row | {c: _packed(np.concatenate(x)) if x else None for c, x in zip(columns, symbols)}], kind)

        for batch in _some(batches):
            sizes, places, names = _tokens(batch.column("text"))
            names = names.to_pylist()
            place = np.fromiter(map(a.known.get, names, itertools.repeat(-1)), np.int64, len(names))
            for i in np.flatnonzero(place < 0).tolist():
                place[i] = first + rare.setdefault(names[i], len(rare))
            ends = np.cumsum(sizes + 1)
            coded = np.full(int(ends[-1]), end, "<u4")
            inside = np.ones(len(coded), bool)
            inside[ends - 1] = False
            coded[inside] = place[places]
            for doc_id, out, text, to, n in zip(batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), batch.column("text"), ends.tolist(), sizes.tolist()):
                s = slices if out else zlib.crc32(text.as_buffer()) % slices
                ids[s].append((doc_id, out))
                symbols[s].append(coded[to - n - 1 : to])
            size += len(coded)
            if size > book_tokens or len(rare) > book_words:
                yield done()
                ids, symbols, rare, size = fresh()
        if size:
            yield done()

    return per_batch(texts, run, CODED)


@dataclass
class Hmm:
    start: np.ndarray  # K
    move: np.ndarray  # K x K
    emit: np.ndarray  # symbols x K


@dataclass
class Model:
    """What is sent to the tasks; expected counts of the words that are not broadcast are a table beside it."""

    start: np.ndarray  # K
    move: np.ndarray  # K x K
    share: np.ndarray  # K: of each state in all tokens
    total: np.ndarray  # K: smoothed counts of all symbols
    known: np.ndarray  # broadcast words x K, probabilities
    classes: np.ndarray  # CLASSES x K, probabilities

    def tied(self, real=np.float64) -> Hmm:
        """Over broadcast words and classes."""
        return Hmm(self.start.astype(real), self.move.astype(real), np.concatenate([self.known, self.classes]).astype(real))


def smoothed(n: np.ndarray, add: np.ndarray | float, counts: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Expected counts (words x K) of words seen ``n`` times, drawn towards ``share`` by ``DRAW`` occurrences; their sum is ``n + add``."""
    return (n / (n + DRAW))[:, None] * counts + (n * DRAW / (n + DRAW) + add)[:, None] * share


def first_counts(names: list[bytes], n: np.ndarray, states: int) -> np.ndarray:
    """Starting values: each word's count dealt over the states by a hash of the word."""
    raw = np.frombuffer(b"".join(hashlib.shake_128(b"11" + w).digest(8 * states) for w in names), "<u8").reshape(len(names), states)
    deal = -np.log((raw + 0.5) / 2.0**64)
    return n[:, None] * deal / deal.sum(axis=1, keepdims=True)


def from_counts(letters: Alphabet, start: np.ndarray, move: np.ndarray, known: np.ndarray, classes: np.ndarray, share: np.ndarray, own: np.ndarray | None = None) -> Model:
    """Probabilities from expected counts.  ``own`` is the sum of the smoothed ones of words with counts of their own; without it all others are tied."""
    k = len(start)
    start, move = start + 1.0 / k, move + 1.0 / k
    n, add = (letters.tied_count, letters.tied_add) if own is None else (letters.class_count, letters.class_add)
    known, classes = smoothed(letters.count, ADD, known, share), smoothed(n, add, classes, share)
    total = known.sum(axis=0) + classes.sum(axis=0) + (0 if own is None else own)
    return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), share, total, known / total, classes / total)


#: Symbols of each text, or of all texts and each text's number.
Texts = list[np.ndarray] | tuple[np.ndarray, np.ndarray]


class _Pieces:
    """Texts cut into pieces of at most ``PIECE`` tokens, which can be walked side by side."""

    def __init__(self, texts: Texts):
        flat, sizes = texts if isinstance(texts, tuple) else (np.concatenate(texts), np.array([len(t) for t in texts]))
        self.flat = flat.astype(np.int64, copy=False)
        n = -(-sizes // PIECE)
        self.text = np.repeat(np.arange(len(sizes)), n)
        nth = np.arange(len(self.text)) - np.repeat(np.cumsum(n) - n, n)
        self.at = np.repeat(np.cumsum(sizes) - sizes, n) + nth * PIECE
        self.size = np.minimum(PIECE, np.repeat(sizes, n) - nth * PIECE)
        self.first, self.last, self.nth = nth == 0, nth == np.repeat(n, n) - 1, nth

    def groups(self, some: np.ndarray) -> Iterator[np.ndarray]:
        """``some`` pieces, longest first, in groups of at most ``HELD`` tokens (or one piece)."""
        some = some[np.argsort(-self.size[some], kind="stable")]
        cut = np.cumsum(self.size[some]) // HELD
        return iter(np.split(some, np.flatnonzero(np.diff(cut)) + 1)) if len(some) else iter(())

    def steps(self, group: np.ndarray) -> list[int]:
        """How many pieces of a group are longer than ``t``, for each ``t``."""
        size = self.size[group]
        return np.searchsorted(-size, -np.arange(size[0])).tolist()

    def symbols(self, at: np.ndarray, t: int, n: int) -> np.ndarray:
        return self.flat.take(at[:n] + t)


def _relative(model: Hmm) -> tuple[Hmm, np.ndarray]:
    """The model with each symbol's largest emission set to 1, and the natural logs of what they were divided by."""
    most = model.emit.max(axis=1)
    return Hmm(model.start, model.move, model.emit / most[:, None]), np.log(most.astype(np.float64))


def _borders(model: Hmm, p: _Pieces) -> tuple[np.ndarray, np.ndarray]:
    """State probabilities before each piece given what came before, and, up to a factor, of all that follows it given the state at its end.

    A piece is a product of matrices, one a token; the products of all pieces
    but the first ones are formed side by side, then applied in order.
    """
    k, real = len(model.start), model.emit.dtype
    before, after = np.zeros((len(p.size), k), real), np.ones((len(p.size), k), real)
    if p.first.all():
        return before, after
    ends, products = np.zeros((len(p.size), k), real), np.zeros((len(p.size), k, k), real)
    for group in p.groups(np.flatnonzero(p.first & ~p.last)):
        last = _forward(model, p, group, before)[0][-1]  # all of one length
        ends[group] = last / last.sum(axis=1, keepdims=True)
    every = np.ones((k, k), real)
    for group in p.groups(np.flatnonzero(~p.first)):
        # the state before a piece comes first, so that a step goes along the pieces
        q, at = np.repeat(np.eye(k, dtype=real)[:, None, :], len(group), axis=1), p.at[group]
        steps = p.steps(group)
        for t, n in enumerate(steps):
            if n < q.shape[1]:
                products[group[n : q.shape[1]]] = q[:, n:].transpose(1, 0, 2)
                q = np.ascontiguousarray(q[:, :n])
            q = (q.reshape(-1, k) @ model.move).reshape(k, n, k)
            q *= model.emit.take(p.symbols(at, t, n), axis=0)
            if t % EVERY == EVERY - 1:
                q /= q.sum(axis=0) @ every
        products[group[: q.shape[1]]] = q.transpose(1, 0, 2)
    for j in range(1, int(p.nth.max()) + 1):
        here = np.flatnonzero(p.nth == j)
        before[here] = ends[here - 1]
        new = np.einsum("ij,ijk->ik", before[here], products[here])
        ends[here] = new / new.sum(axis=1, keepdims=True)
    for j in range(int(p.nth.max()), 0, -1):
        here = np.flatnonzero(p.nth == j)
        new = np.einsum("ijk,ik->ij", products[here], after[here])
        after[here - 1] = new / new.sum(axis=1, keepdims=True)
    return before, after


def _forward(model: Hmm, p: _Pieces, group: np.ndarray, before: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray | None], list[np.ndarray], list[np.ndarray]]:
    """Forward probabilities of each step, scales (for every state; none where a step is not scaled), emissions and symbols."""
    alphas, scales, emits, symbols = [], [], [], []
    every, at = np.ones((len(model.start),) * 2, model.emit.dtype), p.at[group]
    alpha = None
    for t, n in enumerate(p.steps(group)):
        prior = np.where(p.first[group][:, None], model.start, before[group] @ model.move) if alpha is None else alpha[:n] @ model.move
        symbols.append(p.symbols(at, t, n))
        emits.append(model.emit.take(symbols[-1], axis=0))
        alpha = prior * emits[-1]
        scales.append(None)
        if t % EVERY == EVERY - 1:
            scales[-1] = alpha @ every
            alpha /= scales[-1]
        alphas.append(alpha)
    return alphas, scales, emits, symbols


def _logs(p: _Pieces, group: np.ndarray, alphas: list[np.ndarray], scales: list[np.ndarray | None], n_texts: int) -> np.ndarray:
    """Natural log of what the forward probabilities of a group's pieces were scaled by, and of their last sums, by text."""
    out = np.zeros(len(group))
    for t, alpha in enumerate(alphas):
        left = len(alphas[t + 1]) if t + 1 < len(alphas) else 0
        if scales[t] is not None:
            out[: len(alpha)] += np.log(scales[t][:, 0])
        if left < len(alpha):
            out[left : len(alpha)] += np.log(alpha[left:].sum(axis=1, dtype=np.float64))
    return np.bincount(p.text[group], out, n_texts)


def log_likelihoods(model: Hmm, texts: Texts) -> np.ndarray:
    """Natural log probability of each text's symbols, by the scaled forward recursion."""
    p, (model, most) = _Pieces(texts), _relative(model)
    out = np.add.reduceat(most[p.flat], p.at[p.first])
    before, _ = _borders(model, p)
    for group in p.groups(np.arange(len(p.size))):
        alphas, scales, _, _ = _forward(model, p, group, before)
        out += _logs(p, group, alphas, scales, len(out))
    return out


def expected_counts(model: Hmm, texts: Texts, n_symbols: int, also: tuple[np.ndarray, int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, np.ndarray]:
    """Expected counts of starts, moves and emissions, the natural log probability of all texts, and expected counts of other marks.

    ``also``: a mark of every token of all texts (-1: none), and their number.
    Long texts are walked in pieces, between borders that are found first, so
    any length takes ``PIECE`` steps and memory for ``HELD`` tokens.
    """
    k = len(model.start)
    start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros((n_symbols, k))
    extra = np.zeros((also[1] if also else 0, k))
    p, (model, most) = _Pieces(texts), _relative(model)
    log = float(most[p.flat].sum())
    before, after = _borders(model, p)
    back, held = np.ascontiguousarray(model.move.T), np.empty((k, min(len(p.flat), HELD + PIECE)))
    for group in p.groups(np.arange(len(p.size))):
        alphas, scales, emits, symbols = _forward(model, p, group, before)
        log += float(_logs(p, group, alphas, scales, 0).sum())
        sizes = [len(a) for a in alphas]
        by_state, first = held[:, : sum(sizes)], np.cumsum([0, *sizes])
        later = np.empty((0, k), model.emit.dtype)  # emission times beta over scale, of the step after
        for t in range(len(alphas) - 1, -1, -1):
            a, n = alphas[t], len(later)
            beta = np.empty_like(a)
            np.matmul(later, back, out=beta[:n])
            move += a[:n].T @ later
            if n < len(a):
                end = after[group[n : len(a)]]
                beta[n:] = end / (a[n:] * end).sum(axis=1, keepdims=True)
            by_state[:, first[t] : first[t + 1]] = (a * beta).T
            later = emits[t]
            later *= beta
            if scales[t] is not None:
                later /= scales[t]
        opening = p.first[group]
        start += by_state[:, : sizes[0]][:, opening].sum(axis=1)
        move += before[group[~opening]].T @ later[~opening]
        symbols = np.concatenate(symbols)
        for s in range(k):
            emit[:, s] += np.bincount(symbols, by_state[s], n_symbols)
        if also:
            marks = also[0][np.concatenate([p.at[group[:n]] + t for t, n in enumerate(sizes)])]
            some = np.flatnonzero(marks >= 0)
            for s in range(k):
                extra[:, s] += np.bincount(marks[some], by_state[s][some], also[1])
    return start, move * model.move, emit, log, extra


def _coded_texts(row: dict, columns: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of a book's ``columns``, and of how many each text is."""
    symbols = np.concatenate([_unpacked(row[c], "<u4") for c in columns])
    return symbols, np.diff(np.flatnonzero(symbols == end), prepend=-1)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _fixed_counts(got: tuple) -> np.ndarray:
    """Rows of counts that stay on the driver: broadcast words, classes, moves, the starts and, last, the log probability."""
    start, move, emit, log, _ = got
    return np.concatenate([emit, move, start[None], np.full((1, len(start)), log)])


def _expect(books: DataFrame, slices: list[str], letters: Alphabet, model: Model) -> DataFrame:
    """``at, s0...``: expected counts of the texts of ``slices``, summed by row ``at`` of ``_fixed_counts``."""
    spark, k = books.sparkSession, len(model.start)
    sums = [f"s{i}" for i in range(k)]
    n_known, n_symbols, end = len(letters.words), len(letters.words) + CLASSES, letters.known[END]
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hmm, fixed = sent.value.tied(np.float32), np.zeros((n_symbols + k + 2, k))  # sums are doubles
        for row in _rows(batches):
            tied = np.concatenate([np.arange(n_known), n_known + _unpacked(row["kinds"], "u1").astype(np.int64)])
            symbols, sizes = _coded_texts(row, slices, end)
            if len(sizes):
                fixed += _fixed_counts(expected_counts(hmm, (tied[symbols], sizes), n_symbols))
        at = np.flatnonzero(fixed.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(fixed[at, i]) for i in range(k))], names=["at", *sums])

    return per_batch(books.select("kinds", *slices), run, f"at int, {', '.join(f'{c} double' for c in sums)}").groupBy("at").agg(*(F.sum(c).alias(c) for c in sums))


def _fixed(summed: DataFrame, n: int, k: int) -> np.ndarray:
    """The expected counts that stay on the driver: at most a row for each broadcast word, class and state."""
    got = summed.toArrow()
    out = np.zeros((n, k))
    out[got["at"].to_numpy()] = np.stack([got[f"s{i}"].to_numpy() for i in range(k)], axis=1)
    return out


def _untrained(letters: Alphabet, states: int) -> Model:
    return from_counts(letters, np.ones(states), np.random.default_rng(11).random((states, states)) + 4 * np.eye(states), first_counts(letters.words, letters.count, states),
                       first_counts([b"class %d" % c for c in range(CLASSES)], letters.tied_count, states), np.full(states, 1.0 / states))


def _model_of(letters: Alphabet, fixed: np.ndarray, states: int) -> Model:
    n = len(letters.words)
    known, classes, move, start = fixed[:n], fixed[n : n + CLASSES], fixed[n + CLASSES : -2], fixed[-2]
    share = known.sum(axis=0) + classes.sum(axis=0)
    return from_counts(letters, start, move, known, classes, share / share.sum())


def train(books: DataFrame, letters: Alphabet, states: int = STATES, passes: int | None = None) -> tuple[Model, list[float]]:
    """Incremental Baum-Welch over the coded books, words that are not broadcast tied by class.

    The start is seeded by hashes of the words.  The expected counts of each
    group of slices take the place of its earlier ones, and the model is made
    from all.  Sweeps end when the gain is below ``TOLERANCE``, or after
    ``passes`` if that is given.  Returns the model and each sweep's log
    probability a token.
    """
    model, logs = _untrained(letters, states), []
    n = len(letters.words) + CLASSES + states + 2
    kept = [np.zeros((n, states))] * SLICES
    while letters.tokens and len(logs) != passes:
        step = TOGETHER[min(len(logs), len(TOGETHER) - 1)]
        for first in range(0, SLICES, step):
            group = range(first, min(first + step, SLICES))
            for s in group:
                kept[s] = np.zeros((n, states))
            kept[first] = _fixed(_expect(books, [SLICED[s] for s in group], letters, model), n, states)
            total = sum(kept)
            if total[:-1].any():
                model = _model_of(letters, total, states)
        logs.append(float(sum(x[-1, 0] for x in kept)) / letters.tokens)
        if passes is None and len(logs) > 1 and logs[-1] - logs[-2] < TOLERANCE:
            break
    return model, logs


def _may_be_often(counts: DataFrame, letters: Alphabet) -> np.ndarray:
    """Bits of the hashes of words seen ``OWN`` times or more that are not broadcast."""
    common = (F.col("n") * KNOWN >= letters.tokens) | (F.col("token") == F.lit(END))
    bit = F.pmod(F.xxhash64("token"), F.lit(SEEN_BITS))  # SEEN_BITS is a power of two: the same for signed and unsigned hashes
    rows = counts.where((F.col("n") >= OWN) & ~common).select(bit.alias("b")).groupBy((F.col("b") / 8).cast("int").alias("at")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1), (F.col("b") % 8).cast("int"))).alias("bits")).toArrow()
    seen = np.zeros(SEEN_BITS // 8, np.uint8)
    seen[rows["at"].to_numpy()] = rows["bits"].to_numpy().astype(np.uint8)
    return seen


def _by_part(names: list[bytes], parts: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Parts of the vocabulary, and the places in ``names`` of each one's words."""
    part = np.fromiter(map(zlib.crc32, names), np.int64, len(names)) % parts
    order = np.argsort(part, kind="stable")
    which, first = np.unique(part[order], return_index=True)
    return which, np.split(order, first[1:]) if len(names) else []


#: Rows that meet in a part: ``side`` 0 has counts of words, 1 a book's words and expected counts of those at ``places``, 2 a task's rows ``places`` of ``_fixed_counts``.
DEALT = "part int, side int, book bigint, words binary, places binary, values binary"


def _dealt(part: int, side: int, book: int | None = None, names: bytes | None = None, places: np.ndarray | None = None, values: np.ndarray | None = None) -> pa.RecordBatch:
    row = {"part": int(part), "side": side, "book": book, "words": names, "places": None if places is None else _packed(places), "values": None if values is None else _packed(values)}
    return pa.RecordBatch.from_pylist([row], pa.schema([("part", pa.int32()), ("side", pa.int32()), ("book", pa.int64()), *((c, pa.binary()) for c in ("words", "places", "values"))]))


def _counts_by_part(counts: DataFrame, parts: int) -> DataFrame:
    """Side 0: the words of ``counts``, many a row."""
    most = FLUSH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush():
            for part, here in zip(*_by_part(names, parts)):
                yield _dealt(part, 0, names=_joined([names[i] for i in here]), values=np.concatenate(ns)[here])
            names.clear()
            ns.clear()

        names, ns = [], []
        for batch in batches:
            names += batch.column("token").to_pylist()
            ns.append(batch.column("n").to_numpy())
            if len(names) > most:
                yield from flush()
        if names:
            yield from flush()

    return per_batch(counts.where(F.col("token") != F.lit(END)).select("token", "n"), run, DEALT)


def _last_sweep(books: DataFrame, letters: Alphabet, model: Model, seen: np.ndarray, parts: int) -> DataFrame:
    """Sides 1 and 2: one more expectation step, which also counts each word whose bit is set."""
    k, n_known, n_symbols, end = len(model.start), len(letters.words), len(letters.words) + CLASSES, letters.known[END]
    sent = books.sparkSession.sparkContext.broadcast((model, seen))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, bits = sent.value
        hmm, fixed = m.tied(np.float32), np.zeros((n_symbols + k + 2, k))
        for row in _rows(batches):
            names = _parted(row["rare"])
            h = np.fromiter((xxh64_intdigest(w, 42) for w in names), np.uint64, len(names)) % np.uint64(SEEN_BITS)
            often = bits[h >> np.uint64(3)] >> (h & np.uint64(7)).astype(np.uint8) & 1 == 1
            place = np.full(n_known + len(names), -1, np.int64)
            place[n_known:][often] = np.arange(often.sum())
            expected = np.zeros((int(often.sum()), k))
            tied = np.concatenate([np.arange(n_known), n_known + _unpacked(row["kinds"], "u1").astype(np.int64)])
            for c in SLICED:
                symbols, sizes = _coded_texts(row, [c], end)
                if len(sizes):
                    got = expected_counts(hmm, (tied[symbols], sizes), n_symbols, (place[symbols], len(expected)))
                    fixed += _fixed_counts(got)
                    expected += got[-1]
            for part, here in zip(*_by_part(names, parts)):
                have = here[often[here]]
                yield _dealt(part, 1, row["book"], _joined([names[i] for i in here]), np.flatnonzero(often[here]).astype("<i4"), expected[place[n_known + have]].astype("<f4"))
        for part in range(parts):
            at = np.arange(part, len(fixed), parts)
            at = at[fixed[at].any(axis=1)]
            if len(at):
                yield _dealt(part, 2, places=at.astype("<i4"), values=fixed[at])

    return per_batch(books.select("book", "rare", "kinds", *SLICED), run, DEALT)


#: ``side`` 1: counts ``ns`` of a book's words of a part, and expected counts ``es`` of those at ``places``; ``side`` 2: ``sums`` by ``part``, a row of ``_fixed_counts``;
#: ``side`` 3: by ``part``, a class: of its words with counts of their own the number, the drawn occurrences, expected counts and the part of them that is kept.
ANSWERS = "book bigint, part int, side int, ns binary, places binary, es binary, sums array<double>"


def _answers(own: int, k: int):
    """``ANSWERS`` of dealt rows.  A part's words come first."""
    kind = pa.schema([("book", pa.int64()), ("part", pa.int32()), ("side", pa.int32()), *((c, pa.binary()) for c in ("ns", "places", "es")), ("sums", pa.list_(pa.float64()))])

    def of_part(part: int, rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        place, count, asked, fixed = {}, [np.zeros(0, np.int64)], [], {}
        expected = np.zeros((0, k))
        for row in rows:
            if row["side"] == 0:
                names = _parted(row["words"])
                place.update(zip(names, range(len(place), len(place) + len(names))))
                count.append(_unpacked(row["values"], "<i8"))
                continue
            if len(expected) != len(place):
                expected = np.zeros((len(place), k))
            values = _unpacked(row["values"], "<f4" if row["side"] == 1 else "<f8").reshape(-1, k)
            at = _unpacked(row["places"], "<i4")
            if row["side"] == 2:
                for i, v in zip(at.tolist(), values):
                    fixed[i] = fixed[i] + v if i in fixed else v
                continue
            names = _parted(row["words"])
            here = np.fromiter(map(place.get, names, itertools.repeat(-1)), np.int32, len(names))
            there = here[at] >= 0  # a bit may be set by another word
            expected[here[at][there]] += values[there]
            asked.append((row["book"], here))
        out = []
        n = np.append(np.concatenate(count), 0)
        have = np.append((n[:-1] >= own) & expected.any(axis=1) if len(expected) else np.zeros(len(n) - 1, bool), False)
        for book, here in asked:
            some = have[here]
            out.append({"book": book, "side": 1, "part": part, "ns": _packed(n[here].astype("<i8")), "places": _packed(np.flatnonzero(some).astype("<i4")),
                        "es": _packed(expected[here[some]].astype("<f4"))})
        out += [{"side": 2, "part": i, "sums": v.tolist()} for i, v in fixed.items()]
        which = np.flatnonzero(have)
        if len(which):
            names = list(place)
            classes, e, drawn = np.array([word_class(names[i]) for i in which]), expected[which], DRAW / (n[which] + DRAW)
            rows = np.column_stack([np.ones(len(which)), n[which] * drawn, e, e * (1 - drawn)[:, None]])
            out += [{"side": 3, "part": int(c), "sums": rows[classes == c].sum(axis=0).tolist()} for c in np.unique(classes)]
        if out:
            yield pa.RecordBatch.from_pylist(out, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in itertools.groupby(_rows(batches), lambda r: r["part"]):
            yield from of_part(part, rows)

    return run


def untied(books: DataFrame, counts: DataFrame, letters: Alphabet, model: Model, parts: int) -> tuple[Model, DataFrame]:
    """One more pass: the model with words seen ``OWN`` times or more untied, and what each book needs of its words (side 1 of ``ANSWERS``)."""
    k, n_known = len(model.start), len(letters.words)
    dealt = _counts_by_part(counts, parts).unionByName(_last_sweep(books, letters, model, _may_be_often(counts, letters), parts))
    answers = stored(per_batch(dealt.repartition("part").sortWithinPartitions("part", "side"), _answers(OWN, k), ANSWERS), "answers")
    mine = answers.where("side = 1").select("book", "part", "ns", "places", "es")
    if not letters.tokens:
        return model, mine
    sums = lambda side, n: answers.where(F.col("side") == side).groupBy(F.col("part").alias("at")).agg(*(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(n)))
    fixed, of_class = _fixed(sums(2, k), n_known + CLASSES + k + 2, k), _fixed(sums(3, 2 + 2 * k), CLASSES, 2 + 2 * k)
    known, classes, move, start = fixed[:n_known], fixed[n_known : n_known + CLASSES], fixed[n_known + CLASSES : -2], fixed[-2]
    share = known.sum(axis=0) + classes.sum(axis=0)
    share = share / share.sum()
    v, drawn, e, rest = of_class[:, 0], of_class[:, 1], of_class[:, 2 : 2 + k], of_class[:, 2 + k :]
    return from_counts(letters, start, move, known, np.maximum(classes - e, 0), share, rest.sum(axis=0) + (drawn.sum() + ADD * v.sum()) * share), mine


# -- scoring ----------------------------------------------------------------

def score(docs: DataFrame, train_on: Column, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, passes: int | None = None) -> DataFrame:
    """Train on the texts whose ``doc_id`` satisfies ``train_on`` and score all.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score``: tokens are lower-cased words and one end; ``n_known`` counts those
    seen in training; the scores are log10 probabilities of the whole text
    under smoothed unigram shares and under the model.  A null or empty text
    has one token.  Without training text nothing is known, every token's base
    probability is 1 and the model is its untrained start.
    """
    rows, spark = id_text(docs, id_col, text_col), docs.sparkSession
    counts = stored(word_counts(rows.where(train_on)), "word-counts")
    letters = alphabet(counts)
    books = stored(coded(rows.select("doc_id", (~train_on).alias("held_out"), "text"), letters), "coded", rows_per_file=8)
    model, _ = train(books, letters, states, passes)
    parts = max(64, letters.types // PART, books.count() // 4)
    model, answers = untied(books, counts, letters, model, parts)
    sent = spark.sparkContext.broadcast((letters, model))
    log_total = float(np.log10(letters.tokens + ADD * (letters.types + 1)))

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        a, m = sent.value
        row, k, end = rows.to_pylist()[0], len(m.start), a.known[END]
        kinds = _unpacked(row["kinds"], "u1").astype(np.int64)
        # the answers in the order of the book's words
        which, places = _by_part(_parted(row["rare"]), parts)
        places, n, emit = dict(zip(which.tolist(), places)), np.zeros(len(kinds), np.int64), np.zeros((len(kinds), k))
        for part, ns, at, es in zip(*(answers.column(c).to_pylist() for c in ("part", "ns", "places", "es"))):
            n[places[part]] = _unpacked(ns, "<i8")
            emit[places[part][_unpacked(at, "<i4")]] = _unpacked(es, "<f4").reshape(-1, k)
        seldom = ~emit.any(axis=1)
        emit = smoothed(n.astype(float), ADD, emit, m.share) / m.total
        add = (a.class_count + a.class_add) if a.tokens else (a.tied_count + a.tied_add)
        emit[seldom] = m.classes[kinds[seldom]] * ((n[seldom] + ADD) / add[kinds[seldom]])[:, None]
        hmm = Hmm(m.start, m.move, np.concatenate([m.known, emit]))
        flat, size = _coded_texts(row, [*SLICED, "out"], end)
        n = np.concatenate([a.count, n])
        logs = np.log10(n + ADD) - log_total
        of_text = lambda x: np.add.reduceat(x[flat], np.cumsum(size) - size)
        return pa.table([pa.array(row["ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(size, pa.int64()), pa.array(of_text((n > 0).astype(np.int64)), pa.int64()),
                         pa.array([a.tokens] * len(size), pa.int64()), pa.array(of_text(logs), pa.float64()),
                         pa.array(log_likelihoods(hmm, (flat, size)) / np.log(10), pa.float64())], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    ship(spark)
    return books.groupBy("book").cogroup(answers.groupBy("book")).applyInArrow(
        run, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
