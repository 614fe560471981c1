"""SentencePiece BPE encoding and decoding by backtracking.

The encoding of a merge-ordered vocabulary is the only token sequence in which
every adjacent pair of tokens is *compatible*: re-merging the two tokens' text
gives the same two tokens back.  So instead of simulating merges over the whole
text, the encoder walks it left to right: an Aho-Corasick pass gives the
longest token at every position, a token is taken if it is compatible with the
one before it, otherwise shorter prefixes are tried; when none fits, the walk
steps back over the last token and marks the position as failed in a bit field,
so that no position is left twice and the work stays linear.

Facts of the model that the walk relies on are checked when it is loaded:
scores of mergeable pieces are distinct, and no piece has a word-start mark
after another character, runs of marks aside.  Runs of
marks (which all tie in score) are merged last and leftmost first, that is,
into blocks of the longest run the vocabulary has and a rest.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosewise.llm.common import per_batch

MARK = "▁"
NEVER = 1 << 60
#: Words up to this length are remembered, so many words, and parts of words, at most.
CACHED_CHARS, CACHED_WORDS, CACHED_PARTS = 40, 1 << 20, 1 << 18
#: Texts encoded together.
ROWS = 512


class _Memory(dict):
    """``make(key)``, remembered; forgotten all at once when ``most`` are held."""

    def __init__(self, make: Callable, most: int):
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        made = self[key] = self.make(key)
        return made


class PieceDecoder:
    """Decoder for one BPE model file with byte fallback."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.ids: dict[str, int] = {}
        self.byte_ids = [0] * 256
        self.out: list[bytes] = []
        self.names = [b"%d" % i for i in range(n)]
        self.is_byte = bytearray(n)
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value], self.is_byte[i] = i, 1
                self.out.append(bytes([value]))
            elif sp.is_control(i):
                self.out.append(b"")
            elif sp.is_unknown(i):
                self.out.append(sp.decode([i]).encode())
            else:
                if sp.is_unused(i):
                    raise ValueError("unused pieces are not supported")
                self.ids[piece] = i
                self.out.append(piece.replace(MARK, " ").encode())

    def decode(self, ids) -> str:
        """Text of the ids: one leading word-start mark goes, invalid bytes of a run each become U+FFFD."""
        parts, first = [], True
        pending = bytearray()
        for i in ids:
            if self.is_byte[i]:
                pending += self.out[i]
                continue
            if pending:
                parts.append(_lossy(pending))
                first, pending = False, bytearray()
            piece = self.out[i].decode()
            if first and piece[:1] == " ":
                piece, first = piece[1:], False
            elif piece:
                first = False
            parts.append(piece)
        if pending:
            parts.append(_lossy(pending))
        return "".join(parts)

    def text(self, ids) -> str:
        """``decode``, by the short way where that does; no ids: the empty text."""
        if not ids:
            return ""
        text = self.decode_valid(ids)
        return self.decode(ids) if text is None else text

    def decode_valid(self, ids) -> str | None:
        """``decode`` in one join for ids whose bytes are valid UTF-8, else None."""
        try:
            text = b"".join(map(self.out.__getitem__, ids)).decode()
        except UnicodeDecodeError:
            return None
        return text[1:] if len(ids) and not self.is_byte[ids[0]] and text[:1] == " " else text


class PieceCodec(PieceDecoder):
    """Encoder and decoder."""

    def __init__(self, model: bytes):
        super().__init__(model)
        sp = self.model
        runs = [len(p) for p in self.ids if p and not p.strip(MARK)]
        self.longest_run = max(runs, default=1)
        mergeable = [p for p in self.ids if len(p) > 1 and p.strip(MARK)]
        if any(MARK in p[1:] for p in mergeable) or 1 not in runs:
            raise ValueError("pieces with inner word-start marks are not supported")
        if len({sp.get_score(self.ids[MARK * k]) for k in runs if k > 1}) > 1:
            raise ValueError("runs of marks of several scores are not supported")
        self.runs = [self._merge_run(k, set(runs)) for k in range(4 * self.longest_run)]
        if any(r != self._blocks(k) for k, r in enumerate(self.runs)):
            raise ValueError("runs of marks that do not merge into blocks are not supported")
        order = sorted(mergeable, key=lambda p: -sp.get_score(self.ids[p]))
        if len({sp.get_score(self.ids[p]) for p in mergeable}) != len(mergeable):
            raise ValueError("pieces of equal score are not supported")
        self.rank = {p: r for r, p in enumerate(order)}
        tokens = {p for p in mergeable if self.merge(p) == [p]} | {p for p in self.ids if len(p) == 1}
        self.shorter = {t: next((t[:k] for k in range(len(t) - 1, 0, -1) if t[:k] in tokens), t[:1]) for t in tokens if len(t) > 1}
        self.automaton = ahocorasick.Automaton()
        for t in order:  # common pieces first: a node's children are searched in this order
            if t in self.shorter:
                self.automaton.add_word(t, t)
        self.automaton.make_automaton()
        # the longest token on each path of the automaton from its root
        self.reach = max(map(len, self.shorter), default=1)
        self.longest: dict[str, str] = {}
        for t in sorted(self.shorter, key=len):
            for k in range(2, len(t) + 1):
                self.longest.setdefault(t[:k], self.longest.get(t[: k - 1], t[:1]))
            self.longest[t] = t
        # neighbouring characters that some piece holds: no token reaches across any others
        self.inner = {pair for p in mergeable for pair in zip(p, p[1:])}
        self.right_edges = {t: self._edges(t, -1) for t in tokens}
        self.left_edges = {t: self._edges(t, 0) for t in tokens}
        self.compatible = _Memory(lambda pair: self._compatible(*pair), CACHED_PARTS).__getitem__
        self.fit = _Memory(self._fit, CACHED_PARTS).__getitem__
        self.part = _Memory(self._part, CACHED_PARTS).__getitem__
        self.word = _Memory(self._word, CACHED_WORDS).__getitem__

    def _merges(self, text: str) -> Iterator[tuple[int, list[str]]]:
        """Plain merging, step by step: the best-ranked pair, leftmost first; its rank and the parts so far."""
        parts = list(text)
        while len(parts) > 1:
            best, k = min((self.rank.get(a + b, NEVER), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
            if best == NEVER:
                return
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            yield best, parts

    def merge(self, text: str) -> list[str]:
        parts = list(text)
        for _, parts in self._merges(text):
            pass
        return parts

    def _edges(self, token: str, side: int) -> list[tuple[str, int]]:
        """The parts that stand at one end of a token while it is merged, each with the worst rank until it is replaced."""
        edges, edge, worst = [], token[side], -1
        for rank, parts in self._merges(token):
            worst = max(worst, rank)
            if parts[side] != edge:
                edges.append((edge, worst))
                edge, worst = parts[side], -1
        return [*edges, (edge, NEVER)]

    def _compatible(self, left: str, right: str) -> bool:
        """Whether ``left + right`` merges into just these two tokens.

        Replays both merges at once, in order of rank: the two stay apart
        unless the parts that meet at their border would merge before either
        of them is replaced.  On a tie the merge further left comes first.
        """
        ends, starts = self.right_edges.get(left) or [(left, NEVER)], self.left_edges.get(right) or [(right, NEVER)]
        i = j = 0
        while True:
            (a, until_a), (b, until_b) = ends[i], starts[j]
            rank = self.rank.get(a + b, NEVER)
            if rank < until_a and rank <= until_b and rank != NEVER:
                return False
            if until_a <= until_b:
                if until_a == NEVER:
                    return True
                i += 1
            else:
                j += 1

    def _fit(self, pair: tuple[str, str]) -> str | None:
        """The longest token, ``token`` or one it begins with, that is compatible with the one before."""
        last, token = pair
        while not self.compatible((last, token)):
            if len(token) == 1:
                return None
            token = self.shorter[token]
        return token

    def _longest(self, text: str) -> str:
        """The longest token that a text begins with: the automaton's longest path gives it."""
        path = self.automaton.longest_prefix(text)
        return self.longest[text[:path]] if path > 1 else text[:1]

    def tokens(self, text: str) -> list[str]:
        """The tokens of a text without runs of marks, by backtracking."""
        n, reach, fit, shorter, longest = len(text), self.reach, self.fit, self.shorter, self._longest
        failed = None
        taken: list[str] = []
        at, last, token = 0, None, longest(text[:reach])
        while True:
            if last is not None and token is not None:
                token = fit((last, token))
            while failed is not None and token is not None and failed[at + len(token) >> 3] >> (at + len(token) & 7) & 1:
                token = shorter.get(token)
                token = token if token is None or last is None else fit((last, token))
            if token is not None:
                taken.append(token)
                at += len(token)
                if at == n:
                    return taken
                last, token = token, longest(text[at : at + reach])
            else:
                # nothing fits here after the last token: never come back to this place, and try less of that token
                if failed is None:
                    failed = bytearray(n // 8 + 1)
                failed[at >> 3] |= 1 << (at & 7)
                token = taken.pop()
                at -= len(token)
                last, token = taken[-1] if taken else None, shorter.get(token)

    def _part(self, part: str) -> tuple[int, ...]:
        found = self.tokens(part) if len(part) > 1 else [part]
        try:
            return tuple([self.ids[t] for t in found])
        except KeyError:  # a character without a piece
            return tuple([self.byte_ids[b] if i is None else i for t in found for i, b in ([(self.ids[t], 0)] if t in self.ids else ((None, b) for b in t.encode()))])

    def _span(self, text: str) -> tuple[int, ...]:
        """Ids of a text without runs of marks, cut where no token can reach across."""
        inner = self.inner
        cuts = [k for k, pair in enumerate(zip(text, text[1:]), 1) if pair not in inner]
        parts = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])] if cuts else [text]
        return tuple(chain.from_iterable([self.part(p) if len(p) <= CACHED_CHARS else self._part(p) for p in parts]))

    def _word(self, word: str) -> tuple[int, ...]:
        """Ids of one word with its mark."""
        return self._part(MARK + word) if len(word) <= CACHED_CHARS else self._span(MARK + word)

    @staticmethod
    def _merge_run(n: int, known: set[int]) -> list[int]:
        """Lengths after merging ``n`` marks: every pair ties, so always the leftmost that is a piece."""
        parts = [1] * n
        while (k := next((k for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in known), -1)) >= 0:
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _blocks(self, n: int) -> list[int]:
        full, rest = divmod(n, self.longest_run)
        return [self.longest_run] * full + self.runs[rest]

    def _run(self, n: int) -> list[int]:
        return [self.ids[MARK * k] for k in self._blocks(n)]

    def encode(self, text: str) -> list[int]:
        return self._ids(self.normal(text))

    def normal(self, text: str) -> str:
        return self.model.normalize(text).replace(" ", MARK)

    def _ids(self, normal: str) -> list[int]:
        head, *words = normal.split(MARK)
        out: list[int] = list(self._span(head)) if head else []
        mark, run = self.ids[MARK], 0
        for w in words:
            if not w:
                run += 1
                continue
            ids = self.word(w) if len(w) <= CACHED_CHARS else self._word(w)
            if run:
                # a mark that stayed a token of its own belongs to the run before it
                lone = ids[0] == mark
                out += self._run(run + lone)
                out += ids[lone:]
                run = 0
            else:
                out += ids
        return out + self._run(run)


class Coded:
    """The ids of some texts: of most by their words, each different word encoded once; of those with runs of marks, or none at the start, one by one."""

    def __init__(self, codec: PieceCodec, texts: list[str]):
        normal = [codec.normal(t) if t else "" for t in texts]
        plain = [n[:1] == MARK and n[-1:] != MARK and MARK * 2 not in n for n in normal]
        self.n, self.plain = len(texts), np.flatnonzero(plain)
        self.other = {i: codec._ids(n) if n else [] for i, n in enumerate(normal) if not plain[i]}
        split = pc.split_pattern(pa.array([normal[i][1:] for i in self.plain.tolist()], pa.string()), MARK)
        words = split.flatten().dictionary_encode()
        self.at, self.word = split.offsets, words.indices
        self.pieces = [codec.word(w) if len(w) <= CACHED_CHARS else codec._word(w) for w in words.dictionary.to_pylist()]
        self.sizes = np.fromiter(map(len, self.pieces), np.int64, len(self.pieces))

    def _joined(self, of_piece: Callable[[tuple[int, ...]], bytes], by: bytes) -> Iterator[tuple[int, bytes]]:
        """``of_piece`` of a text's words, joined."""
        made = pa.array([of_piece(p) for p in self.pieces], pa.binary()).take(self.word)
        return zip(self.plain.tolist(), pc.binary_join(pa.ListArray.from_arrays(self.at, made), by).to_pylist())

    def ids(self) -> list[np.ndarray | list[int]]:
        size = self.sizes[self.word.to_numpy()]
        ends = np.cumsum(size)
        first = np.cumsum(self.sizes) - self.sizes
        flat = np.fromiter(chain.from_iterable(self.pieces), np.int32, int(self.sizes.sum()))
        all_ids = flat[np.repeat(first[self.word.to_numpy()] - (ends - size), size) + np.arange(int(size.sum()))]
        out: list = [self.other.get(i) for i in range(self.n)]
        for i, ids in zip(self.plain.tolist(), np.split(all_ids, np.append(0, ends)[self.at.to_numpy()[1:-1]])):
            out[i] = ids
        return out

    def digests(self, decoder: PieceDecoder) -> list[tuple[int, str, str]]:
        """Number of ids, SHA-256 of the decimal ids joined by commas, SHA-256 of the decoded text."""
        names, sha = decoder.names, lambda b: hashlib.sha256(b).hexdigest()
        out: list = [None] * self.n
        for i, ids in self.other.items():
            out[i] = (len(ids), sha(b",".join([names[k] for k in ids])), sha(decoder.text(ids).encode()))
        at, word = self.at.to_numpy(), self.word.to_numpy()
        ends = np.append(0, np.cumsum(self.sizes[word]))
        listed = self._joined(lambda p: b",".join([names[k] for k in p]), b",")
        decoded = self._joined(lambda p: b"".join([decoder.out[k] for k in p]), b"")
        for j, ((i, ids), (_, text)) in enumerate(zip(listed, decoded)):
            own = self.pieces[word[at[j]]]  # of the text's first word
            try:
                text.decode()
                text = text[1:] if not decoder.is_byte[own[0]] and text[:1] == b" " else text
            except UnicodeDecodeError:
                text = decoder.decode([k for w in word[at[j] : at[j + 1]].tolist() for k in self.pieces[w]]).encode()
            out[i] = (int(ends[at[j + 1]] - ends[at[j]]), sha(ids), sha(text))
        return out


_BAD = re.compile("[\udc80-\udcff]")


def _lossy(data: bytes) -> str:
    return _BAD.sub("�", bytes(data).decode("utf-8", "surrogateescape"))


@functools.lru_cache(2)
def codec(model: bytes, kind: type[PieceDecoder] = PieceCodec) -> PieceDecoder:
    """One codec per Python worker."""
    return kind(model)


def _model(df: DataFrame, model_path: str):
    """The model's bytes, read on the driver: one vocabulary file, a few hundred kB."""
    with open(model_path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _mapped(df: DataFrame, source: str, targets: dict[str, tuple[pa.DataType, str]], work, drop: bool = False) -> DataFrame:
    """Append the columns ``targets``, computed from ``source`` for some rows at a time; other columns pass through as they are, ``source`` too unless ``drop``."""
    rest = [c for c in df.columns if c not in targets]
    stay = [c for c in rest if c != source or not drop]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in stay), *(f"`{c}` {sql}" for c, (_, sql) in targets.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        do = work()
        gc.disable()  # the remembered words make no cycles, and walking them again and again is slow
        try:
            for batch in batches:
                for k in range(0, batch.num_rows, ROWS):
                    part = batch.slice(k, ROWS)
                    made = zip(*do(part.column(source).to_pylist()))
                    columns = [pa.array(values, kind) for values, (kind, _) in zip(made, targets.values())]
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in stay), *columns], names=[*stay, *targets])
        finally:
            gc.enable()

    return per_batch(df.select(*(F.col(f"`{c}`") for c in rest)), run, schema)


def encode(docs: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Append ``ids array<int>``: the exact ids of the whole text, without begin and end ids.

    A null or empty text gives an empty array.  All other columns pass
    through; a column already named ``ids_col`` is replaced.
    """
    model = _model(docs, model_path)

    def work():
        c = codec(model.value)
        return lambda texts: [(ids,) for ids in Coded(c, texts).ids()]

    return _mapped(docs, text_col, {ids_col: (pa.list_(pa.int32()), "array<int>")}, work)


def decode(encoded: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Append ``decoded string``: the text of the ids (null ids: empty text)."""
    model = _model(encoded, model_path)

    def work():
        c = codec(model.value, PieceDecoder)
        return lambda rows: [(c.text(ids),) for ids in rows]

    return _mapped(encoded, ids_col, {text_col: (pa.string(), "string")}, work)


def digests(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """Encode every whole text, decode the ids, and put digests of both in the text's place.

    ``n_tokens`` (all ids), ``ids_sha256`` (of the decimal ids, comma-joined)
    and ``decoded_sha256`` (of the decoded text): what ``encode`` and
    ``decode`` give, without moving ids and texts out of the task.
    """
    model = _model(docs, model_path)

    def work():
        c = codec(model.value)
        return lambda texts: Coded(c, texts).digests(c)

    kinds = {"n_tokens": (pa.int64(), "bigint"), "ids_sha256": (pa.string(), "string"), "decoded_sha256": (pa.string(), "string")}
    return _mapped(docs, text_col, kinds, work, drop=True)
