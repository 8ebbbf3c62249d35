"""SentencePiece encoding and decoding as weighted finite-state transduction.

Three transducers are compiled from a model file:

* the normaliser (normaliser.py) applies the model's character rewrites, removes extra white space if the model says so, rewrites a
  space to the mark U+2581 and puts one in front;
* the lexicon, a trie of the pieces' characters, reads a piece and writes its number; a character that is no piece
  is read by the byte fallback, which writes the pieces of its UTF-8 bytes;
* the grammar weighs sequences of pieces. For a unigram model it has one state and each piece costs its negative score.
  For a BPE model its states are the last piece read, with an arc to each piece that byte-pair merging would leave
  beside it, each at cost 1; other arcs have infinite weight. Merging never joins across a pair that it leaves
  alone, so one path has finite weight, and it is what merging in order of score gives.

Composition with an input is lazy: the input is an acyclic acceptor, so the shortest path in the tropical semiring
(sum along a path, minimum over paths) is found in order of position. Arcs of the grammar are compiled
when first met and kept.

No piece of a BPE model that splits at white space goes on with a mark after another character, so the lattice of a text
falls into parts of one word at a state with a single path through it; shortest paths of words are kept, up to a bound.
A unigram model's lattice is that of the whole text: paths of equal cost are told apart by the rounding of their sums.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barspark.llm.normaliser import MARK, Normaliser, rewrites_of
from barspark.llm.storage import documents

#: Entries of a worker's caches; a full cache makes room, which costs time but changes nothing.
MOST_WORDS, MOST_PAIRS, LONGEST_WORD = 300_000, 500_000, 48
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
#: Types of pieces and of models, as the public protocol buffer numbers them.
_UNIGRAM, _BPE = 1, 2


@dataclass
class PieceModel:
    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    bpe: bool
    dummy_prefix: bool
    shorten: bool = False
    rewrites: dict[str, str] = field(default_factory=dict)


def load_model(path: str) -> PieceModel:
    """Reads a model file: unigram or BPE, with any normaliser that writes white space as marks in front of words."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    if not proto.normalizer_spec.escape_whitespaces:
        raise ValueError("only models that escape white space are compiled")
    if proto.trainer_spec.model_type not in (_UNIGRAM, _BPE) or proto.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("only unigram and BPE models with white space in front are compiled")
    if proto.trainer_spec.model_type == _BPE and any(p.type == _UNUSED for p in proto.pieces):
        raise ValueError("BPE models with unused pieces are not compiled")
    return PieceModel(
        [p.piece for p in proto.pieces],
        [p.score for p in proto.pieces],
        [p.type for p in proto.pieces],
        proto.trainer_spec.model_type == _BPE,
        proto.normalizer_spec.add_dummy_prefix,
        proto.normalizer_spec.remove_extra_whitespaces,
        rewrites_of(proto.normalizer_spec.precompiled_charsmap),
    )


def public_model_path(name: str = "piece_bpe_32k.model") -> str:
    """Where the box keeps the public vocabulary file of that name."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Transducer:
    """The compiled transducers of a model, with the caches of their lazy composition."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.ids = {p: k for k, (p, kind) in enumerate(zip(model.pieces, model.kinds, strict=True)) if kind in (_NORMAL, _USER)}
        # Symbols of the user are read whole: they cost less than any other way, and merging does not touch them.
        users = sorted((p for p, kind in zip(model.pieces, model.kinds, strict=True) if kind == _USER), key=len, reverse=True)
        self.normalised = Normaliser(model.rewrites, frozenset(users), model.dummy_prefix, model.shorten)
        self.frozen = re.compile("(" + "|".join(map(re.escape, users)) + ")") if users and model.bpe else None
        self.bytes = {int(p[3:5], 16): k for k, (p, kind) in enumerate(zip(model.pieces, model.kinds, strict=True)) if kind == _BYTE}
        self.unknown = next((k for k, kind in enumerate(model.kinds) if kind == _UNKNOWN), 0)
        # The lexicon: prefix -> can be continued.
        self.prefixes = {p[:n] for p in self.ids for n in range(1, len(p))}
        self.costs = {p: -model.scores[k] for p, k in self.ids.items()}
        usual = [-s for s, kind in zip(model.scores, model.kinds, strict=True) if kind == _NORMAL]
        self.fallback_cost = float(np.float32(max(usual, default=0.0) + 10.0))
        if not model.bpe:
            self.costs |= {p: float(np.float32(min(usual, default=0.0) * len(p.encode()))) + 0.1 for p in users}
        self.sound: dict[str, bool] = {}
        self.halves: dict[str, tuple[str, str]] = {}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # Arcs of the grammar by numbers of pieces, -1 at the start; the same as pairs, for words all of known pieces.
        self.arcs: dict[int, bool] = {}
        self.raw = [np.array([k], "<i4").tobytes() for k in range(len(model.pieces))]
        # The longest piece that ends with these four characters.
        self.reach: dict[str, int] = {}
        for p in self.ids:
            if len(p) > 3:
                self.reach[p[-4:]] = max(len(p), self.reach.get(p[-4:], 3))
        letters = {c for p in self.ids for c in p}
        inner = any(MARK in p.lstrip(MARK) for p in self.ids)
        alone = "".join(c for c in "\n\r\t" if c not in letters)
        self.parts = None if inner or not model.bpe else re.compile(rf"[{re.escape(alone)}]|{MARK}*[^{MARK}{re.escape(alone)}]+|{MARK}+" if alone else rf"{MARK}*[^{MARK}]+|{MARK}+")
        # What a piece decodes to: bytes, so that byte pieces join with others.
        self.decoded = [b"" if kind in (_CONTROL,) else (bytes([int(p[3:5], 16)]) if kind == _BYTE else p.replace(MARK, " ").encode()) for p, kind in zip(model.pieces, model.kinds, strict=True)]
        self.decoded[self.unknown] = " ⁇ ".encode()

    def _merged(self, text: str) -> list[str]:
        """Merging of neighbours in order of score, leftmost first among equals; compiles arcs of the grammar."""
        symbols = list(text)
        while len(symbols) > 1:
            best, at = None, -1
            for k in range(len(symbols) - 1):
                cost = self.costs.get(symbols[k] + symbols[k + 1])
                if cost is not None and (best is None or cost < best):
                    best, at = cost, k
            if best is None:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def _halves(self, piece: str) -> tuple[str, str]:
        """The two symbols that merging joins last to a piece."""
        known = self.halves.get(piece)
        if known is None:
            symbols = list(piece)
            while len(symbols) > 2:
                costs = [self.costs.get(a + b, float("inf")) for a, b in zip(symbols, symbols[1:], strict=False)]
                at = min(range(len(costs)), key=costs.__getitem__)
                if costs[at] == float("inf"):
                    break
                symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            known = self.halves[piece] = (symbols[0], symbols[-1])
        return known

    def _arc(self, left: str, right: str) -> bool:
        """Whether merging leaves left and right beside each other.

        Both are taken apart again in reverse order of their merges; at each step the symbols at the boundary
        would have joined first if their join costs less than the merge just undone. Of equal costs the left comes first.
        """
        if MARK * 2 in left + right:  # runs of marks share one cost, so that the order of their merges is not that of costs
            return self._merged(left + right) == [left, right]
        costs = self.costs
        a, b = (costs[left] if len(left) > 1 else -1.0), (costs[right] if len(right) > 1 else -1.0)
        limit, strict = float("inf"), True
        while True:
            joined = costs.get(left + right)
            if joined is not None and (joined < limit or (joined == limit and not strict)):
                return False
            if len(left) == 1 and len(right) == 1:
                return True
            if a > b:
                limit, strict = a, True
                left = self._halves(left)[1]
                a = costs[left] if len(left) > 1 else -1.0
            else:
                limit, strict = b, False
                right = self._halves(right)[0]
                b = costs[right] if len(right) > 1 else -1.0

    def allowed(self, left: str, right: str) -> bool:
        """Whether the grammar has an arc for right after left (empty at the start)."""
        if not left:
            known = self.sound.get(right)
            if known is None:
                known = self.sound[right] = self._merged(right) == [right]
            return known
        return self.allowed("", left) and self.allowed("", right) and self._arc(left, right)

    def _arcs(self, text: str, i: int) -> list[str]:
        """What the lexicon and the fallback read from position i, longest first."""
        out, prefixes, ids = [text[i]], self.prefixes, self.ids
        j, n = i + 1, len(text)
        while j < n and text[i:j] in prefixes:
            j += 1
            if text[i:j] in ids:
                out.append(text[i:j])
        return out[::-1]

    def shortest(self, text: str) -> list[str]:
        """Pieces on the shortest path of the composition with a normalised text."""
        return self._only_path(text) if self.model.bpe else self._least_cost(text)

    def _only_path(self, text: str) -> list[str]:
        """BPE: one path has finite weight, so the first one that reaches the end is the shortest.

        Arcs are followed longest first; a state (position, last piece) from which the end is out of reach is left for good.
        """
        n, path, open_arcs, dead = len(text), [], [], set()
        at, last = 0, ""
        arcs = iter(self._arcs(text, 0)) if n else iter(())
        while at < n:
            for piece in arcs:
                if self.allowed(last, piece) and (at + len(piece), piece) not in dead:
                    path.append(piece)
                    open_arcs.append(arcs)
                    at, last = at + len(piece), piece
                    if at < n:
                        arcs = iter(self._arcs(text, at))
                    break
            else:
                dead.add((at, last))
                at -= len(path.pop())
                last = path[-1] if path else ""
                arcs = open_arcs.pop()
        return path

    def _least_cost(self, text: str) -> list[str]:
        """Unigram: arcs relaxed in order of position, one state a position. Sums are single floats, whose rounding decides between equal paths."""
        n = len(text)
        best: list[tuple[float, int]] = [(0.0, 0)] + [(float("inf"), 0)] * n
        for i in range(n):
            cost = best[i][0]
            for piece in self._arcs(text, i):
                weight = float(np.float32(cost + self.costs.get(piece, self.fallback_cost)))
                if weight < best[i + len(piece)][0]:
                    best[i + len(piece)] = (weight, i)
        out, at = [], n
        while at:
            out.append(text[best[at][1] : at])
            at = best[at][1]
        return out[::-1]

    def _numbers(self, piece: str) -> list[int]:
        if (k := self.ids.get(piece)) is not None:
            return [k]
        if not self.bytes:
            return [self.unknown]
        return [self.bytes[b] for b in piece.encode()]

    def _straight(self, word: str) -> bytes | None:
        """BPE, for words of known pieces: states in order of position; None if a character is no piece.

        Every prefix of a word has one path of finite weight as well, so a position has one state, its last piece: the one piece that
        ends there which the grammar allows after the state of the position where it starts.
        """
        n = len(word)
        codes, reach, arcs = self.ids, self.reach, self.arcs
        states, starts = [-1] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            low = end - reach.get(word[end - 4 : end], 3) if end > 3 else 0
            for start in range(low if low > 0 else 0, end):
                piece = codes.get(word[start:end])
                if piece is None:
                    continue
                last = states[start]
                key = last * 1_000_003 + piece
                known = arcs.get(key)
                if known is None:
                    if len(arcs) >= MOST_PAIRS:
                        arcs.clear()
                    known = arcs[key] = self.allowed(self.model.pieces[last] if last >= 0 else "", word[start:end])
                if known:
                    states[end], starts[end] = piece, start
                    break
            else:
                return None
        out, raw = [], self.raw
        while n:
            out.append(raw[states[n]])
            n = starts[n]
        return b"".join(out[::-1])

    def _word(self, word: str) -> bytes:
        out = self.older.get(word)
        if out is None:
            out = self._straight(word) if self.model.bpe else None
        if out is None:
            numbers = [k for piece in self.shortest(word) for k in self._numbers(piece)]
            out = np.array(numbers, "<i4").tobytes()
        if len(word) <= LONGEST_WORD:
            if len(self.words) >= MOST_WORDS:
                # Two generations: words still in use come back from the older one.
                self.older, self.words = self.words, {}
            self.words[word] = out
        return out

    def encode_bytes(self, text: str | None) -> bytes:
        """The numbers of a text's pieces as little-endian 32-bit integers."""
        text = self.normalised(text or "")
        words = self.words
        if self.frozen:
            # A group in the pattern makes every second part a symbol of the user.
            frozen = self.frozen.split(text)
            return self._joined([self.raw[self.ids[part]] if k % 2 else words.get(w) or self._word(w) for k, part in enumerate(frozen) for w in ([part] if k % 2 else self._words_of(part))])
        return self._joined([words.get(w) or self._word(w) for w in self._words_of(text)])

    def _words_of(self, text: str) -> list[str]:
        return self.parts.findall(text) if self.parts else [text] if text else []

    def _joined(self, out: list[bytes]) -> bytes:
        """All numbers in a row; without byte pieces, unknown characters beside each other are one unknown piece."""
        data = b"".join(out)
        if self.bytes:
            return data
        numbers = np.frombuffer(data, "<i4")
        again = (numbers[1:] == self.unknown) & (numbers[:-1] == self.unknown)
        return numbers[np.concatenate(([True], ~again))].tobytes() if len(numbers) else data

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<i4").tolist()

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """The text of a sequence of pieces: marks become spaces, the one put in front goes, broken UTF-8 is replaced."""
        table = self.decoded
        parts = [table[k] for k in (ids.tolist() if isinstance(ids, np.ndarray) else ids)]
        if self.model.dummy_prefix or self.model.shorten:
            # Of the pieces in front, one mark each goes, up to the first that leaves something; without shortening the first piece alone.
            for k, part in enumerate(parts):
                if part.startswith(b" ") and part is not table[self.unknown]:
                    parts[k] = part[1:]
                if parts[k] or not self.model.shorten:
                    break
        return b"".join(parts).decode("utf-8", "replace")


_COMPILED: dict[int, Transducer] = {}


def _compiled(model: PieceModel) -> Transducer:
    """One transducer a worker process, so that its caches outlast a task."""
    if id(model) not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[id(model)] = Transducer(model)
    return _COMPILED[id(model)]


def encoded(docs: DataFrame, model: PieceModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all but text) with ids: array<int>, n_tokens, decoded_matches and ids_sha256.

    A null or empty text has no pieces. decoded_matches says whether decoding gives the text back; a text that holds the
    mark U+2581 itself does not come back, as the mark reads as a space. Rows are independent: nothing is shuffled, and repeated rows have
    equal results. A kept column with the name of a result gives way to it.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (text, "ids", "n_tokens", "decoded_matches", "ids_sha256")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _compiled(shared.value)
        for batch in batches:
            column = batch.column(text)
            n = batch.num_rows
            low = 0
            while low < n:
                ids, same, digests, size, high = [], [], [], 0, low
                # Bounded pieces of a batch, whatever the length of its texts.
                while high < n and size < 1 << 22:
                    value = column[high].as_py() or ""
                    data = machine.encode_bytes(value)
                    numbers = np.frombuffer(data, "<i4")
                    ids.append(numbers)
                    same.append(machine.decode(numbers) == value)
                    digests.append(hashlib.sha256(data).hexdigest())
                    size += len(data)
                    high += 1
                lengths = [len(x) for x in ids]
                offsets = pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids).astype(np.int32)))
                rest = [batch.column(c).slice(low, high - low) for c in keep]
                yield pa.RecordBatch.from_arrays([*rest, lists, pa.array(lengths, pa.int64()), pa.array(same), pa.array(digests)], [*keep, "ids", "n_tokens", "decoded_matches", "ids_sha256"])
                low = high

    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([f"`{c}` {fields[c]}" for c in keep] + ["ids array<int>", "n_tokens long", "decoded_matches boolean", "ids_sha256 string"])
    return docs.select(*keep, text).mapInArrow(run, schema)


def op2_piece_transducer(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, decoded_matches and ids_sha256 (of the ids as little-endian 32-bit integers) of every text."""
    model = load_model(model_path or public_model_path())
    return encoded(documents(spark, sf_dir), model, keep=["doc_id"]).select("doc_id", "n_tokens", "decoded_matches", "ids_sha256")


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars (as far as docs has them), ids and n_tokens of every document.

    A null or empty text has no ids; repeated rows stay as many as they are; an empty table gives an empty result; other columns go.
    """
    model = load_model(public_model_path())
    keep = [c for c in ("doc_id", "lang", "source", "n_chars") if c in docs.columns]
    return encoded(docs, model, keep=keep).select(*keep, "ids", "n_tokens")
