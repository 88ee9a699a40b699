"""SentencePiece encoding and decoding by a streaming Viterbi search.

The text is read left to right over a lattice of pieces. Every boundary keeps one back pointer, to the start of the
piece that ends there on the best path. A boundary survives while the text from it on is the beginning of some piece, so
only the last `longest` boundaries (the longest piece's characters) can. Whenever the paths of all survivors meet in one
boundary, the ids up to it are committed and the lattice before it is dropped: memory is bounded by the window, not by
the text. While the window is shorter than the longest piece its first boundary may survive; so the meeting is looked
for at every character from there on, and at every place where a character cannot stand after another inside any piece (a space
mark after a letter, a line end, punctuation that no piece holds there): no path can cross it, so all end in it.

Which path is best depends on the kind of model. A unigram model maximises the sum of scores. A BPE model (merges by
score, leftmost first) has no additive score, but its result is local: a sequence of pieces is the encoding of a text
if and only if each piece is its own encoding after its left neighbour, that is, if encoding the two joined gives the
same two. So every boundary has exactly one valid incoming piece, and the same search finds it with that test
(remembered per pair) in the place of the sum.

What a further character does to the survivors depends on their texts and on the pieces that end in them alone. That is a state of the search; the state that follows
it after a character is worked out once and remembered with it, so most characters cost one look-up. Paths, meetings and commitments are those of each text.

What is committed between two places that no piece crosses depends on the characters between them alone; it is remembered by them.

Null and empty texts have no ids. Decoding gives back every text that holds no U+2581 (which stands for the space,
and decodes to it). Long texts are read whole, whatever their length or that of a word. Repeated rows are encoded alike,
each on its own; there are no ties: of equal sums the longest last piece wins. Extra columns are not read. An empty
table gives an empty result.
"""

from __future__ import annotations

import re
import string
import struct
from collections.abc import Iterable, Iterator
from itertools import accumulate, chain, islice
from operator import attrgetter, getitem

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Remembered runs, pairs and states a worker; beyond, they are forgotten and computed again.
REMEMBERED = 250_000
#: Ids in an output batch.
BATCH_IDS = 2_000_000
#: Runs of a text whose ids are held apart before they are joined.
RUNS_AT_ONCE = 65_536


def _fields(buf: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol-buffers message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = buf[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(buf):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, buf[at : at + n]
            at += n


class PieceModel:
    """A model file: pieces, scores, kinds and the normaliser's switches."""

    def __init__(self, data: bytes) -> None:
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.bpe, self.prefix, self.squeeze, self.normaliser = False, True, True, ""
        for number, value in _fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for k, v in _fields(value):
                    if k == 1:
                        piece = v.decode("utf-8")
                    elif k == 2:
                        score = struct.unpack("<f", v)[0]
                    elif k == 3:
                        kind = v
                self.pieces.append(piece)
                self.scores.append(score)
                self.kinds.append(kind)
            elif number == 2:
                self.bpe = dict(_fields(value)).get(3, 1) == 2
            elif number == 3:
                spec = dict(_fields(value))
                self.normaliser = (spec.get(1) or b"").decode()
                self.prefix, self.squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
        if self.normaliser != "identity" or self.squeeze:
            raise ValueError("only models that leave the text as it is (identity, white space kept) can be decoded exactly")
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k in (NORMAL, USER)}
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.unknown = self.kinds.index(UNKNOWN)
        self.longest = max(map(len, self.ids))
        self.lowest = min(self.scores)
        inner = [p for p in self.ids if len(p) > 1]
        used = set("".join(inner))
        self.breaks = "".join(c for c in "\n\t\r\v\f" if c not in used)
        prefixes = {p[:k] for p in inner for k in range(1, len(p))}
        #: Each piece of several characters and each beginning of one: itself, whether it is a piece, whether a piece goes on from it.
        self.grown = {p: (p, p in self.ids and len(p) > 1, p in prefixes) for p in prefixes.union(inner)}
        #: Punctuation that no piece holds after a letter or digit: another place where all paths meet.
        after = {p[i] for p in inner for i in range(1, len(p)) if p[i - 1].isalnum()}
        self.stops = "".join(c for c in string.punctuation if c not in after)
        self.worth = {p: self.scores[k] for p, k in self.ids.items()}
        self.marks_lead = all(MARK not in p.lstrip(MARK) for p in inner)
        self.bytes_of = [
            bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else b" \xe2\x81\x87 " if k == UNKNOWN else p.replace(MARK, " ").encode("utf-8")
            for p, k in zip(self.pieces, self.kinds, strict=True)
        ]

    def score(self, piece: str) -> float:
        k = self.ids.get(piece)
        return self.lowest - 10 if k is None else self.scores[k]

    @classmethod
    def load(cls, path: str = MODEL_PATH) -> PieceModel:
        with open(path, "rb") as f:
            return cls(f.read())


class _State(dict):
    """A state of the search: the texts from the survivors on (longest first, the last boundary's is empty), the piece that ends in each, and the pieces that may end in
    the last boundary (`piece`: the only one, of a BPE model, and its ids; `ends`: all, shortest first, of a unigram model). It holds the states that followed it, by character."""

    __slots__ = ("ends", "ids", "lefts", "piece", "search", "starts")

    def __init__(self, search: Encoder, starts: tuple[str, ...] = ("",), lefts: tuple[str, ...] = ("",), piece: str = "", ends: tuple[str, ...] = ()) -> None:
        self.search, self.starts, self.lefts, self.piece, self.ends = search, starts, lefts, piece, ends
        self.ids = search.ids_of_piece(piece) if piece else b""

    def __missing__(self, c: str) -> _State:
        state = self[c] = self.search.following(self, c)
        return state


class Encoder:
    def __init__(self, model: PieceModel) -> None:
        self.m = model
        self._pairs: dict[tuple[str, str], bool] = {}
        self._alone: dict[str, list[tuple[float, str, str]] | None] = {}
        self._states: dict[tuple, _State] = {}
        self._followed = 0  # remembered steps from state to state
        self._start = _State(self)
        self._ids = {p: np.int32(k).tobytes() for p, k in model.ids.items()}
        self._runs = _Runs(self)
        #: Meetings of all paths found so far, and the most characters that a window held.
        self.commits = self.widest = 0
        mark = MARK if model.marks_lead else ""
        stop, punct = re.escape(model.breaks), re.escape(model.stops)
        # a run: marks, a character, then all up to a mark, a line end or punctuation right after a letter or digit
        other = f"[^{mark}{stop}{punct}]"
        self._split = re.compile(rf"{mark}*[^{mark}{stop}](?:{other}+|(?<![^\W_])[{punct}]+)*|{mark}+|[{stop}]" if mark and stop and punct else r"(?s).+")

    # BPE -----------------------------------------------------------------------------------------------
    def _merged(self, text: str, seen: list[tuple[float, str, str]] | None = None) -> list[str]:
        """The defining procedure: merge the best pair, leftmost first, until none is left. `seen` gets each step's score and the first and last part before it."""
        worth, parts = self.m.worth.get, list(text)
        gains = [worth(a + b, -np.inf) for a, b in zip(parts, parts[1:], strict=False)]
        while gains and (best := max(gains)) > -np.inf:
            at = gains.index(best)
            if seen is not None:
                seen.append((best, parts[0], parts[-1]))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del gains[at]
            if at:
                gains[at - 1] = worth(parts[at - 1] + parts[at], -np.inf)
            if at < len(gains):
                gains[at] = worth(parts[at] + parts[at + 1], -np.inf)
        return parts

    def _steps(self, piece: str) -> list[tuple[float, str, str]] | None:
        """The merges of a piece alone, then one that is never made; None if it is not its own encoding."""
        steps = self._alone.get(piece, 0)
        if steps == 0:
            if len(self._alone) >= REMEMBERED:
                self._alone.clear()
            steps = []
            steps = self._alone[piece] = [*steps, (-np.inf, piece, piece)] if self._merged(piece, steps) == [piece] else None
        return steps

    def _apart(self, left: str, right: str) -> bool:
        """Whether the merges of the two joined are those of each alone: no pair across them is ever better than both sides' next (or as good, and not left of it)."""
        one, two, worth = self._steps(left), self._steps(right), self.m.worth.get
        if one is None or two is None:
            return False
        i = j = 0
        while True:
            (x, _, end), (y, begin, _) = one[i], two[j]
            across = worth(end + begin, -np.inf)
            if across > x and across >= y:
                return False
            if x >= y:
                if x == -np.inf:
                    return True
                i += 1
            else:
                j += 1

    def _fits(self, left: str, right: str) -> bool:
        known = self._pairs.get((left, right))
        if known is None:
            if len(self._pairs) >= REMEMBERED:
                self._pairs.clear()
            known = self._pairs[left, right] = self._apart(left, right) if left else self._steps(right) is not None
        return known

    # the search ----------------------------------------------------------------------------------------
    def following(self, state: _State, c: str) -> _State:
        """The state after one more character."""
        if len(self._states) >= REMEMBERED or self._followed >= 2 * REMEMBERED:
            self._forget_states()
        self._followed += 1
        bpe, grown = self.m.bpe, self.m.grown
        starts, lefts, ends = [], [], []
        for start, left in zip(state.starts, state.lefts, strict=True):
            known = grown.get(start + c)
            if known is not None:
                text, whole, goes_on = known
                if whole and not (bpe and (ends or not self._fits(left, text))):
                    ends.append(text)
                if goes_on:
                    starts.append(text)
                    lefts.append(left)
        if not (bpe and ends):  # else the prefix's encoding ends in its last character
            ends.append(c)
        starts.append("")
        lefts.append(ends[0] if bpe else "")
        key = starts[0], tuple(lefts), () if bpe else tuple(reversed(ends))
        found = self._states.get(key)
        if found is None:
            found = self._states[key] = _State(self, tuple(starts), key[1], lefts[-1], key[2])
        return found

    def lots(self, chars: Iterable[str]) -> Iterator[list[str]]:
        """Pieces of a stream of characters, in the lots in which they are committed: no later character can change them."""
        m, longest, chars = self.m, self.m.longest, iter(chars)
        piece, total = [""], [0.0]  # of each boundary from the last committed one on: the piece that ends there, and its path's score
        state, n = self._start, 0
        while True:
            room = max(longest - n, 1)  # nothing can be committed before the window is full
            states = list(accumulate(islice(chars, room), getitem, initial=state))
            state, came = states[-1], len(states) - 1
            if m.bpe:
                piece.extend(islice(map(attrgetter("piece"), states), 1, None))
            else:
                for s in islice(states, 1, None):
                    n, best, chosen = len(piece), -np.inf, ""
                    for p in s.ends:
                        if (x := total[n - len(p)] + m.score(p)) >= best:
                            chosen, best = p, x
                    piece.append(chosen)
                    total.append(best)
            n = len(piece) - 1
            if came < room:
                break
            if done := self._meeting(state, piece, n):
                yield self._commit(piece, done, n)
                n -= done
                del piece[:done], total[:done]
        yield self._commit(piece, n, n)  # the end: all paths meet

    def _meeting(self, state: _State, piece: list[str], n: int) -> int:
        """The last boundary that lies on the paths of all survivors."""
        at = n  # the only boundary that survives always
        for start in state.starts:
            x = n - len(start)
            while x != at:
                if x > at:
                    x -= len(piece[x])
                else:
                    at -= len(piece[at])
        return at

    def _commit(self, piece: list[str], upto: int, n: int) -> list[str]:
        self.commits += 1
        self.widest = max(self.widest, n)
        out = []
        while upto:
            out.append(piece[upto])
            upto -= len(piece[upto])
        out.reverse()
        return out

    def pieces_of(self, chars: Iterable[str]) -> Iterator[str]:
        return chain.from_iterable(self.lots(chars))

    def ids_of_run(self, run: str) -> bytes:
        """The ids as int32, one after the other."""
        if not self.m.bpe or len(run) >= self.m.longest:
            return b"".join(map(self.ids_of_piece, self.pieces_of(run)))
        # as in `lots`, where the window is never full: all paths meet at the end
        states, upto, out = list(accumulate(run, getitem, initial=self._start)), len(run), []
        self.commits += 1
        self.widest = max(self.widest, upto)
        while upto:
            state = states[upto]
            out.append(state.ids)
            upto -= len(state.piece)
        out.reverse()
        return b"".join(out)

    def ids_of_piece(self, piece: str) -> bytes:
        ids = self._ids.get(piece)
        if ids is None:  # a character that is no piece
            known = self.m.byte_ids
            ids = np.array([known[b] for b in piece.encode("utf-8", "surrogatepass")] if known else [self.m.unknown], dtype=np.int32).tobytes()
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype=np.int32)
        text = (MARK if self.m.prefix else "") + text.replace(" ", MARK)
        out, runs = bytearray(), map(self._runs.__getitem__, map(re.Match.group, self._split.finditer(text)))
        while some := b"".join(islice(runs, RUNS_AT_ONCE)):
            out += some
        return np.frombuffer(out, dtype=np.int32)

    def forget(self) -> None:
        """Drops the remembered runs and states: the worker may live on, for other work."""
        self._runs.clear()
        self._runs.before = {}
        self._forget_states()

    def _forget_states(self) -> None:
        for state in self._states.values():
            state.clear()  # they hold one another
        self._states.clear()
        self._start.clear()
        self._followed = 0

    def decode(self, ids: Iterable[int]) -> str:
        raw = b"".join(map(self.m.bytes_of.__getitem__, ids))
        return (raw[1:] if self.m.prefix and raw[:1] == b" " else raw).decode("utf-8", "replace")


class _Runs(dict):
    """Ids, as int32 bytes, of runs (characters between two places that no piece crosses) already searched. Once it is full, it starts anew and keeps what is asked for again."""

    def __init__(self, encoder: Encoder) -> None:
        super().__init__()
        self.encoder, self.before = encoder, {}

    def __missing__(self, run: str) -> bytes:
        ids = self.before.get(run)
        if ids is None:
            ids = self.encoder.ids_of_run(run)
        if len(run) <= 48:
            if len(self) >= REMEMBERED:
                self.before = dict(self)
                self.clear()
            self[run] = ids
        return ids


_LOADED: dict[str, Encoder] = {}


def encoder(path: str = MODEL_PATH) -> Encoder:
    """This process's encoder of a model file. The file must be on every executor; its path is a parameter."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(PieceModel.load(path))
    return _LOADED[path]


def encoded(docs: DataFrame, path: str = MODEL_PATH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids, round_trip (the decoded ids are the text; null text: true) of each whole text."""
    id_type = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            names, texts = batch.column(0), batch.column(1)
            at, ids, same, held = 0, [], [], 0

            def flush(upto: int, names=names) -> pa.RecordBatch:
                lengths = np.array([len(x) for x in ids], dtype=np.int64)
                offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                return pa.record_batch([names.slice(at, upto - at), pa.array(lengths), lists, pa.array(same)], names=["doc_id", "n_tokens", "ids", "round_trip"])

            for i, text in enumerate(texts):
                text = text.as_py()
                x = enc.encode(text)
                ids.append(x)
                same.append(enc.decode(x.tolist()) == (text or ""))
                held += len(x)
                if held >= BATCH_IDS:
                    yield flush(i + 1)
                    at, ids, same, held = i + 1, [], [], 0
            if ids:
                yield flush(len(texts))
        enc.forget()

    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, f"doc_id {id_type.simpleString()}, n_tokens long, ids array<int>, round_trip boolean")


def decoded(tokens: DataFrame, path: str = MODEL_PATH) -> DataFrame:
    """doc_id, text: the texts of encoded rows (doc_id, ids); null ids give a null text."""
    id_type = tokens.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            texts = [None if x is None else enc.decode(x) for x in (v.as_py() for v in batch.column(1))]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {id_type.simpleString()}, text string")
