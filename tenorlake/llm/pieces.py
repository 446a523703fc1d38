"""SentencePiece encoding and decoding by a streaming lattice (Viterbi) search.

The search walks over the characters and keeps, for every boundary in a window
as wide as the longest piece, the surviving backpointer: the piece that ends
there and the boundary where it starts. As soon as the paths of all boundaries
in the window lead through one boundary, the ids before it are committed and
forgotten, so the search's memory doesn't grow with the text.

The given vocabulary is a byte-pair one, whose ids a search for the largest sum
of scores would not give. But its encoding has local structure that the same
lattice can use: a sequence of pieces is the encoding of a text if, and only
if, each piece and each two neighbours are the encoding of their own text. So
exactly one backpointer survives at each boundary: the piece that agrees with
the piece before it. For unigram vocabularies the survivor is the best sum; of
equal sums the one with the longer last piece.

No piece has a space mark after another character; hence all paths meet where a
space begins and ids are committed there. So a batch of texts is cut at these
boundaries, its distinct segments go through the search side by side (a
``Lattice``: numpy steps over one character of every segment), and ids are
gathered by index. Segments searched lately are remembered, ``KNOWN`` of them.

Defined results: null texts have null ids; empty texts have no ids; characters
outside the vocabulary become byte pieces; equal texts have equal ids, repeated
rows stay. Decoding gives the text back exactly, but for U+2581, which is the
vocabulary's own space mark and comes back as a space. Very long texts are
searched in the same window; only a text and its ids are held whole. Of other
columns called like the result the result stays. Empty tables give empty ones.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenorlake.llm.common import col, without

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
KNOWN = 200_000  # segments remembered by a worker
PAIRS = (1 << 20) - 1  # answers about two neighbours remembered by a worker
LANES = 8192  # segments searched side by side
BLOCK = 4 << 20  # bytes of text segmented at once
UNKNOWN, BEGIN, CLOSED = -1, -2, -3  # instead of the piece that ends at a boundary: a character outside the vocabulary, the text's beginning, no path


class Table:
    """Numbers by numbers of 0 or more, in numpy: open addressing with linear steps, less than half full."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, room: int = 0) -> None:
        self.shift = np.uint64(64 - max(4, int(2 * max(len(keys), room)).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.last = size - 1
        self.keys, self.values, self.used = np.full(size, -1, np.int64), np.zeros(size, np.int32), 0
        self.add(keys, values)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that aren't in the table."""
        keys = np.asarray(keys, np.int64)
        self.used += len(keys)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[left[free]]
            mine = self.keys[at] == keys[left]  # of several that want a free slot one has it
            self.values[at[mine]] = np.asarray(values)[left[mine]]
            left, at = left[~mine], (at[~mine] + 1) & self.last

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 where there is none."""
        at = self._slot(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.values[at], -1)
        left = np.flatnonzero((held != keys) & (held != -1))
        while len(left):
            at[left] = (at[left] + 1) & self.last
            held = self.keys[at[left]]
            hit = held == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (held != -1)]
        return out


@dataclass
class Vocabulary:
    """What the search needs of a model: pieces with scores, byte pieces, and the kind of search."""

    ids: dict[str, int]
    scores: list[float]
    text: list[bytes]  # what each id stands for, with plain spaces
    bytes_of: list[int]  # id of each byte's piece
    unigram: bool
    unknown: int
    longest: int = 0
    segments: bool = False
    search: dict[str, int] = field(default_factory=dict)  # the pieces that can occur in an encoding

    def __post_init__(self) -> None:
        self.longest = max(map(len, self.ids), default=1)
        self.search = self.ids if self.unigram else {p: k for p, k in self.ids.items() if merged(self, p) == [p]}
        self.segments = all(re.fullmatch(f"{MARK}*[^{MARK}]*", p) for p in self.ids)
        self.score = np.array(self.scores, np.float64)
        self._spell()
        if not self.unigram:
            self._merges()
        self.known = (pa.array([], pa.binary()), _list(np.zeros(1, np.int64), np.zeros(0, np.int32)))

    def _spell(self) -> None:
        """The pieces as a tree: the child of a node by its number and a character."""
        letters = sorted({ord(c) for p in self.search for c in p})
        self.width = len(letters) + 1
        self.letter = np.full(max(letters, default=0) + 2, len(letters), np.int32)  # the last entry is for all higher ones
        self.letter[letters] = np.arange(len(letters))
        child, piece = {}, [-1]
        for p, k in self.search.items():
            node = 0
            for c in p:
                key = node * self.width + int(self.letter[ord(c)])
                if key not in child:
                    child[key] = len(piece)
                    piece.append(-1)
                node = child[key]
            piece[node] = k
        self.child = Table(np.array(list(child), np.int64), np.array(list(child.values()), np.int32))
        self.piece = np.array(piece, np.int32)
        self.single = np.zeros(self.width, bool)
        self.single[[int(self.letter[ord(p)]) for p in self.search if len(p) == 1]] = True

    def _merges(self) -> None:
        """Which two pieces merge last into a piece, and what any two pieces would make."""
        size = len(self.scores)
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        made = {}
        for p, k in self.search.items():
            if len(p) > 1:
                self.left[k], self.right[k] = (self.search[x] for x in merged(self, p, 2))
            for i in range(1, len(p)):
                a, b = self.search.get(p[:i]), self.search.get(p[i:])
                if a is not None and b is not None:
                    made[a * size + b] = k
        self.made = Table(np.array(list(made), np.int64), np.array(list(made.values()), np.int32))
        self.agreed: Table | None = None  # made by each worker

    def agree(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each two pieces are the encoding of what they say together."""
        keys = a.astype(np.int64) * len(self.scores) + b
        if self.agreed is None:
            self.agreed = Table(np.zeros(0, np.int64), np.zeros(0, np.int32), PAIRS)
        out = self.agreed.get(keys)
        asked = np.flatnonzero(out == -1)
        if len(asked):
            new, of = np.unique(keys[asked], return_inverse=True)
            ok = self._apart(*np.divmod(new, len(self.scores)))
            out[asked] = ok[of]
            if self.agreed.used + len(new) > PAIRS:
                self.agreed = Table(np.zeros(0, np.int64), np.zeros(0, np.int32), max(PAIRS, len(new)))
            self.agreed.add(new, ok)
        return out == 1

    def _apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Undo the merges that made the two, the latest first: they stay apart if,
        at no time, the parts that touched made a piece which merges before the
        next of the two sides grew. Parts of the left side win ties, as they lie
        further left.
        """
        size, score = len(self.scores), self.score
        x, y, ok = x.copy(), y.copy(), np.ones(len(x), np.int32)
        bound, left_grew = np.full(len(x), -np.inf), np.zeros(len(x), bool)  # the score of the merge that comes next on either side
        at = np.arange(len(x))
        while len(at):
            k = self.made.get(x[at] * size + y[at])
            s = score[np.maximum(k, 0)]
            joins = (k >= 0) & ((s > bound[at]) | ((s == bound[at]) & ~left_grew[at]))
            ok[at[joins]] = 0
            at = at[~joins & ((self.left[x[at]] >= 0) | (self.left[y[at]] >= 0))]
            # the later of the two last merges is undone first; of equals the right one came later
            px, py = self.left[x[at]] >= 0, self.left[y[at]] >= 0
            go_left = px & (~py | (score[x[at]] < score[y[at]]))
            bound[at] = np.where(go_left, score[x[at]], score[y[at]])
            left_grew[at] = go_left
            x[at], y[at] = np.where(go_left, self.right[x[at]], x[at]), np.where(go_left, y[at], self.left[y[at]])
        return ok


@lru_cache(4)
def load(path: str = MODEL, unigram: bool = False) -> Vocabulary:
    """Read a model file; user-defined, control and unknown pieces are never matched in a text."""
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    ids, scores, text, bytes_of = {}, [], [], [m.unk_id()] * 256
    for i in range(m.get_piece_size()):
        piece = m.id_to_piece(i)
        scores.append(m.get_score(i))
        if m.is_byte(i):
            bytes_of[int(piece[3:5], 16)] = i
            text.append(bytes([int(piece[3:5], 16)]))
        elif m.is_control(i) or m.is_unknown(i) or m.is_unused(i):
            text.append(b"")
        else:
            ids[piece] = i
            text.append(piece.replace(MARK, " ").encode())
    return Vocabulary(ids, scores, text, bytes_of, unigram, m.unk_id())


def merged(v: Vocabulary, text: str, stop: int = 1) -> list[str]:
    """Byte-pair encoding of a short string by its definition, until ``stop`` parts are left: the best-scored neighbours merge first, the left ones of equals."""
    parts = list(text)
    while len(parts) > stop:
        best, at = None, -1
        for i in range(len(parts) - 1):
            k = v.ids.get(parts[i] + parts[i + 1])
            if k is not None and (best is None or v.scores[k] > best):
                best, at = v.scores[k], i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Lattice:
    """The search over many texts at once, one character of each in a step.

    Held for each text: the walks through the tree of pieces that are still
    open, and the backpointers of the boundaries since the last commit, in a
    ring of columns.
    """

    def __init__(self, v: Vocabulary, chars: np.ndarray, begin: np.ndarray, length: np.ndarray) -> None:
        """``chars``: code points of all texts; ``length`` must not increase."""
        self.v, self.begin, self.length = v, begin, length
        self.letters = v.letter[np.minimum(chars, len(v.letter) - 1)]
        n = len(begin)
        self.ring = min(int(length.max(initial=0)), 5 * v.longest) + 1
        self.last = np.full((n, self.ring), CLOSED, np.int32)  # the piece that ends at a boundary
        self.came = np.zeros((n, self.ring), np.int32)  # how many characters it has
        self.total = np.zeros((n, self.ring)) if v.unigram else None
        self.done = np.zeros(n, np.int64)  # the boundary up to which ids are committed
        self.last[:, 0] = BEGIN
        self.lane, self.start, self.node = (np.zeros(0, np.int64) for _ in range(3))
        self.out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # committed (text, boundary, piece)

    def run(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, end, id) of all pieces in order; UNKNOWN stands for a character outside the vocabulary."""
        window = self.v.longest
        still = len(self.length) - np.searchsorted(self.length[::-1], np.arange(1, int(self.length.max(initial=0)) + 1))
        for t, active in enumerate(still.tolist(), 1):
            self.step(t, active)
            if t % window == 0:
                ready = np.flatnonzero(t - self.done[:active] >= 4 * window)
                if len(ready):
                    self.commit(ready, self.meeting(ready, t))
                if t - self.done[:active].min(initial=t) + window >= self.ring - 1 and t < len(still):
                    self.widen(t)
        self.commit(np.arange(len(self.length)), self.length)
        text, end, piece = (np.concatenate(x) for x in zip(*self.out, strict=True))
        order = np.lexsort((end, text))
        return text[order], end[order], piece[order]

    def step(self, t: int, active: int) -> None:
        """The backpointers at boundary ``t`` of the first ``active`` texts."""
        v, col, before = self.v, t % self.ring, (t - 1) % self.ring
        letter = self.letters[self.begin[:active] + (t - 1)]
        opened = np.flatnonzero(self.last[:active, before] != CLOSED)
        on = self.lane < active
        # in the order of their starts, so the longest piece comes first
        lane = np.concatenate([self.lane[on], opened])
        start = np.concatenate([self.start[on], np.full(len(opened), t - 1)])
        node = np.concatenate([self.node[on], np.zeros(len(opened), np.int64)])
        node = v.child.get(node * v.width + letter[lane])
        on = node >= 0
        self.lane, self.start, self.node = lane, start, node = lane[on], start[on], node[on].astype(np.int64)
        unknown = ~v.single[letter] & (self.last[:active, before] != CLOSED)
        self.last[:active, col] = np.where(unknown, UNKNOWN, CLOSED)
        self.came[:active, col] = 1
        piece = v.piece[node]
        on = piece >= 0
        lane, start, piece = lane[on], start[on], piece[on]
        if v.unigram:
            self.total[:active, col] = np.where(unknown, self.total[:active, before] - 100.0, -np.inf)
            total = self.total[lane, start % self.ring] + v.score[piece]
            best = np.full(active, -np.inf)
            np.maximum.at(best, lane, total)
            ok = total == best[lane]
            self.total[lane[ok], col] = total[ok]
        else:
            previous = self.last[lane, start % self.ring]
            ok = previous < 0
            asked = np.flatnonzero(~ok)
            ok[asked] = v.agree(previous[asked], piece[asked])
        # of repeated places the last written stays: the longest piece
        lane, start, piece = lane[ok][::-1], start[ok][::-1], piece[ok][::-1]
        self.last[lane, col] = piece
        self.came[lane, col] = t - start

    def meeting(self, texts: np.ndarray, t: int) -> np.ndarray:
        """The boundary where the paths of all open boundaries of the window meet; all later pieces start in the window."""
        at = t - np.arange(self.v.longest)[None, :].repeat(len(texts), 0)
        open_ = self.last[texts[:, None], at % self.ring] != CLOSED
        at = np.where(open_, at, np.where(open_, at, -1).max(1)[:, None])
        apart = np.flatnonzero(at.max(1) > at.min(1))
        while len(apart):
            rows = at[apart]
            far = rows.max(1)
            back = far - self.came[texts[apart], far % self.ring]
            at[apart] = np.where(rows == far[:, None], back[:, None], rows)
            apart = apart[at[apart].max(1) > at[apart].min(1)]
        return at[:, 0]

    def commit(self, texts: np.ndarray, upto: np.ndarray) -> None:
        """Put out the ids on the path to ``upto`` and forget what is before it."""
        at, end = upto.copy(), self.done[texts]
        on = np.flatnonzero(at > end)
        while len(on):
            rows, col = texts[on], at[on] % self.ring
            self.out.append((rows, at[on], self.last[rows, col]))
            at[on] -= self.came[rows, col]
            on = on[at[on] > end[on]]
        self.done[texts] = np.maximum(upto, end)

    def widen(self, t: int) -> None:
        """More columns, for texts whose paths haven't met yet."""
        at = self.done[:, None] + np.arange(self.ring)[None, :]
        rows = np.arange(len(at))[:, None]
        for name in ("last", "came", "total"):
            if (old := getattr(self, name)) is not None:
                new = np.zeros((len(at), 2 * self.ring), old.dtype)
                new[rows, at % (2 * self.ring)] = old[rows, at % self.ring]
                setattr(self, name, new)
        self.ring *= 2


def search(v: Vocabulary, chars: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts that follow each other in ``chars`` (code points, spaces already marked), and the number of each text's ids."""
    begin = np.cumsum(length) - length
    order = np.argsort(-length, kind="stable")  # equal lengths go side by side
    found = []
    for at in range(0, len(order), LANES):
        some = order[at : at + LANES]
        text, end, piece = Lattice(v, chars, begin[some], length[some]).run() if length[some[0]] else (np.zeros(0, np.int64),) * 3
        found.append((some[text], end, piece))
    text, end, piece = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found, strict=True) if found else ((), (), ())))
    strange = np.flatnonzero(piece == UNKNOWN)
    if len(strange):  # characters outside the vocabulary: an id for each byte
        raw = [[v.bytes_of[x] for x in chr(c).encode("utf-8", "replace")] for c in chars[begin[text[strange]] + end[strange] - 1].tolist()]
        times = np.ones(len(piece), np.int64)
        times[strange] = [len(r) for r in raw]
        text, piece = np.repeat(text, times), np.repeat(piece, times)
        piece[piece == UNKNOWN] = [x for r in raw for x in r]
    piece = piece[np.argsort(text, kind="stable")]
    return piece.astype(np.int32), np.bincount(text.astype(np.int64), minlength=len(length))


def _list(ends: np.ndarray, values: np.ndarray) -> pa.LargeListArray:
    return pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(values, pa.int32()))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def stream(v: Vocabulary, text: str) -> Iterator[int]:
    """Ids of ``text`` (spaces already marked)."""
    yield from search(v, _points(text), np.array([len(text)]))[0].tolist()


def _segments(v: Vocabulary, parts: pa.Array) -> pa.LargeListArray:
    """Ids of distinct segments, as bytes with plain spaces; searched only if they aren't known."""
    known, held = v.known
    place = pc.index_in(parts, value_set=known)
    new = parts.filter(place.is_null())
    text = b"".join(new.to_pylist()).decode("utf-8", "replace").replace(" ", MARK)
    raw = new.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    ends = np.frombuffer(new.buffers()[1], np.int32)[new.offset : new.offset + len(new) + 1].astype(np.int64) if len(new) else np.zeros(1, np.int64)
    firsts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # a character begins at every byte that doesn't continue one
    values, counts = search(v, _points(text), np.diff(firsts[ends]))
    ids = _list(np.concatenate([[0], np.cumsum(counts)]), values)
    every = pa.concat_arrays([held, ids])
    rank = np.cumsum(place.is_null().to_numpy(zero_copy_only=False)) - 1 + len(known)
    out = every.take(pa.array(np.where(place.is_null().to_numpy(zero_copy_only=False), rank, place.fill_null(0).to_numpy(zero_copy_only=False))))
    v.known = (pa.concat_arrays([known, new]), every) if len(known) + len(new) <= KNOWN else (parts, out)
    return out


def encode_batch(v: Vocabulary, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts (null ones have none) one after the other, and the number of each text's ids."""
    texts = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), MARK, " ")
    if not v.segments:
        marked = [MARK + t.replace(" ", MARK) if t else "" for t in texts.to_pylist()]
        return search(v, _points("".join(marked)), np.array([len(t) for t in marked], np.int64))
    led = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string())))
    ends = np.concatenate([[0], np.cumsum(pc.binary_length(led).to_numpy(zero_copy_only=False))]).astype(np.int64)
    data = np.frombuffer(b"".join(led.cast(pa.large_binary()).to_pylist()), np.uint8)
    space = data == 32
    cut = space.copy()
    cut[1:] &= ~space[:-1]
    cut[ends[:-1][ends[:-1] < ends[1:]]] = True
    cuts = np.append(np.flatnonzero(cut), len(data))
    values, counts, at = [], np.zeros(len(cuts) - 1, np.int64), 0
    while at < len(cuts) - 1:
        to = max(at + 1, int(np.searchsorted(cuts, cuts[at] + BLOCK, "right")) - 1)
        offsets = (cuts[at : to + 1] - cuts[at]).astype(np.int32)
        parts = pa.BinaryArray.from_buffers(pa.binary(), to - at, [None, pa.py_buffer(offsets), pa.py_buffer(data[cuts[at] : cuts[to]])]).dictionary_encode()
        of = _segments(v, parts.dictionary).take(parts.indices)
        values.append(of.flatten().to_numpy())
        counts[at:to] = pc.list_value_length(of).to_numpy()
        at = to
    values = np.concatenate(values) if values else np.zeros(0, np.int32)
    sums = np.concatenate([[0], np.cumsum(counts)])
    return values, np.diff(sums[np.searchsorted(cuts, ends)])


def encode(v: Vocabulary, text: str) -> bytes:
    """Ids of ``text`` as little-endian 32-bit numbers."""
    return encode_batch(v, pa.array([text], pa.string()))[0].astype(np.int32).tobytes()


def decode_batch(v: Vocabulary, values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Texts of ids; the mark that encoding puts before a text goes again."""
    said = pa.array(v.text, pa.large_binary()).take(pa.array(values))
    offsets = np.frombuffer(said.buffers()[1], np.int64)[: len(values) + 1] if len(values) else np.zeros(1, np.int64)
    raw = said.buffers()[2] if len(values) else None
    data = np.frombuffer(raw, np.uint8)[: offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    ends = offsets[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
    led = np.flatnonzero(ends[1:] > ends[:-1])
    led = led[data[ends[led]] == 32]
    stays = np.ones(len(data), bool)
    stays[ends[led]] = False
    drop = np.zeros(len(counts) + 1, np.int64)
    drop[led + 1] = 1
    ends = ends - np.cumsum(drop)
    out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(data[stays])])
    try:
        text = out.view(pa.large_string())
        text.validate(full=True)
    except pa.ArrowInvalid:  # ids that didn't come from a text
        text = pa.array([x.decode("utf-8", "replace") for x in out.to_pylist()], pa.large_string())
    return text


def decode(v: Vocabulary, ids: np.ndarray) -> str:
    return decode_batch(v, np.asarray(ids, np.int64), np.array([len(ids)]))[0].as_py()


def _mapped(df: DataFrame, keep: list[str], size_of: str, made: list[T.StructField], make: Callable[[Vocabulary, pa.RecordBatch], list[pa.Array]], v: Vocabulary) -> DataFrame:
    """``df``'s columns ``keep`` and those that ``make`` returns, for a few rows at a time: ``BLOCK`` bytes of the column ``size_of``, or one row."""
    shared = df.sparkSession.sparkContext.broadcast(v)
    schema = T.StructType([*(df.schema[c] for c in keep), *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = whole.column(size_of)
            sizes = pc.list_value_length(sizes) if pa.types.is_list(sizes.type) else pc.binary_length(sizes)
            ends, at = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
            while at < whole.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK, "right")))
                b = whole.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *make(shared.value, b)], names=[*keep, *(f.name for f in made)])
                at = to
            pa.default_memory_pool().release_unused()  # workers live on, in other stages too

    return df.select(*(col(c) for c in keep)).mapInArrow(run, schema)


def _nulls(of: pa.Array) -> pa.Array:
    return pa.array(of.is_null().to_numpy(zero_copy_only=False))


def _ids(values: np.ndarray, counts: np.ndarray, nulls: pa.Array) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.int32()), mask=nulls)


def encode_column(df: DataFrame, text: str = "text", out: str = "ids", path: str = MODEL, unigram: bool = False) -> DataFrame:
    """``df`` with an array of ids in ``out``; a column of that name is replaced. The model file is read once, by the driver."""

    def make(v: Vocabulary, b: pa.RecordBatch) -> list[pa.Array]:
        return [_ids(*encode_batch(v, b.column(text)), _nulls(b.column(text)))]

    return _mapped(df, without(df, out), text, [T.StructField(out, T.ArrayType(T.IntegerType()))], make, load(path, unigram))


def decode_column(df: DataFrame, ids: str = "ids", out: str = "decoded", path: str = MODEL) -> DataFrame:
    """``df`` with the text of ``ids`` in ``out``; a column of that name is replaced."""

    def make(v: Vocabulary, b: pa.RecordBatch) -> list[pa.Array]:
        lists, nulls = b.column(ids), _nulls(b.column(ids))
        counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        return [pc.if_else(nulls, None, decode_batch(v, lists.flatten().to_numpy(zero_copy_only=False), counts).cast(pa.string()))]

    return _mapped(df, without(df, out), ids, [T.StructField(out, T.StringType())], make, load(path))


def round_trip(df: DataFrame, text: str = "text", ids: str = "ids", decoded: str = "decoded", path: str = MODEL) -> DataFrame:
    """``df`` with ids and the text decoded from them, in one pass: the ids needn't go to Python again."""

    def make(v: Vocabulary, b: pa.RecordBatch) -> list[pa.Array]:
        values, counts = encode_batch(v, b.column(text))
        nulls = _nulls(b.column(text))
        return [_ids(values, counts, nulls), pc.if_else(nulls, None, decode_batch(v, values, counts).cast(pa.string()))]

    made = [T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())]
    return _mapped(df, without(df, ids, decoded), text, made, make, load(path))


def tokenized(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = MODEL) -> DataFrame:
    """One row per document: key, n_ids, ids, and whether decoding gives the text back."""
    both = round_trip(docs.select(col(key).alias(key), col(text).alias("__text")), "__text", "ids", "__decoded", path)
    return both.select(col(key), F.size("ids").alias("n_ids"), "ids", F.col("__decoded").eqNullSafe(F.col("__text")).alias("round_trip"))
