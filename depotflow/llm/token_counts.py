"""Token counts by a finite-state transducer that is compiled from a byte-pair vocabulary with byte fallback.

The tokenization of a text is the one sequence of pieces in which any two neighbours are what the vocabulary makes of their
joined string (*agree*). So the last piece of every prefix follows from the last pieces of shorter prefixes, and only those
matter from which a piece still being read may start. A state of the transducer holds them: the longest piece prefix the text
ends with (a node of an Aho-Corasick automaton), and for each shorter one the last piece and the count there. A transition
carries by how much the count of the prefix changes. States are compiled when a text first reaches them and started
anew when they outgrow MAX_STATES.

A text is cut into chunks, and each chunk gives a map from the state before it to the state after it and a count. Where no piece
holds the two characters around a cut, the map is the same for every state: a transducer may start there. Those chunks are walked side by
side, and their counts add up by a prefix sum. Long stretches without such a cut have chunks with real maps, from the pieces that may
cross their left edge to those that may cross the right one; these are composed in pairs, level by level.

Nulls: a null text is empty and has no tokens; a null id is a row like any other. Repeated rows come back as often as they came.
Other columns are not read. Strings of special tokens inside a text are ordinary text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from depotflow.llm.common import text_rows, text_slices

SPACE = "▁"  # how the vocabulary writes a blank
CHUNK = 256  # characters between two places where a chunk may begin
RUN = 4096  # a stretch this long without a place to begin is composed from maps
MAX_STATES = 400_000
OUTSIDE = 4  # classes 0 to 3: characters that no piece holds, by their UTF-8 length less one
MIX = np.uint64(0x9E3779B97F4A7C15)  # an odd multiplier, for the table of transitions
PROBES = ("", " ", "  a", "a  b ", "\ta\r\nb", "<s>x</s>", "▁a", "\x00", "\U0001f600 中文", "é" * 3, "ab" * 40, " " * 70)

Map = dict[tuple[int, int], dict[tuple[int, int], int]]


class Vocabulary:
    """Pieces of a model file as a trie with failure links, and which pieces agree."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.get_piece_size()) if not any(f(i) for f in (model.is_control, model.is_unknown, model.is_byte, model.is_unused))]
        pieces = [(model.id_to_piece(i), model.get_score(i)) for i in ids]
        self.scores = dict(pieces)
        chars = sorted({c for p, _ in pieces for c in p})
        self.classes = {c: OUTSIDE + k for k, c in enumerate(chars)}
        # a character that pieces hold but that is none itself is written in bytes where it stays alone
        self.names = [p for p, _ in pieces] + [c for c in chars if c not in self.scores]
        self.weights = [1 if p in self.scores else len(p.encode()) for p in self.names]
        self.longest = max(map(len, self.names), default=1)
        self.n_classes = OUTSIDE + len(chars)
        self.of_char = np.zeros(0x110000, np.int32)
        self.of_char[0x80:] = 1
        self.of_char[0x800:] = 2
        self.of_char[0x10000:] = 3
        for c, k in self.classes.items():
            self.of_char[ord(c)] = k
        self.of_char[32] = self.of_char[ord(SPACE)]
        self.joined = np.zeros((self.n_classes, self.n_classes), bool)  # two characters that some piece holds side by side
        self.agreed: dict[tuple[int, int], bool] = {}
        self._trie()
        for text in PROBES:
            if sum(self.weights[t] if t >= 0 else -t for t in self.spell(text)) != len(model.encode(text)):
                raise ValueError(f"{path}: not a byte-pair model with byte fallback, a leading blank and plain white space: {text!r}")

    def _trie(self) -> None:
        self.go: list[dict[int, int]] = [{}]
        self.depth, self.piece, self.head = [0], [-1], [-1]  # head: the first character
        self.lasts = [self.classes[name[-1]] for name in self.names]
        for t, name in enumerate(self.names):
            if self.merge(list(name)) != [name]:  # merging never arrives at it
                continue
            node, codes = 0, [self.classes[c] for c in name]
            for k, c in enumerate(codes):
                if k:
                    self.joined[codes[k - 1], c] = True
                if c not in self.go[node]:
                    self.go[node][c] = len(self.go)
                    self.go.append({})
                    self.depth.append(self.depth[node] + 1)
                    self.piece.append(-1)
                    self.head.append(codes[0])
                node = self.go[node][c]
            self.piece[node] = t
        self.fail = [0] * len(self.go)
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * len(self.go)  # (length, piece) of the pieces a node's string ends with
        level = [0]
        while level:
            below = []
            for node in level:
                for c, child in self.go[node].items():
                    self.fail[child] = self.step(self.fail[node], c) if node else 0
                    own = ((self.depth[child], self.piece[child]),) if self.piece[child] >= 0 else ()
                    self.ends[child] = own + self.ends[self.fail[child]]
                    below.append(child)
            level = below

    def step(self, node: int, c: int) -> int:
        while c not in self.go[node]:
            if not node:
                return 0
            node = self.fail[node]
        return self.go[node][c]

    def merge(self, parts: list[str]) -> list[str]:
        """Join the neighbours with the best score, the leftmost of equals, until none are left to join."""
        while len(parts) > 1:
            best = max(((self.scores.get(a + b, -np.inf), -k) for k, (a, b) in enumerate(zip(parts, parts[1:]))), default=(-np.inf, 0))
            if best[0] == -np.inf:
                break
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def agree(self, left: int, right: int) -> bool:
        """Is the joined string of two pieces made of just these two?"""
        found = self.agreed.get((left, right))
        if found is None:
            a, b = self.names[left], self.names[right]
            found = not self.joined[self.classes[a[-1]], self.classes[b[0]]] or self.merge(list(a + b)) == [a, b]
            self.agreed[left, right] = found
        return found

    def spell(self, text: str) -> list[int]:
        """Pieces of a text by merging alone, as a check; characters outside count as minus their bytes."""
        parts = self.merge(list((SPACE + text.replace(" ", SPACE)) if text else ""))
        known = {name: t for t, name in enumerate(self.names)}
        return [known.get(p, -len(p.encode())) for p in parts]

    def classify(self, text: str) -> np.ndarray:
        return self.of_char[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]


class Transducer:
    """The states reached so far and their transitions, in a table with open addresses that is looked up for many chunks at once."""

    def __init__(self, vocabulary: Vocabulary, max_states: int = MAX_STATES):
        self.v, self.max_states = vocabulary, max_states
        self.clear()

    def clear(self) -> None:
        self.v.agreed.clear()
        self.start = (0, ((-1, 0),))  # nothing read, no piece before
        self.states, self.known = [self.start], {self.start: 0}
        self._table(16)

    def _table(self, bits: int) -> None:
        self.bits, self.filled = bits, 0
        self.keys = np.full(1 << bits, -1, np.int64)
        self.after, self.change = np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int32)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _insert(self, key: int, after: int, change: int) -> None:
        if self.filled * 3 > len(self.keys):
            full = self.keys >= 0
            old = self.keys[full], self.after[full], self.change[full]
            self._table(self.bits + 1)
            self._insert_all(*old)
        h = (key * int(MIX) & (1 << 64) - 1) >> (64 - self.bits)
        while self.keys[h] >= 0:
            h = (h + 1) & (len(self.keys) - 1)
        self.keys[h], self.after[h], self.change[h] = key, after, change
        self.filled += 1

    def _insert_all(self, keys: np.ndarray, after: np.ndarray, change: np.ndarray) -> None:
        at, left = self._place(keys), np.arange(len(keys))
        while len(left):
            empty = left[self.keys[at[left]] < 0]
            self.keys[at[empty]] = keys[empty]  # of several at one place, one stays
            self.after[at[empty]], self.change[at[empty]] = after[empty], change[empty]
            won = self.keys[at[left]] == keys[left]
            left = left[~won]
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
        self.filled = len(keys)

    def transition(self, state: int, c: int) -> tuple[int, int]:
        """State after a character, and by how much the count of the text read so far changes."""
        v = self.v
        if c < OUTSIDE:
            return 0, c + 1
        node, before = self.states[state]
        new = v.step(node, c)
        if v.depth[new] == 1:  # no piece reaches back over this character: what lies before has no say
            node, before = self.start
        depths = self._depths(node)
        chain = dict(zip(depths, before))
        for length, piece in v.ends[new]:
            last, count = chain[length - 1]
            if last < 0 or v.agree(last, piece):
                break
        else:
            raise ValueError("no piece agrees with those before it: the scores don't form a byte-pair vocabulary")
        change = count + v.weights[piece]
        while new and not v.go[new]:  # no longer piece begins like this
            new = v.fail[new]
        entries = []
        for d, first in self._firsts(new):
            last, count = chain[d - 1]
            # a piece that no other holds side by side with this character agrees with all that may follow
            entries.append((last if last >= 0 and v.joined[v.lasts[last], first] else -1, count - change))
        key = (new, (*entries, (piece, 0)))
        if key not in self.known:
            self.known[key] = len(self.states)
            self.states.append(key)
        return self.known[key], change

    def _depths(self, node: int) -> list[int]:
        out = []
        while node:
            out.append(self.v.depth[node])
            node = self.v.fail[node]
        return [*out, 0]

    def _firsts(self, node: int) -> list[tuple[int, int]]:
        """Lengths of the strings a node ends with that pieces begin with, longest first, and their first characters."""
        out = []
        while node:
            out.append((self.v.depth[node], self.v.head[node]))
            node = self.v.fail[node]
        return out

    def step(self, states: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = states * self.v.n_classes + classes
        while True:
            at = self._place(keys)
            found = self.keys[at]
            open_ = np.flatnonzero(found != keys)
            missing = []
            while len(open_):
                empty = found[open_] < 0
                missing.append(open_[empty])
                open_ = open_[~empty]
                at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
                found[open_] = self.keys[at[open_]]
                open_ = open_[found[open_] != keys[open_]]
            missing = np.concatenate(missing) if missing else np.empty(0, int)
            if not len(missing):
                return self.after[at], self.change[at]
            for key in np.unique(keys[missing]).tolist():
                self._insert(key, *self.transition(*divmod(key, self.v.n_classes)))

    def walk(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Counts of chunks that begin where the transducer may start, all walked at once."""
        if len(self.states) > self.max_states:
            self.clear()
        order = np.argsort(-sizes, kind="stable")  # those that still have characters are always a prefix
        at, left = starts[order].astype(np.int64), sizes[order]
        states, counts = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        n = len(at)
        for k in range(int(left[0]) if n else 0):
            n = int(np.searchsorted(-left, -k, "left"))
            after, change = self.step(states[:n], codes[at[:n] + k])
            states[:n] = after
            counts[:n] += change
        out = np.empty_like(counts)
        out[order] = counts
        return out


def crossing(v: Vocabulary, codes: list[int], at: int) -> list[tuple[int, int]]:
    """(piece, how much of it lies before) of all pieces that hold the character before an edge."""
    found = []
    for begin in range(max(0, at - v.longest), at):
        node, k = 0, begin
        while k < len(codes) and (node := v.go[node].get(codes[k], -1)) >= 0:
            k += 1
            if k >= at and v.piece[node] >= 0:
                found.append((v.piece[node], at - begin))
    return found


def chunk_map(v: Vocabulary, codes: list[int], a: int, z: int) -> Map:
    """For each piece that may cross the left edge, the pieces that may then cross the right one, and how many begin in between.

    Walks from different pieces soon run through the same last pieces; from there on only their counts differ by a constant.
    """
    ending: list[tuple[tuple[int, int], ...]] = []
    node = 0
    for c in codes[max(0, a - v.longest) : z]:
        node = v.step(node, c)
        ending.append(v.ends[node])
    base = z - len(ending)
    out_states = crossing(v, codes, z)
    if z == len(codes):
        out_states = [(t, k) for t, k in out_states if k == len(v.names[t])]
    walks: list[tuple[dict[int, tuple[int, int]], int]] = []
    result: Map = {}
    for entry in crossing(v, codes, a) if a else [(-1, 0)]:
        first = a - entry[1] + (len(v.names[entry[0]]) if a else 0)
        reach = {first: (entry[0], 0)}
        same: tuple[dict[int, tuple[int, int]], int] | None = None
        for i in range(first + 1, z):
            for length, t in ending[i - 1 - base]:
                last, count = reach.get(i - length, (-2, 0))
                if last == -1 or (last >= 0 and v.agree(last, t)):
                    reach[i] = (t, count + v.weights[t])
                    break
            if i - first > v.longest and i % v.longest == 0:
                window = [reach.get(j) for j in range(i - v.longest, i + 1)]
                if not any(window):
                    break
                for other, begun in walks:
                    if begun > i - v.longest:
                        continue
                    twin = [other.get(j) for j in range(i - v.longest, i + 1)]
                    gaps = {x[1] - y[1] if x and y and x[0] == y[0] else None for x, y in zip(window, twin) if x or y}
                    if len(gaps) == 1 and None not in gaps:
                        same = other, gaps.pop()
                        break
                if same:
                    break
        result[entry] = {}
        for t, k in out_states:
            begin = z - k
            if begin < first:
                if first >= z and (t, begin) == (entry[0], a - entry[1]):  # the piece reaches over the whole chunk
                    result[entry][t, k] = 0
                continue
            at = reach.get(begin)
            if at is None and same and begin in same[0]:
                at = same[0][begin][0], same[0][begin][1] + same[1]
            if at and (at[0] == -1 or v.agree(at[0], t)):
                result[entry][t, k] = at[1] + v.weights[t]
        if not same:
            walks.append((reach, first))
    return result


def compose(left: Map, right: Map) -> Map:
    """Map of two adjoining chunks. At most one way leads from one piece to another, so counts need no choice."""
    return {
        entry: {leave: n + m for middle, n in ways.items() for leave, m in right.get(middle, {}).items()} for entry, ways in left.items()
    }


def run_count(v: Vocabulary, codes: np.ndarray, chunk: int = RUN) -> int:
    """Tokens of a stretch without a place to begin, from the maps of its chunks; adjoining ones are composed level by level."""
    listed = codes.tolist()
    edges = [*range(0, max(len(listed) - chunk, 1), max(chunk, 2 * v.longest)), len(listed)]
    maps = [chunk_map(v, listed, a, z) for a, z in zip(edges, edges[1:])]
    while len(maps) > 1:
        maps = [compose(*maps[k : k + 2]) if k + 1 < len(maps) else maps[k] for k in range(0, len(maps), 2)]
    (counts,) = [list(ways.values()) for ways in maps[0].values()]
    return counts[0]


def count_tokens(transducer: Transducer, texts: list[bytes], chunk: int = CHUNK, run: int = RUN) -> np.ndarray:
    """Tokens of each text."""
    v = transducer.v
    decoded = [t.decode("utf-8", "replace") for t in texts]
    sizes = np.array([len(t) + (len(t) > 0) for t in decoded], np.int64)
    if not sizes.sum():
        return np.zeros(len(texts), np.int64)
    codes = v.classify("".join(SPACE + t for t in decoded if t))
    ends = np.cumsum(sizes)
    begins = ends - sizes
    free = np.ones(len(codes), bool)
    free[1:] = ~v.joined[codes[:-1], codes[1:]]
    free[begins[sizes > 0]] = True
    places = np.flatnonzero(free)
    wanted = np.append(np.arange(0, len(codes), chunk), begins[sizes > 0])
    starts = np.unique(places[np.minimum(np.searchsorted(places, wanted), len(places) - 1)])
    lengths = np.diff(np.append(starts, len(codes)))
    long = lengths > max(run, 2 * chunk)
    counts = np.zeros(len(starts), np.int64)
    counts[~long] = transducer.walk(codes, starts[~long], lengths[~long])
    for k in np.flatnonzero(long).tolist():
        counts[k] = run_count(v, codes[starts[k] : starts[k] + lengths[k]], run)
    sums = np.concatenate(([0], np.cumsum(counts)))
    return sums[np.searchsorted(starts, ends)] - sums[np.searchsorted(starts, begins)]


@lru_cache(1)
def _compiled(path: str) -> Transducer:
    return Transducer(Vocabulary(path))


def token_counts(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes: UTF-8 bytes, n_tokens, over_limit: more tokens than `limit`) of every row, for the sentencepiece model at `path`,
    without begin, end or other added tokens. The texts stay where they are read: nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = _compiled(path)
        for ids, texts in text_slices(batches):
            bytes_ = np.array([len(t) for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays([ids, pa.array(bytes_), pa.array(count_tokens(transducer, texts))], ["doc_id", "n_bytes", "n_tokens"])

    counted = text_rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
