"""A minimal acyclic transducer from words to id sequences, as flat arrays in one file.

Words go in sorted; states with equal futures are shared (suffixes), and outputs
move as far to the front as words allow, so sharing is not blocked by ids. The
arcs of all states lie in one sorted array of ``state << 21 | code point`` keys,
which can be memory-mapped and searched for many words at once.
"""

from __future__ import annotations

import io
import os
from collections.abc import Iterable

import numpy as np

ARRAYS = ("arcs", "targets", "arc_at", "final", "final_at", "pool")


def _common(a: tuple, b: tuple) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


class _State:
    __slots__ = ("arcs", "final", "tail")

    def __init__(self) -> None:
        self.arcs: dict[str, list] = {}  # char -> [target, output]
        self.final, self.tail = False, ()


def compile_words(entries: Iterable[tuple[str, tuple[int, ...]]]) -> bytes:
    """The transducer of sorted, distinct (word, ids) pairs, serialised."""
    register: dict[tuple, int] = {}
    frozen: list[_State] = []

    def freeze(state: _State) -> int:
        key = (state.final, state.tail, tuple((c, t, o) for c, (t, o) in state.arcs.items()))
        if key not in register:
            register[key] = len(frozen)
            frozen.append(state)
        return register[key]

    path, last = [_State()], ""

    def close(down_to: int) -> None:
        while len(path) > down_to + 1:
            state = path.pop()
            path[-1].arcs[last[len(path) - 1]][0] = freeze(state)

    for word, ids in entries:
        shared = len(os.path.commonprefix([word, last]))
        close(shared)
        for char in word[shared:]:
            state = _State()
            path[-1].arcs[char] = [None, ()]
            path.append(state)
        path[-1].final = True
        rest = tuple(ids)
        for depth, char in enumerate(word[:shared]):
            arc, below = path[depth].arcs[char], path[depth + 1]
            n = _common(arc[1], rest)
            kept, pushed = arc[1][:n], arc[1][n:]
            if pushed:  # what the words below do not all share moves one state down
                for other in below.arcs.values():
                    other[1] = pushed + other[1]
                if below.final:
                    below.tail = pushed + below.tail
            arc[1], rest = kept, rest[n:]
        path[shared].arcs[word[shared]][1] = rest
        last = word
    close(0)
    root = freeze(path[0])

    pool, at = [], {(): 0}

    def place(output: tuple) -> int:
        if output not in at:
            at[output] = len(pool) + 1
            pool.extend((len(output), *output))
        return at[output]

    rows = [((0 if i == root else i + 1) << 21 | ord(c), 0 if t == root else t + 1, place(o))
            for i, s in enumerate(frozen) for c, (t, o) in s.arcs.items()]
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 3)
    final, final_at = np.zeros(len(frozen) + 1, bool), np.zeros(len(frozen) + 1, np.int32)
    for i, s in enumerate(frozen):
        k = 0 if i == root else i + 1
        final[k], final_at[k] = s.final, place(s.tail)
    values = dict(arcs=table[:, 0], targets=table[:, 1].astype(np.int32), arc_at=table[:, 2].astype(np.int32),
                  final=final, final_at=final_at, pool=np.array(pool, np.uint32))
    out = io.BytesIO()
    out.write(np.array([len(values[a]) for a in ARRAYS], np.int64).tobytes())
    for a in ARRAYS:
        out.write(b"\0" * (-out.tell() % 8))
        out.write(values[a].tobytes())
    return out.getvalue()


class Lexicon:
    """A compiled transducer over a memory-mapped file (or bytes)."""

    TYPES = (np.int64, np.int32, np.int32, np.bool_, np.int32, np.uint32)

    def __init__(self, source: str | bytes) -> None:
        data = (np.frombuffer(source, np.uint8) if isinstance(source, bytes)
                else np.memmap(source, np.uint8, "r"))
        sizes, at = data[: 8 * len(ARRAYS)].view(np.int64), 8 * len(ARRAYS)
        for name, kind, n in zip(ARRAYS, self.TYPES, sizes):
            at += -at % 8
            width = int(n) * np.dtype(kind).itemsize
            setattr(self, name, data[at: at + width].view(kind))
            at += width

    def find(self, words: list[str]) -> list[bytes | None]:
        """Ids of each word as little-endian 32-bit integers, None for words not in it.

        All words advance one character a step; those without an arc drop out.
        """
        out: list[bytes | None] = [None] * len(words)
        if not words or not len(self.arcs):
            return out
        lengths = np.array([len(w) for w in words])
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        pieces: list[list[bytes]] = [[] for _ in words]
        live, state = np.arange(len(words)), np.zeros(len(words), np.int64)

        def emit(rows: np.ndarray, places: np.ndarray) -> None:
            some = np.flatnonzero(places)
            for i, p in zip(rows[some].tolist(), places[some].tolist()):
                n = int(self.pool[p - 1])
                pieces[i].append(self.pool[p: p + n].tobytes())

        step = 0
        while len(live):
            ended = lengths[live] == step
            done = live[ended][self.final[state[ended]]]
            emit(done, self.final_at[state[ended]][self.final[state[ended]]])
            for i in done.tolist():
                out[i] = b"".join(pieces[i])
            live, state = live[~ended], state[~ended]
            key = state << 21 | codes[starts[live] + step] if len(live) else state
            spot = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            good = self.arcs[spot] == key
            live, spot = live[good], spot[good]
            emit(live, self.arc_at[spot])
            state = self.targets[spot].astype(np.int64)
            step += 1
        return out
