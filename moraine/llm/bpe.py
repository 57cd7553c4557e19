"""Byte-level BPE encoding and decoding with a lazily determinised transducer (operator 9).

The merges are given by token ranks.  Encoding is compiled into a finite-state transducer
over bytes.  For every prefix of a piece the encoding of that prefix ends in exactly one
token, and two tokens may stand side by side exactly if encoding their joined bytes gives
the two back.  So a state needs no more than the starts that can still grow into a token,
each as (bytes since the start, last token before the start).  States are numbered as they
are met, and each transition is worked out once for a state and byte (lazy subset
construction), then read from a table.  A token is emitted as soon as all live starts
agree on what came before them, which needs lookahead of bounded length.  The pieces of a
block of text walk through the table together, byte by byte, in numpy.

Decoding runs an incremental UTF-8 machine: an unfinished character at the end of a block
of tokens is held back for the next block.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from moraine.llm.textkit import KEPT, batch, chunks, ids_and_text, only, word_hashes, tidy

#: Bounds of a worker's memory: pieces that left the table, transducer states and their moves, and pairs of tokens that it remembers.
MOST_PIECES, MOST_STATES, MOST_MOVES, MOST_PAIRS = 30_000, 120_000, 1_000_000, 100_000
#: Longer pieces are not remembered.
LONG_PIECE = 64
OUTPUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: The pattern that ``piece_starts`` follows without a regular expression.
COMMON_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def load_ranks(lines: bytes) -> dict[bytes, int]:
    """Ranks from the text of a .tiktoken file: a base64 token and its rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Encoding by its definition: join the leftmost pair of lowest rank until none can be joined."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min(((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
        if best[0] == 1 << 60:
            break
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[x] for x in parts]


def _packed(state: tuple) -> bytes:
    return struct.pack(f"{len(state)}q", *state)


def _unpacked(key: bytes) -> tuple:
    return struct.unpack(f"{len(key) >> 3}q", key)


class Transducer:
    """The encoder of one vocabulary; ``encode_piece`` gives the ids of a piece of text."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the vocabulary must hold every single byte")
        if max(ranks.values()) + 1 >= 1 << 20:
            raise ValueError("a start and a token share an integer that holds ranks below 2 ** 20 - 1 only")
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.size_of = {i: len(t) for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.halves: dict[int, tuple[int, int]] = {}
        #: node * 256 + byte -> node; node 0 is the root.  ``token_at``: the token that ends in a node, or -1.
        self.trie: dict[int, int] = {}
        self.token_at: list[int] = [-1]
        for t, i in ranks.items():
            node = 0
            for byte in t:
                to = self.trie.get(node << 8 | byte)
                if to is None:
                    to = self.trie[node << 8 | byte] = len(self.token_at)
                    self.token_at.append(-1)
                node = to
            # tokens that no sequence of merges reaches stand for whole pieces only
            if len(t) == 1 or len(merge(t, ranks)) == 1:
                self.token_at[node] = i
        self.pairs: dict[int, bool] = {}
        #: A state is the last token of the prefix, then each live start as node << 20 | token before it + 1; packed, 8 bytes each.
        self.state: list[bytes] = [_packed((-1,))]
        self.number: dict[bytes, int] = {self.state[0]: 0}
        self.last = np.full(1024, -1, np.int32)
        #: The table, sorted: state << 8 | byte, and the state after it.  ``moves`` has those of long pieces.
        self.table, self.after = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.moves: dict[int, int] = {}
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int32)
        self.sizes[list(self.size_of)] = list(self.size_of.values())

    def split(self, token: int) -> tuple[int, int]:
        """The two tokens that are joined last to make a token; a single byte is twice itself."""
        got = self.halves.get(token)
        if got is None:
            piece = self.bytes_of[token]
            parts = [piece[i : i + 1] for i in range(len(piece))]
            while len(parts) > 2:
                i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            got = self.halves[token] = (self.ranks[parts[0]], self.ranks[parts[-1]])
        return got

    def fits(self, a: int, b: int) -> bool:
        """Whether the tokens a and b can be neighbours in an encoding.

        Undo the merges that made the two, latest first, and look at the tokens that then
        touch: had their pair a lower rank than the merge just undone, it would have won.
        """
        key = a << 20 | b
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            got = self.pairs[key] = self._fits(a, b)
        return got

    def _fits(self, a: int, b: int) -> bool:
        limit = 1 << 60
        while True:
            together = self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
            if together is not None and together < limit:
                return False
            one_a, one_b = self.size_of[a] == 1, self.size_of[b] == 1
            if one_a and one_b:
                return True
            # on the right a merge of equal rank comes later than one that starts further left
            if not one_a and (one_b or a > b):
                limit, a = a, self.split(a)[1]
            else:
                limit, b = b + 1, self.split(b)[0]

    def _next(self, held: tuple, byte: int) -> tuple:
        """The state after a byte: the subset construction for one state and byte."""
        trie, token_at, live, last = self.trie, self.token_at, [], -1
        for start in (*held[1:], held[0] + 1):  # the prefix so far is itself a start
            to = trie.get(start >> 20 << 8 | byte)
            if to is not None:
                since = start & 0xFFFFF
                live.append(to << 20 | since)
                if last < 0 and (token := token_at[to]) >= 0 and (not since or self.fits(since - 1, token)):
                    last = token
        if last < 0:
            raise ValueError("the ranks are not those of byte pair merges")
        return (last, *live)

    def _step(self, state: int, held: tuple | None, byte: int) -> tuple[int, tuple]:
        """(number, state) after a byte that is not in the table.

        States are numbered until the table is full; those met later have number -1 and are
        worked out anew each time.
        """
        after = self._next(_unpacked(self.state[state]) if state >= 0 else held, byte)
        key = _packed(after)
        to = self.number.get(key, -1)
        if to < 0 and len(self.state) < MOST_STATES:
            to = self.number[key] = len(self.state)
            self.state.append(key)
            if to >= len(self.last):
                self.last = np.concatenate([self.last, np.full(len(self.last), -1, np.int32)])
            self.last[to] = after[0]
        return to, after

    def _moved(self, state: int, held: tuple | None, byte: int) -> tuple[int, tuple | None, int]:
        """(number, state, last token) after a byte of a long piece."""
        to = self.moves.get(state << 8 | byte) if state >= 0 else None
        if to is None:
            to, held = self._step(state, held, byte)
            if state >= 0 and to >= 0:
                if len(self.moves) >= MOST_PAIRS:
                    self.moves.clear()
                self.moves[state << 8 | byte] = to
            return to, held, held[0]
        return to, None, int(self.last[to])

    def _learn(self, fresh: dict[int, int]) -> None:
        """Put new moves into the table while it has room."""
        if fresh and len(self.table) + len(fresh) <= MOST_MOVES:
            key = np.sort(np.fromiter(fresh, np.int64, len(fresh)))
            at = np.searchsorted(self.table, key)
            self.table = np.insert(self.table, at, key)
            self.after = np.insert(self.after, at, [fresh[k] for k in key.tolist()])
        fresh.clear()

    def encode_pieces(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, how many of each piece, whether it left the table) of pieces of a byte or more, none of them a token."""
        order = np.argsort(begin - end, kind="stable")  # long ones first: those that go on stand in front
        b, n = begin[order], (end - begin)[order]
        at, ends = np.cumsum(n) - n, np.empty(int(n.sum()), np.int32)
        state, left = np.zeros(len(n), np.int64), np.zeros(len(n), bool)
        held: dict[int, tuple] = {}
        fresh: dict[int, int] = {}
        for p in range(int(n[0]) if len(n) else 0):
            m = int(np.searchsorted(-n, -p, "left"))
            byte = data[b[:m] + p]
            key = state[:m] << 8 | byte
            to = np.full(m, -1, np.int64)
            if len(self.table):
                place = np.minimum(np.searchsorted(self.table, key), len(self.table) - 1)
                known = self.table[place] == key
                to[known] = self.after[place[known]]
            last = self.last[np.maximum(to, 0)]
            for i in np.flatnonzero(to < 0).tolist():
                own = int(state[i])
                number = fresh.get(int(key[i])) if own >= 0 else None
                if number is None:
                    number, after = self._step(own, held.pop(i, None), int(byte[i]))
                    last[i] = after[0]
                    if number < 0:
                        held[i], left[i] = after, True
                    elif own >= 0:
                        fresh[int(key[i])] = number
                else:
                    last[i] = self.last[number]
                to[i] = number
            ends[at[:m] + p] = last
            state[:m] = to
            if len(fresh) > 256:
                self._learn(fresh)
        self._learn(fresh)
        # back from the ends, a token of every piece at a time
        rest, on, count, rows = n.copy(), np.arange(len(n)), np.zeros(len(n), np.int64), []
        while len(on):
            token = ends[at[on] + rest[on] - 1]
            rows.append((on, token))
            count[on] += 1
            rest[on] -= self.sizes[token]
            on = on[rest[on] > 0]
        size, gone = np.empty(len(n), np.int64), np.empty(len(n), bool)
        size[order], gone[order] = count, left
        stop, ids = np.cumsum(size)[order], np.empty(int(count.sum()), np.uint32)
        for k, (on, token) in enumerate(rows):
            ids[stop[on] - 1 - k] = token
        return ids, size, gone

    def stream(self, blocks: Iterable[bytes]) -> Iterator[int]:
        """The ids of one piece that arrives in blocks, each as soon as it is certain."""
        state, held, wait = 0, None, 4 * self.longest
        ends: list[int] = []  # the last token of each prefix beyond what is emitted
        for block in blocks:
            for byte in block:
                state, held, end = self._moved(state, held, byte)
                ends.append(end)
                if len(ends) >= wait:
                    tokens = self._certain(ends)
                    yield from tokens
                    del ends[: sum(self.size_of[t] for t in tokens)]
                    wait = len(ends) + 4 * self.longest
        yield from self._back(len(ends), ends)

    def _back(self, n: int, ends: list[int]) -> list[int]:
        out = []
        while n > 0:
            out.append(ends[n - 1])
            n -= self.size_of[ends[n - 1]]
        return out[::-1]

    def _certain(self, ends: list[int]) -> list[int]:
        """The tokens that the ways to all places where a later token can start have in common."""
        paths = [self._back(n, ends) for n in range(len(ends) - self.longest, len(ends) + 1)]
        out = []
        for row in zip(*paths):
            if any(x != row[0] for x in row):
                break
            out.append(row[0])
        return out

    def encode_piece(self, piece: bytes) -> list[int]:
        """A piece that is itself a token is that token; else what the transducer emits."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(piece) > 4 * self.longest:
            return list(self.stream((piece,)))
        state, held, ends = 0, None, []
        for byte in piece:
            state, held, end = self._moved(state, held, byte)
            ends.append(end)
        return self._back(len(ends), ends)


_kinds: list[np.ndarray] = []


def _kind_of() -> np.ndarray:
    """0 white space, 1 letter, 2 number, 3 other, for each code point, as the pattern's engine has it."""
    if not _kinds:
        points = np.arange(0x110000, dtype="<u4")
        text = points.tobytes().decode("utf-32-le", "surrogatepass")
        kind = np.full(0x110000, 3, np.uint8)
        for k, what in ((0, r"\s+"), (1, r"\p{L}+"), (2, r"\p{N}+")):
            for m in regex.finditer(what, text):
                kind[m.start() : m.end()] = k
        _kinds.append(kind)
    return _kinds[0]


def piece_starts(text: str, doc_starts: np.ndarray) -> np.ndarray:
    """Where the matches of ``COMMON_PATTERN`` start (in code points), over texts that were
    put one behind the other and start at ``doc_starts``."""
    point = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    n = len(point)
    if n == 0:
        return np.zeros(0, np.int64)
    kind = _kind_of()[point]
    first = np.empty(n + 1, bool)  # of a run of one kind
    first[0] = first[n] = True
    np.not_equal(kind[1:], kind[:-1], out=first[1:n])
    own = np.zeros(n + 1, bool)
    own[doc_starts[doc_starts < n]] = True
    own[n] = True
    first |= own
    start = first.copy()
    run = np.flatnonzero(first)
    begin, end = run[:-1], run[1:]
    # white space before something: its last character stands alone, or joins what follows if it is a space
    last = end[(kind[begin] == 0) & ~own[end]] - 1
    start[last] = True
    start[last[point[last] == 32] + 1] = False
    # an apostrophe alone, with no space before it, and a short ending
    alone = begin[(point[begin] == 39) & (end - begin == 1) & ~own[end] & start[begin]]
    alone = alone[kind[np.minimum(alone + 1, n - 1)] == 1]
    if len(alone):
        padded = np.concatenate([point, np.zeros(2, point.dtype)])
        one, two = padded[alone + 1], np.where(own[np.minimum(alone + 2, n)], 0, padded[alone + 2])
        size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, 0)
        for a, b in ("re", "ve", "ll"):
            size[(one == ord(a)) & (two == ord(b))] = 2
        hit = size > 0
        start[alone[hit] + 1] = False
        start[alone[hit] + 1 + size[hit]] = True
    return np.flatnonzero(start[:n])


class Utf8Machine:
    """Bytes in blocks to text: an unfinished character waits for the next block.

    Bytes that are no UTF-8 become U+FFFD, as in a lenient decode of the whole.
    """

    def __init__(self) -> None:
        self.held = b""

    def feed(self, block: bytes) -> str:
        data = self.held + block
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b >= 0xC0:  # a first byte: it needs 2, 3 or 4 bytes in all
                if back < (2 if b < 0xE0 else 3 if b < 0xF0 else 4 if b < 0xF8 else 1):
                    cut -= back
                break
            if b < 0x80:
                break
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        text, self.held = self.held.decode("utf-8", "replace"), b""
        return text


class Codec:
    """Encoding and decoding of texts for one vocabulary and one pattern of pieces."""

    def __init__(self, lines: bytes, pattern: str) -> None:
        self.transducer = Transducer(load_ranks(lines))
        self.pattern = None if pattern == COMMON_PATTERN else regex.compile(pattern)
        #: Pieces that left the table and were used lately, and those used before them: a full set ousts the older one.
        self.pieces: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        top = max(self.transducer.bytes_of) + 1
        self.raw, self.raw_at = _rows([self.transducer.bytes_of.get(i, b"") for i in range(top)])
        self.decimal, self.decimal_at = _rows([b"%d," % i for i in range(top)])
        self.raw_size, self.decimal_size = np.diff(self.raw_at), np.diff(self.decimal_at)

    def _ids_of(self, data: np.ndarray, raw: bytes, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first, how many): those of piece k are ids[first[k]:first[k] + size[k]]."""
        own, ranks, got, walk = self.transducer, self.transducer.ranks, [], []
        for k, (a, b) in enumerate(zip(begin.tolist(), end.tolist(), strict=True)):
            piece = raw[a:b]
            whole = ranks.get(piece)
            if whole is not None:
                got.append((whole,))
            elif b - a > LONG_PIECE:
                got.append(own.encode_piece(piece))
            elif (known := self.pieces.get(piece) or self.older.get(piece)) is not None:
                self._keep(piece, known)
                got.append(np.frombuffer(known, "<u4").tolist())
            else:
                got.append(())
                walk.append(k)
        size = np.fromiter(map(len, got), np.int64, len(got))
        ids = np.fromiter((x for g in got for x in g), np.uint32, int(size.sum()))
        first = np.cumsum(size) - size
        if walk:
            at = np.array(walk)
            walked, n, gone = own.encode_pieces(data, begin[at], end[at])
            size[at], first[at] = n, len(ids) + np.cumsum(n) - n
            ids = np.concatenate([ids, walked])
            for k in at[gone].tolist():
                self._keep(raw[begin[k] : end[k]], ids[first[k] : first[k] + size[k]].astype("<u4").tobytes())
        return ids, first, size

    def _keep(self, piece: bytes, ids: bytes) -> None:
        if len(self.pieces) >= MOST_PIECES:
            self.older, self.pieces = self.pieces, {}
        self.pieces[piece] = ids

    def encode_chunk(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): the ids of document k of a chunk of UTF-8 are ids[bounds[k]:bounds[k + 1]].

        Equal pieces of a chunk are found by their hash, compared by their bytes and encoded once.
        """
        heads = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # first bytes of characters
        text = data.tobytes().decode("utf-8", "surrogatepass")
        doc = np.searchsorted(heads, off)
        if self.pattern is None:
            start = piece_starts(text, doc[:-1])
            begin, end = heads[start], heads[np.append(start[1:], len(heads) - 1)] if len(start) else start
        else:  # what lies between matches is left out
            spans = np.array([(a + m.start(), a + m.end()) for a, b in zip(doc[:-1], doc[1:], strict=True) for m in self.pattern.finditer(text[a:b]) if m.end() > m.start()], np.int64).reshape(-1, 2)
            begin, end = heads[spans[:, 0]], heads[spans[:, 1]]
        if not len(begin):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        _, pick, which = np.unique(word_hashes(data, begin, end), return_index=True, return_inverse=True)
        raw, sizes = data.tobytes(), end - begin
        if (sizes[pick][which] != sizes).any() or (_gather(data, begin, sizes, np.arange(len(begin))) != _gather(data, begin[pick], sizes[pick], which)).any():
            number: dict[bytes, int] = {}  # two pieces of one hash
            which = np.array([number.setdefault(raw[a:b], len(number)) for a, b in zip(begin.tolist(), end.tolist(), strict=True)], np.int64)
            pick = np.unique(which, return_index=True)[1]
        ids, first, size = self._ids_of(data, raw, begin[pick], end[pick])
        ids = _gather(ids, first, size, which)
        total = np.zeros(len(which) + 1, np.int64)
        np.cumsum(size[which], out=total[1:])
        return ids, total[np.searchsorted(begin, off, "left")]

    def encode(self, text: str) -> list[int]:
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        return self.encode_chunk(data, np.array([0, len(data)], np.int64))[0].tolist()

    def decimals(self, ids: np.ndarray) -> bytes:
        """Decimal ids, joined by commas."""
        return _gather(self.decimal, self.decimal_at, self.decimal_size, ids)[:-1].tobytes()

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return _gather(self.raw, self.raw_at, self.raw_size, ids).tobytes()

    def decode(self, ids: Iterable[int], block: int = 4096) -> Iterator[str]:
        """Text of the ids, block by block."""
        machine, ids = Utf8Machine(), np.fromiter(ids, np.int64)
        for k in range(0, len(ids), block):
            yield machine.feed(self.decode_bytes(ids[k : k + block]))
        yield machine.finish()


def _rows(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    bounds = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(x) for x in parts], out=bounds[1:])
    return np.frombuffer(b"".join(parts), np.uint8), bounds


def _gather(values: np.ndarray, begin: np.ndarray, size: np.ndarray, which: np.ndarray) -> np.ndarray:
    """values[begin[w] : begin[w] + size[w]] for each w of ``which``, one behind the other."""
    n = size[which]
    at = np.cumsum(n)
    if not len(at):
        return values[:0]
    return values[np.repeat(begin[which] - at + n, n) + np.arange(at[-1])]


_codecs: dict[tuple[bytes, str], Codec] = KEPT.setdefault("bpe", {})


def codec(lines: bytes, pattern: str) -> Codec:
    """The worker's codec; it is compiled once and goes on learning states and pieces."""
    key = (hashlib.sha256(lines).digest(), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(lines, pattern)
    return _codecs[key]


def vocabulary(path: str | None = None, pattern: str | None = None) -> tuple[bytes, str]:
    """(lines of the ranks file, pattern of pieces); by default the public multilingual 50k vocabulary."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return f.read(), pattern or public_tokenizers.PATTERN


def over_texts(docs: DataFrame, what: Callable, schema: str, path: str | None, pattern: str | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``what(codec, ids)`` gives the columns after doc_id for the ids of a document."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    lines, pattern = vocabulary(path, pattern)
    ranks = docs.sparkSession.sparkContext.broadcast(lines)  # some hundred KB, whatever the corpus
    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        only("bpe")
        own = codec(ranks.value, pattern)
        for b in batches:
            for i, j, data, off in chunks(b.column(1), 1 << 19):
                ids, bounds = own.encode_chunk(data, off)
                rows = [what(own, ids[x:y]) for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield batch(out, [b.column(0).slice(i, j - i), *zip(*rows, strict=True)])
        tidy()

    return ids_and_text(docs, id_col, text_col).mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, decode the ids again, and return digests of both.

    Columns: doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256
    (decoded bytes).  A null text counts as empty: no tokens, digests of nothing.  Repeated
    rows and ids give a row each; other columns of ``docs`` are not read.  Very long texts
    and pieces take time in proportion and are never cut.
    """

    def what(own: Codec, ids: np.ndarray) -> tuple:
        decimal, decoded, machine = hashlib.sha256(), hashlib.sha256(), Utf8Machine()
        for k in range(0, len(ids), 1 << 16):
            decimal.update((b"," if k else b"") + own.decimals(ids[k : k + (1 << 16)]))
            decoded.update(machine.feed(own.decode_bytes(ids[k : k + (1 << 16)])).encode("utf-8", "surrogatepass"))
        decoded.update(machine.finish().encode())
        return len(ids), decimal.hexdigest(), decoded.hexdigest()

    return over_texts(docs, what, OUTPUT, path, pattern, id_col, text_col)


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``ids``, the token ids of every whole text (an empty list for null)."""
    return over_texts(docs, lambda own, ids: (ids.tolist(),), "doc_id long, ids array<int>", path, pattern, id_col, text_col)


def decode(encoded: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and ``text`` from lists of ids; a null list gives an empty text, an unknown id fails."""
    lines, pattern = vocabulary(path, pattern)
    ranks = encoded.sparkSession.sparkContext.broadcast(lines)
    out = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        own = codec(ranks.value, pattern)
        for b in batches:
            yield batch(out, [b.column(0), ["".join(own.decode(x.as_py() or ())) for x in b.column(1)]])

    return encoded.select(encoded[id_col].cast("long").alias("doc_id"), encoded[ids_col].cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
