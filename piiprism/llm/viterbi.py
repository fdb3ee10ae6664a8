"""SentencePiece encoding by a streaming Viterbi search, and decoding.

Pieces come from a public SentencePiece model file. Its scores are the ranks of merges and no probabilities, so the
search has costs of its own, a fixed function of the rank that needs no training: a piece costs one unit and the square
root of its rank's share of the vocabulary (none for a single character), so few and early pieces win. The segmentation
of a text is the one with the least sum of costs (whole numbers, so sums are exact); of equal ones, the one whose last
piece is longest, then its last but one, and so on. Segmentations of one text differ from those of the merges in some
words; the README gives the share.

The search reads characters one at a time. It keeps a walk through the trie of pieces for each boundary from which a
piece may still go on, so no more of them than the longest piece has characters, and one back pointer for each
boundary since the last id that left. Whenever the paths of all these boundaries pass through one, the ids before it
are final and leave.

A character without a piece is spelt in byte pieces, as is a literal U+2581, so decoding restores every text
exactly. As in the model file, a text gets one space in front (dropped in decoding).

Nulls: a null text is empty, and an empty text has no ids; a null doc_id is kept. Repeated rows are rows of their
own; columns other than doc_id and text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

SPACE = "▁"
#: Stands for a literal U+2581; no text holds a lone surrogate.
LITERAL = "\udc81"
#: The cost of a piece at rank 0; that of the last rank is twice as much. A byte piece costs more than any other.
UNIT = 1 << 20
CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Characters of a chunk that is searched together with others, and how many of these at a time; a task remembers the
#: ids of KNOWN chunks or of those of its batch.
LONGEST, TOGETHER, KNOWN = 64, 20_000, 60_000


def chunks_of(text: str) -> list[str]:
    """The text with its first space, cut before each run of spaces; spaces are U+2581."""
    if not text:
        return []
    if SPACE in text:
        text = text.replace(SPACE, LITERAL)
    words = text.split(" ")
    return [SPACE + w for w in words] if "" not in words else CHUNK.findall(SPACE + text.replace(" ", SPACE))


class Steps:
    """The trie's steps (node, character) -> node as one hash table with open addressing."""

    def __init__(self, steps: dict[tuple[int, int], int]):
        self.bits = max(4, (4 * len(steps)).bit_length())
        self.keys, self.to = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        key = np.array([n << 21 | c for n, c in steps], np.int64)
        to, slot = np.array(list(steps.values()), np.int64), self.slot(key)
        while len(key):
            _, first = np.unique(slot, return_index=True)
            take = first[self.keys[slot[first]] < 0]
            self.keys[slot[take]], self.to[slot[take]] = key[take], to[take]
            left = np.ones(len(key), bool)
            left[take] = False
            key, to, slot = key[left], to[left], (slot[left] + 1) % len(self.keys)

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The next nodes, -1 where the trie has none."""
        key = node << 21 | char.astype(np.int64)
        slot = self.slot(key)
        out = np.where(self.keys[slot] == key, self.to[slot], -1)
        open_ = np.flatnonzero((out < 0) & (self.keys[slot] >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) % len(self.keys)
            out[open_] = np.where(self.keys[slot[open_]] == key[open_], self.to[slot[open_]], -1)
            open_ = open_[(out[open_] < 0) & (self.keys[slot[open_]] >= 0)]
        return out


class Model:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        if n > 65536:
            raise ValueError("ids are kept in two bytes")
        self.bytes, self.pieces = {}, {}
        self.spelt = []
        for i in range(n):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(p[3:5], 16)] = i
                self.spelt.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.spelt.append(b"")
            else:
                rank = 0 if len(p) == 1 else i
                self.pieces[p] = (UNIT + round(UNIT * math.sqrt(rank / n)), i)
                self.spelt.append(p.replace(SPACE, " ").encode())
        self.longest = max(map(len, self.pieces))
        self.byte_cost = 4 * UNIT
        if any(SPACE in p.lstrip(SPACE) for p in self.pieces):
            raise ValueError("a piece spans a word boundary")
        #: By character the next node; under the empty string, (cost, ids) of the piece that ends here.
        self.trie: dict = {}
        # the same trie by numbers of nodes, 0 the root
        steps: dict[tuple[int, int], int] = {}
        ends: dict[int, tuple[int, int]] = {}
        for p, (cost, i) in self.pieces.items():
            node, at = self.trie, 0
            for ch in p:
                node = node.setdefault(ch, {})
                at = steps.setdefault((at, ord(ch)), len(steps) + 1)
            node[""], ends[at] = (cost, (i,)), (cost, i)
        self.table = Steps(steps)
        self.piece_cost, self.piece_id = np.full(len(steps) + 1, -1, np.int64), np.full(len(steps) + 1, -1, np.int32)
        self.piece_cost[list(ends)], self.piece_id[list(ends)] = np.array(list(ends.values())).T

    def stream(self, chars: Iterable[str]) -> Iterator[int]:
        """Ids of a stream of characters (spaces already U+2581), each as soon as it is certain."""
        root = self.trie
        # boundaries since the last id that left, which is boundary 0: where the last piece of the best path to each
        # begins, the ids of that piece, and the first boundary on that path
        begin, ids, first = [0], [()], [0]
        walks, last = [(root, 0, 0)], 0  # node, cost of the path to the boundary where the walk began, that boundary
        for ch in chars:
            i = len(begin)
            best, alive = -1, []
            for node, cost, j in walks:  # the longest last piece first
                node = node.get(ch)
                if node is not None:
                    alive.append((node, cost, j))
                    hit = node.get("")
                    if hit is not None and (best < 0 or cost + hit[0] < best):
                        best, at, piece = cost + hit[0], j, hit[1]
            if best < 0 or "" not in root.get(ch, ()):  # no piece of its own
                spelt = self._spell(ch)
                cost = last + self.byte_cost * len(spelt)
                if best < 0 or cost < best:
                    best, at, piece = cost, i - 1, tuple(self.bytes[b] for b in spelt)
            begin.append(at)
            ids.append(piece)
            first.append(first[at] or i)
            last = best
            if not alive:  # all paths meet here
                yield from self._path(begin, ids, i)
                begin, ids, first, walks, last = [0], [()], [0], [(root, 0, 0)], 0
                continue
            alive.append((root, best, i))
            walks = alive
            while (b := first[-1]) < len(begin) - 1 and all(first[j] == b for _, _, j in walks):
                yield from ids[b]
                # the committed boundary becomes the first one
                begin, ids = [max(0, x - b) for x in begin[b:]], ids[b:]
                first = [0]
                for k in range(1, len(begin)):
                    first.append(first[begin[k]] or k)
                walks = [(node, cost, j - b) for node, cost, j in walks]
        yield from self._path(begin, ids, len(begin) - 1)

    @staticmethod
    def _path(begin: list[int], ids: list[tuple[int, ...]], i: int) -> list[int]:
        """The ids from boundary 0 to boundary i."""
        parts = []
        while i:
            parts.append(ids[i])
            i = begin[i]
        return [x for part in reversed(parts) for x in part]

    def _spell(self, ch: str) -> bytes:
        return (SPACE if ch == LITERAL else ch).encode()

    def search_together(self, chunks: list[str]) -> list[bytes]:
        """The same search over many chunks of at most LONGEST characters, one character of all of them at a time.

        A chunk's window holds all of it; its ids leave at its end, where all paths meet.
        """
        order = sorted(range(len(chunks)), key=lambda c: -len(chunks[c]))
        size = np.array([len(chunks[c]) for c in order])
        codes = np.frombuffer("".join(chunks[c] for c in order).encode("utf-32-le", "surrogatepass"), np.uint32)
        offset = np.cumsum(size) - size
        longest = int(size[0])
        begin, ids = np.zeros((longest + 1, len(order)), np.uint8), np.full((longest + 1, len(order)), -1, np.int32)
        last = np.zeros(len(order), np.int64)
        word, node, cost, start = np.arange(len(order)), np.zeros(len(order), np.int64), last, np.zeros(len(order), np.int64)
        for t in range(longest):
            n = int(np.searchsorted(-size, -t))  # chunks that go on
            on = word < n
            word, cost, start = word[on], cost[on], start[on]
            node = self.table.step(node[on], codes[offset[word] + t])
            on = node >= 0
            word, node, cost, start = word[on], node[on], cost[on], start[on]
            hit = np.flatnonzero(self.piece_cost[node] >= 0)
            key = (cost[hit] + self.piece_cost[node[hit]]) << 8 | start[hit]  # the least cost, then the longest piece
            best = np.full(n, np.iinfo(np.int64).max)
            np.minimum.at(best, word[hit], key)
            own = np.zeros(n, bool)
            own[word[hit[start[hit] == t]]] = True
            lacks = np.flatnonzero(~own)
            if len(lacks):
                c = codes[offset[lacks] + t]
                spelt = np.where(c == ord(LITERAL), 3, 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF))
                best[lacks] = np.minimum(best[lacks], (last[lacks] + self.byte_cost * spelt) << 8 | t)
            won = hit[key == best[word[hit]]]
            ids[t + 1, word[won]] = self.piece_id[node[won]]
            begin[t + 1, :n] = best & 255
            last = best >> 8
            word, node = np.concatenate([word, np.arange(n)]), np.concatenate([node, np.zeros(n, np.int64)])
            cost, start = np.concatenate([cost, last]), np.concatenate([start, np.full(n, t + 1)])
        live, at, steps = np.arange(len(order)), size.copy(), []
        while len(live):
            steps.append((live, ids[at, live]))
            at = begin[at, live].astype(np.int64)
            live, at = live[at > 0], at[at > 0]
        word, piece = (np.concatenate([s[k] for s in reversed(steps)]) for k in (0, 1))
        back = np.argsort(word, kind="stable")
        spelt = np.zeros(len(order), bool)
        spelt[word[piece < 0]] = True  # byte pieces: few, searched by themselves
        flat, ends = piece[back].astype("<u2").tobytes(), (2 * np.cumsum(np.bincount(word, minlength=len(order)))).tolist()
        out, a = [b""] * len(chunks), 0
        for k, c in enumerate(order):
            out[c] = self.search(chunks[c]) if spelt[k] else flat[a : ends[k]]
            a = ends[k]
        return out

    def search(self, chunk: str) -> bytes:
        return np.fromiter(self.stream(chunk), "<u2").tobytes()

    def encode(self, texts: list[str], known: dict[str, bytes] | None = None) -> list[bytes]:
        """Ids of each text as little-endian unsigned 16-bit integers.

        No piece holds a space after another character, so every path has a boundary before each run of spaces: the
        search converges there, and what lies between two such boundaries is searched once and remembered in `known`.
        """
        known = {} if known is None else known
        split = [chunks_of(t) for t in texts]
        new = set().union(*split).difference(known)
        short = [c for c in new if len(c) <= LONGEST]
        if len(known) + len(short) > KNOWN:
            known.clear()
            new = set().union(*split)
            short = [c for c in new if len(c) <= LONGEST]
        for a in range(0, len(short), TOGETHER):
            some = short[a : a + TOGETHER]
            known.update(zip(some, self.search_together(some), strict=True))
        long = {c: self.search(c) for c in new if len(c) > LONGEST}
        return [b"".join([known[c] if c in known else long[c] for c in chunks] if long else map(known.__getitem__, chunks)) for chunks in split]

    def decode(self, ids: bytes) -> str:
        spelt = self.spelt
        return b"".join([spelt[i] for i in np.frombuffer(ids, "<u2").tolist()]).decode()[1:]


@lru_cache(1)
def model(path: str) -> Model:
    return Model(path)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encoded(docs: DataFrame, model_file: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns to keep, ids (binary, unsigned 16-bit little-endian)."""
    path = model_file or default_model()
    names = ["doc_id", *keep]

    def run(batches):
        m = model(path)
        known: dict[str, bytes] = {}
        for b in batches:
            ids = m.encode([t or "" for t in b.column("text").to_pylist()], known)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(ids, pa.binary())], [*names, "ids"])

    kinds = ", ".join(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in names)
    return docs.select(*names, "text").mapInArrow(common.lean(run), f"{kinds}, ids binary")


def decoded(ids: DataFrame, model_file: str | None = None) -> DataFrame:
    """doc_id, text."""
    path = model_file or default_model()

    def run(batches):
        m = model(path)
        for b in batches:
            texts = [m.decode(x) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return ids.mapInArrow(common.lean(run), f"doc_id {ids.schema['doc_id'].dataType.simpleString()}, text string")


def token_table(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), n_chars, restored
    (whether decoding the ids gives the text again)."""
    path = model_file or default_model()

    def run(batches):
        m = model(path)
        known: dict[str, bytes] = {}
        for b in batches:
            rows, texts = [], [t or "" for t in b.column("text").to_pylist()]
            for t, ids in zip(texts, m.encode(texts, known), strict=True):
                wide = np.frombuffer(ids, "<u2").astype("<u4")
                rows.append((len(wide), zlib.crc32(wide), len(t), m.decode(ids) == t))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.bool_())],
                ["doc_id", "n_tokens", "ids_crc32", "n_chars", "restored"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(common.lean(run), f"doc_id {kind}, n_tokens long, ids_crc32 long, n_chars long, restored boolean")


def op5(spark, sf_dir: str) -> DataFrame:
    return token_table(common.table(spark, sf_dir, "documents"))
