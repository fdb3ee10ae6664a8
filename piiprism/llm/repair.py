"""Token ids in a grammar-compressed binary format (Re-Pair).

Documents are ordered by doc_id over range partitions, encoded with a public byte-level BPE vocabulary, ended by
END, and cut into shards of about SHARD_IDS ids. Of each shard, frequent pairs of neighbouring symbols are replaced
by nonterminals again and again (Re-Pair; a round replaces many pairs at once, the most frequent first where they
overlap) until no pair is frequent or all symbols are used. A shard keeps its rules, the length that each rule
expands to, the final sequence with a running length every SKIP symbols, and the documents' ids and lengths, so any
stretch of ids decodes without the rest. Symbols take two bytes: 65,536 less the vocabulary are rules.

A shard is one row of a Parquet table: part, shard, doc_ids, lengths, rules, rule_lengths, sequence, skips (binary,
little-endian), n_ids, before (the ids of the earlier shards of its part).

Nulls: a null text is empty (END alone); null doc_ids come first. Rows that repeat a doc_id follow one another in
the order of their texts. Columns other than doc_id and text are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

END = 2
SHARD_IDS = 1 << 19
SKIP = 256
#: Replacement stops when no pair occurs so often.
FREQUENT = 6
#: Pieces of text that a worker remembers the ids of.
CACHE_WORDS = 1_000_000
#: White space in runs of space and line feed, and all other white space.
RUNS = ("  ", "\n\n", " \n", "\n ")
OTHER_SPACE = tuple(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")
#: Bits of a place in the hash table of pairs.
PLACE_BITS = 18
#: Text bytes in a partition, about.
PART_CHARS = 16 << 20


class Encoder:
    """The tokenizers library over whole texts.

    The vocabulary's pre-tokenizer never joins a character and white space after it, so a text falls into pieces that
    begin with white space and are encoded alone with the same ids, and a stop or comma after a letter or digit begins
    a piece as well; the library encodes each distinct piece once.
    Texts for which this cut is not plain (white space in runs, special tokens) go to the library whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks share the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        #: Bytes of each id: a byte-level vocabulary spells every byte as one character.
        self.width = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(self.size)])
        self.known: dict[str, bytes] = {}
        self.stops = re.compile(r"[.,](?<![^\W_][.,])")

    def odd(self, text: str) -> bool:
        """Whether white space stands in a run, or any of it is neither space nor line feed."""
        if any(s in text for s in RUNS) or any(s in text for s in OTHER_SPACE if s.isascii()):
            return True
        return not text.isascii() and any(s in text for s in OTHER_SPACE if not s.isascii())

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("H", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def together(self, names: list[str], pieces: list[str]) -> Iterator[tuple[str, bytes]]:
        """(name, ids) of pieces that are encoded as one text and told apart by their bytes."""
        if not names:
            return
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(pieces)], add_special_tokens=False)[0].ids, "<u2")
        ends = np.cumsum(np.fromiter((len(p.encode()) for p in pieces), np.int64, len(pieces)))
        cuts = (2 * (np.searchsorted(np.cumsum(self.width[ids]), ends) + 1)).tolist()
        flat, a = ids.tobytes(), 0
        for name, b in zip(names, cuts, strict=True):
            yield name, flat[a:b]
            a = b

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids (unsigned 16-bit, of this machine's byte order) of each text."""
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        known, cut, late = self.known, [], []
        for i, t in enumerate(texts):
            if not t or self.odd(t) or "\1" in t or any(s in t for s in self.special):
                cut.append(None)
                late.append(i)
                continue
            # "\1" marks a piece that no space precedes: the first one, line feeds, stops and commas after a word
            t = "\1" + t.replace("\n", " \1\n")
            if not self.stops.search(t):
                t = t.replace(".", " \1.").replace(",", " \1,")
            cut.append(t)
        # Arrow cuts the texts and tells which pieces are the same: each distinct one is looked up once
        each = pc.split_pattern(pa.array(cut, pa.large_string()), " ")
        ends = np.cumsum(pc.fill_null(pc.list_value_length(each), 0).to_numpy())
        coded = each.flatten().dictionary_encode()
        which, pieces = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        del each, coded
        # pieces that begin with one kind of white space can follow one another in one text; others go alone
        spaced, lines, alone = [], [], []
        for p in pieces:
            if p not in known:
                (alone if len(p) < 2 else spaced if p[0] != "\1" else lines if p[1] == "\n" and len(p) > 2 else alone).append(p)
        known.update(self.together(spaced, [" " + p for p in spaced]))
        known.update(self.together(lines, [p[1:] for p in lines]))
        known.update(zip(alone, self.whole([p[1:] if p[:1] == "\1" else " " + p for p in alone]), strict=True))
        ids = [known[p] for p in pieces]
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 2
        # where the ids of each piece stand, and where they go
        width = size[which]
        stop = np.cumsum(width)
        place = np.repeat((np.cumsum(size) - size)[which] - (stop - width), width)
        place += np.arange(len(place))
        flat = np.frombuffer(b"".join(ids), np.uint16)[place]
        stops = np.append(0, stop)[ends].tolist()
        out = [flat[a:b].tobytes() for a, b in zip([0, *stops], stops, strict=False)]
        for i, ids in zip(late, self.whole([texts[i] or "" for i in late]), strict=True):
            out[i] = ids
        return out


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _place(pairs: np.ndarray) -> np.ndarray:
    return (pairs * np.uint32(0x9E3779B1)) >> np.uint32(32 - PLACE_BITS)


def compress(ids: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, rules): rule r stands for the symbols rules[r] and is the symbol base + r."""
    seq = ids.astype(np.uint32)
    rules: list[np.ndarray] = []
    used = 0
    while len(seq) > 1 and base + used < 65536:
        pairs = (seq[:-1] << np.uint32(16)) | seq[1:]
        ordered = np.sort(pairs)
        # a pair that is frequent begins where it differs from the one before and not from the one FREQUENT - 1 after
        new = np.append(True, ordered[1:] != ordered[:-1])
        more = len(ordered) - FREQUENT + 1
        often = np.flatnonzero(new[:more] & (ordered[:more] == ordered[FREQUENT - 1 :])) if more > 0 else ()
        if not len(often):
            break
        first = np.append(np.flatnonzero(new), len(ordered))
        counts = first[np.searchsorted(first, often) + 1] - often
        # a share of the symbols for each round, so that later rounds can build on this one's
        room = min(65536 - base - used, max(256, (65536 - base) // 3))
        chosen = (np.sort(((1 << 31) - counts << 32) | ordered[often].astype(np.int64))[:room] & 0xFFFFFFFF).astype(np.uint32)
        # a pair's rule by a hash table of pairs; a pair that shares its place with a more frequent one has to wait
        table = np.full(1 << PLACE_BITS, len(chosen), np.int16)
        table[_place(chosen)[::-1]] = np.arange(len(chosen), dtype=np.int16)[::-1]
        none = np.int16(len(chosen))
        rank = table.take(_place(pairs), mode="clip")
        np.copyto(rank, none, where=np.append(chosen, np.uint32(0)).take(rank, mode="clip") != pairs)
        # of overlapping pairs the more frequent one is replaced; of equal ones every other, from the left
        prev = np.append(none, rank[:-1])
        take = rank < prev
        take &= rank <= np.append(rank[1:], none)
        rest = np.flatnonzero((rank == prev) & (rank != none))
        if len(rest):  # runs of one symbol: positions of a run at an even distance from its start
            begin = np.maximum.accumulate(np.where(np.append(True, rest[1:] != rest[:-1] + 1), rest - 1, 0))
            take[rest[(rest - begin) % 2 == 0]] = True
        take[1:] &= ~take[:-1]
        at = np.flatnonzero(take)
        if not len(at):
            break
        seq[at] = base + used + rank[at].astype(np.uint32)
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq = seq[keep]
        rules.append(np.stack([chosen >> np.uint32(16), chosen & np.uint32(0xFFFF)], axis=1))
        used += len(chosen)
    table = np.concatenate(rules) if rules else np.empty((0, 2), np.uint32)
    return seq.astype("<u2"), table.astype("<u2")


def rule_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """Ids that each symbol stands for (terminals 1), by symbol."""
    n = np.ones(base + len(rules), np.int64)
    top = np.maximum.accumulate(rules.max(axis=1, initial=0).astype(np.int64)) - base
    a = 0
    while a < len(rules):  # as many rules at once as need none of each other
        b = int(np.searchsorted(top, a, "left"))
        n[base + a : base + b] = n[rules[a:b, 0]] + n[rules[a:b, 1]]
        a = b
    return n


def expand(seq: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The ids of a sequence of symbols."""
    seq = seq.astype(np.uint32)
    while len(seq):
        big = seq >= base
        if not big.any():
            break
        width = 1 + big.astype(np.int64)
        start = np.cumsum(width) - width
        out = np.empty(int(width.sum()), np.uint32)
        out[start[~big]] = seq[~big]
        both = rules[seq[big] - base]
        out[start[big]], out[start[big] + 1] = both[:, 0], both[:, 1]
        seq = out
    return seq


def expand_shard(seq: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """As expand, for a whole shard: every rule is expanded once, and the ids are copied from there."""
    n = rule_lengths(rules, base)
    ids = np.concatenate([np.arange(base, dtype=np.uint32), expand(np.arange(base, base + len(rules), dtype=np.uint32), rules, base)])
    width = n[seq]
    place = np.repeat((np.cumsum(n) - n)[seq] - (np.cumsum(width) - width), width)
    place += np.arange(len(place))
    return ids[place]


def stretch(shard: dict, start: int, n: int, base: int) -> np.ndarray:
    """Ids [start, start + n) of a shard, from the symbols that hold them."""
    seq, rules = np.frombuffer(shard["sequence"], "<u2"), np.frombuffer(shard["rules"], "<u2").reshape(-1, 2)
    lengths = np.concatenate([np.ones(base, np.int64), np.frombuffer(shard["rule_lengths"], "<u4")])
    skips = np.frombuffer(shard["skips"], "<i8")  # ids before each SKIP-th symbol
    a = int(np.searchsorted(skips, start, "right")) - 1
    b = int(np.searchsorted(skips, start + n, "left"))
    part = seq[a * SKIP : b * SKIP]
    before = int(skips[a]) + np.cumsum(lengths[part]) - lengths[part]
    lo = int(np.searchsorted(before, start, "right")) - 1
    hi = int(np.searchsorted(before, start + n, "left"))
    ids = expand(part[lo:hi], rules, base)
    return ids[start - int(before[lo]) :][:n] if n else ids[:0]


SHARD = "part int, shard int, doc_ids binary, null_ids binary, lengths binary, rules binary, rule_lengths binary, sequence binary, skips binary, n_ids long, before long"


def shards(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """The shard table (not written yet)."""
    path = vocabulary or default_vocabulary()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chars = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-chars // PART_CHARS))
    ordered = texts.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, no, before = TaskContext.get().partitionId(), 0, 0
        e = encoder(path)
        base = e.size
        ids, docs_in, sizes, held = [], [], [], 0

        def shard():
            flat = np.frombuffer(b"".join(ids), "<u2")
            seq, rules = compress(flat, base)
            n = rule_lengths(rules, base)
            ends = np.cumsum(n[seq])
            skips = np.append(0, ends[SKIP - 1 :: SKIP])[: -(-len(seq) // SKIP)]
            row = {
                "part": part, "shard": no, "doc_ids": np.array([d or 0 for d in docs_in], "<i8").tobytes(), "null_ids": np.array([d is None for d in docs_in], np.uint8).tobytes(),
                "lengths": np.array(sizes, "<u4").tobytes(), "rules": rules.tobytes(), "rule_lengths": n[base:].astype("<u4").tobytes(), "sequence": seq.tobytes(), "skips": skips.astype("<i8").tobytes(),
                "n_ids": len(flat), "before": before,
            }
            return pa.RecordBatch.from_pylist([row], schema), len(flat)

        schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), *((c, pa.binary()) for c in ("doc_ids", "null_ids", "lengths", "rules", "rule_lengths", "sequence", "skips")), ("n_ids", pa.int64()), ("before", pa.int64())])
        end = np.array([END], "<u2").tobytes()
        for b in batches:
            all_texts = b.column("text").to_pylist()
            all_ids = b.column("doc_id").to_pylist()
            for a in range(0, len(all_texts), 1024):
                for d, got in zip(all_ids[a : a + 1024], e.encode(all_texts[a : a + 1024]), strict=True):
                    ids.append(got + end)
                    docs_in.append(d)
                    sizes.append(len(got) // 2 + 1)
                    held += sizes[-1]
                    if held >= SHARD_IDS:
                        batch, n = shard()
                        yield batch
                        ids, docs_in, sizes, held, no, before = [], [], [], 0, no + 1, before + n
        if docs_in:
            yield shard()[0]

    return ordered.mapInArrow(run, SHARD)


def read_back(table: DataFrame, base: int) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, from a written shard table."""
    # one row for each partition of the writing job
    totals = table.groupBy("part").agg(F.sum("n_ids").alias("n"))
    offsets = totals.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("offset"))
    rows = table.join(offsets, "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids = expand_shard(np.frombuffer(r["sequence"], "<u2"), np.frombuffer(r["rules"], "<u2").reshape(-1, 2), base).astype("<u4")
                sizes = np.frombuffer(r["lengths"], "<u4").astype(np.int64)
                ends = np.cumsum(sizes)
                starts = ends - sizes
                crc = [zlib.crc32(ids[x:y]) for x, y in zip(starts.tolist(), ends.tolist(), strict=True)]
                null = np.frombuffer(r["null_ids"], np.uint8).astype(bool)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(r["doc_ids"], "<i8"), mask=null), pa.array(starts + r["offset"] + r["before"]), pa.array(sizes), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return rows.select("lengths", "doc_ids", "null_ids", "rules", "sequence", "offset", "before").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2(spark, sf_dir: str) -> DataFrame:
    table = common.written(shards(common.table(spark, sf_dir, "documents")), "repair-shards")
    return read_back(table, encoder(default_vocabulary()).size)
