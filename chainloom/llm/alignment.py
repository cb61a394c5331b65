"""How two tokenizers cut the same bytes: groups between shared cuts, links between overlapping tokens, and how many
documents hold each link.

Both tokenizers cut wherever something other than white space is followed by white space, so a text falls into chunks (a
run of white space and what follows it) whose tokens, links and groups don't depend on their neighbours; workers
remember them. Two cuts of one line overlap in as many pairs as there are distinct cuts, so links are the union of token
ends and groups their intersection.

Counting is a cogroup of postings. A worker gathers blocks of documents; of each block and token id of side A one row
leaves, with the partners on side B and, for each, the block's documents and their multiplicities. Rows are dealt by side
id and sorted on disk within their partition; a task walks over one side id after another, counts the documents of each
pair, takes their maximum, and adds to sums for each document, which are added up by document at the end. A side id with
more than SLOT postings is dealt to several tasks by block; its counts are then added up beforehand, and each of these
tasks gets them (as many as side B has ids at most).
"""

from __future__ import annotations

import hashlib
import os
import re
import sys
import types
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.llm.common import settle, small_batches, text_of

#: Documents and characters of a block.
BLOCK_DOCS, BLOCK_CHARS = 4096, 8_000_000
#: Postings of a side id that one task takes.
SLOT = 4_000_000
#: Chunks that a worker remembers.
CACHED_CHUNKS = 400_000
#: Blocks whose documents a task holds sums for before it hands them on.
HELD_BLOCKS = 256

#: White space as pre-tokenizers see it (fixed values of Unicode), but for the carriage return, which side B joins with others.
_SPACE = r"\t\n\x0b\x0c \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CHUNK = re.compile(f"[{_SPACE}]+[^{_SPACE}]*")


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the others from
    U+0100 on.

    >>> (byte_alphabet()["A"], byte_alphabet()["Ġ"])
    (65, 32)
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Chunks of text as both tokenizers cut them. Everything about a chunk is kept under its number: how many tokens,
    groups and links, its groups as text, and its pairs of ids with how often each is linked."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = byte_alphabet()
        vocabulary = self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            if all(c in letters for c in token):
                self.bytes_a[i] = bytes(map(letters.__getitem__, token))
        n = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(n)]
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(x) for x in y], np.int64) for y in (self.bytes_a, self.bytes_b))
        self.names_a, self.names_b = ([str(i) for i in range(len(x))] for x in (self.bytes_a, self.bytes_b))
        self.space = self.b.piece_to_id("▁")
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[str] = []
        self.good = np.zeros(0, bool)
        self.stats = np.zeros((0, 4), np.int64)  # tokens of A and of B, groups, links
        self.starts = np.zeros(1, np.int64)
        self.pairs, self.times, self.uses = (np.zeros(0, np.int64) for _ in range(3))

    def chunks(self, text: str) -> list[str]:
        """The chunks of space+text; a text with a carriage return is one.

        >>> Aligner.chunks(None, "a bc\\n\\nd ")
        [' a', ' bc', '\\n\\nd', ' ']
        """
        return [" " + text] if "\r" in text else _CHUNK.findall(" " + text)

    def learn(self, new: list[str]) -> None:
        """Tokens of chunks not met so far."""
        for at in range(0, len(new), 20_000):
            self._learn(new[at : at + 20_000])

    def _learn(self, new: list[str]) -> None:
        ids_a = [e.ids for e in self.a.encode_batch_fast(new, add_special_tokens=False)]
        ids_b = self.b.encode([c[1:] if c[0] == " " else c for c in new], num_threads=1)
        for i, c in enumerate(new):
            if c == " ":
                ids_b[i] = [self.space]
            elif c[0] != " ":  # the space that side B put before it is a token of its own
                if ids_b[i][:1] != [self.space]:
                    raise ValueError(f"the tokenizer joins a space with {c[0]!r}")
                del ids_b[i][0]
        good = np.array([b"".join(map(self.bytes_a.__getitem__, a)) == b"".join(map(self.bytes_b.__getitem__, b)) == c.encode() for a, b, c in zip(ids_a, ids_b, new, strict=True)])
        for i in np.flatnonzero(~good).tolist():
            ids_a[i], ids_b[i] = [], []
        count_a, count_b = (np.fromiter(map(len, x), np.int64, len(new)) for x in (ids_a, ids_b))
        a, b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (ids_a, ids_b))
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        shared = np.intersect1d(ends_a, ends_b, assume_unique=True)
        cut_a, cut_b = (np.searchsorted(x, shared, "right").tolist() for x in (ends_a, ends_b))
        names_a, names_b = [self.names_a[i] for i in a.tolist()], [self.names_b[i] for i in b.tolist()]
        groups, p, q, k = [], 0, 0, 0
        for end in np.cumsum(count_a).tolist():
            own = []
            while p < end:
                p2, q2 = cut_a[k], cut_b[k]
                own.append(f"{','.join(names_a[p:p2])}|{','.join(names_b[q:q2])}")
                p, q, k = p2, q2, k + 1
            groups.append(";".join(own))
        links = np.union1d(ends_a, ends_b)
        at_a = np.searchsorted(ends_a, links)
        chunk = np.repeat(np.arange(len(new)), count_a)[at_a]
        wide = len(self.bytes_a) * len(self.bytes_b)
        keys, times = np.unique(chunk * wide + a[at_a] * len(self.bytes_b) + b[np.searchsorted(ends_b, links)], return_counts=True)
        n_groups = np.fromiter((g.count(";") + 1 if g else 0 for g in groups), np.int64, len(new))
        stats = np.stack([count_a, count_b, n_groups, np.bincount(chunk, minlength=len(new))], 1)
        self.known.update(zip(new, range(len(self.groups), len(self.groups) + len(new)), strict=True))
        self.groups += groups
        self.good = np.concatenate([self.good, good])
        self.stats = np.concatenate([self.stats, stats])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.bincount(keys // wide, minlength=len(new)))])
        self.pairs = np.concatenate([self.pairs, keys % wide])
        self.times = np.concatenate([self.times, times])
        self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)])

    def trim(self, most: int) -> None:
        """Beyond ``most`` chunks, only those met in several blocks stay, or none where these are too many."""
        if len(self.groups) <= most:
            return
        stay = self.uses > 1
        if stay.sum() > most // 2:
            self.forget()
            return
        old = np.flatnonzero(stay)
        place = np.cumsum(stay) - 1
        sizes = np.diff(self.starts)[old]
        own = np.repeat(stay, np.diff(self.starts))
        self.known = {c: int(place[i]) for c, i in self.known.items() if stay[i]}
        self.groups = [self.groups[i] for i in old.tolist()]
        self.good, self.stats, self.uses = self.good[old], self.stats[old], np.zeros(len(old), np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.pairs, self.times = self.pairs[own], self.times[own]

    def block(self, texts: list[str]) -> tuple[np.ndarray, list[str], tuple[np.ndarray, ...]]:
        """Of each text: tokens, groups, links and the hash of its groups; and of all: pair, text and multiplicity,
        in this order."""
        self.trim(CACHED_CHUNKS)
        split = [self.chunks(t) if t else [] for t in texts]
        distinct = set().union(*split)
        self.learn([c for c in distinct if c not in self.known])
        numbers = [list(map(self.known.__getitem__, s)) for s in split]
        sizes = np.fromiter(map(len, numbers), np.int64, len(texts))
        flat = np.fromiter(chain.from_iterable(numbers), np.int64, int(sizes.sum()))
        text = np.repeat(np.arange(len(texts)), sizes)
        good = np.bincount(text, ~self.good[flat], len(texts)) == 0
        stats = np.stack([np.bincount(text, self.stats[flat, k], len(texts)) for k in range(4)], 1).astype(np.int64) * good[:, None]
        hashes = [hashlib.sha256(";".join(map(self.groups.__getitem__, x)).encode()).hexdigest() if g and x else "" for x, g in zip(numbers, good.tolist(), strict=True)]
        met, often = np.unique((text << 32 | flat)[good[text]], return_counts=True)
        text, flat = met >> 32, met & 0xFFFFFFFF
        np.add.at(self.uses, np.unique(flat), 1)
        size = np.diff(self.starts)[flat]
        at = np.arange(int(size.sum())) + np.repeat(self.starts[flat] - np.cumsum(size) + size, size)
        key = self.pairs[at] * len(texts) + np.repeat(text, size)
        times = self.times[at] * np.repeat(often, size)
        order = np.argsort(key)
        key, times = key[order], times[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        return stats, hashes, (key[first] // max(1, len(texts)), key[first] % max(1, len(texts)), np.add.reduceat(times, first) if len(first) else times)


def aligner(path_a: str, path_b: str) -> Aligner:
    """This worker's tokenizers, with the chunks that its earlier tasks have learned."""
    held = sys.modules.setdefault("chainloom_worker", types.ModuleType("chainloom_worker")).__dict__
    if (path_a, path_b) not in held:
        held[path_a, path_b] = Aligner(path_a, path_b)
    return held[path_a, path_b]


DIGEST = "kind tinyint, block bigint, id {}, row int, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
POSTINGS = "a int, size bigint, partners binary, docs binary, entries binary, rows binary, times binary"


def _binary(values: np.ndarray, at: np.ndarray):
    """One binary for each range of ``values`` between entries of ``at``."""
    import pyarrow as pa

    offsets = (at * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


def postings(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", block_docs: int = BLOCK_DOCS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows of two kinds: a digest of each document (kind 0), and of each block and id of side A its postings (kind 1).
    Blocks have numbers of their own by chance, so the result must be settled before it is read twice."""
    if not 0 < block_docs <= 1 << 16:
        raise ValueError("a block holds 1 to 65536 documents")
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))

    def encode(batches) -> Iterator:
        import gc

        import pyarrow as pa

        both = aligner(path_a, path_b)
        gc.disable()  # nothing here makes cycles, and looking for them walks over many short lists
        n_b = len(both.bytes_b)
        names = [x.split()[0] for x in (DIGEST + ", " + POSTINGS).split(", ")]

        def close(ids: list, texts: list[str]) -> Iterator:
            ids_array = pa.chunked_array(ids).combine_chunks() if len(ids) > 1 else ids[0]
            block, n = uuid.uuid4().int >> 65, len(texts)
            stats, hashes, (pair, text, times) = both.block(texts)
            nothing = lambda kind, k: pa.nulls(k, kind)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, block)), ids_array, pa.array(np.arange(n, dtype=np.int32)),
                    *(pa.array(stats[:, k]) for k in range(4)), pa.array(hashes, pa.string()),
                    nothing(pa.int32(), n), nothing(pa.int64(), n), *(nothing(pa.binary(), n) for _ in range(5)),
                ], names=names,
            )
            # A multiplicity above 255 is several entries.
            each = (times + 254) // 255
            if len(each) and each.max() > 1:
                last = np.cumsum(each) - 1
                rest = times - 255 * (each - 1)
                pair, text, times = np.repeat(pair, each), np.repeat(text, each), np.full(int(each.sum()), 255)
                times[last] = rest
                fresh = np.ones(len(pair), bool)
                fresh[1:] = (pair[1:] != pair[:-1]) | (text[1:] != text[:-1])
            else:
                fresh = np.ones(len(pair), bool)
            starts = np.flatnonzero(np.diff(pair, prepend=-1))
            edges = np.append(starts, len(pair))
            sums = np.concatenate([[0], np.cumsum(fresh)])
            a, b = pair[starts] // n_b, pair[starts] % n_b
            of_a = np.append(np.flatnonzero(np.diff(a, prepend=-1)), len(a))
            for lo in range(0, len(of_a) - 1, 4000):
                at = of_a[lo : lo + 4001]
                p, e = slice(at[0], at[-1]), slice(edges[at[0]], edges[at[-1]])
                k = len(at) - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.ones(k, np.int8)), pa.array(np.full(k, block)), nothing(ids_array.type, k), nothing(pa.int32(), k),
                        *(nothing(pa.int64(), k) for _ in range(4)), nothing(pa.string(), k), pa.array(a[at[:-1]].astype(np.int32)),
                        pa.array(np.diff(edges[at])), _binary(b[p].astype("<u4"), at - at[0]), _binary(np.diff(sums[edges])[p].astype("<u4"), at - at[0]),
                        _binary(np.diff(edges)[p].astype("<u4"), at - at[0]), _binary(text[e].astype("<u2"), edges[at] - edges[at[0]]),
                        _binary(times[e].astype("u1"), edges[at] - edges[at[0]]),
                    ], names=names,
                )

        ids, texts, held, from_ = [], [], 0, 0
        for batch in batches:
            from_ = 0
            for i, t in enumerate(batch.column(1).to_pylist()):
                texts.append(t)
                held += len(t)
                if len(texts) == block_docs or held >= block_chars:
                    ids.append(batch.column(0).slice(from_, i + 1 - from_))
                    yield from close(ids, texts)
                    ids, texts, held, from_ = [], [], 0, i + 1
            if from_ < batch.num_rows:
                ids.append(batch.column(0).slice(from_))
        if texts:
            yield from close(ids, texts)

    return rows.mapInArrow(encode, DIGEST.format(rows.schema["id"].dataType.simpleString()) + ", " + POSTINGS)


def _numbers(column, kind: str) -> np.ndarray:
    """All numbers of a column of binaries, one after another."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)
    data = column.buffers()[2]
    return np.frombuffer(memoryview(data)[offsets[0] : offsets[-1]], kind) if data is not None else np.zeros(0, kind)


def _pairs(part, run: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of postings: the row of each pair of ids, its key (run and partner), and in how many documents it stands."""
    n = np.diff(np.frombuffer(part["partners"].buffers()[1], np.int32, part.num_rows + 1, 4 * part["partners"].offset)) // 4
    row = np.repeat(np.arange(part.num_rows), n)
    return row, run[row] << 32 | _numbers(part["partners"], "<u4").astype(np.int64), _numbers(part["docs"], "<u4").astype(np.int64)


def pair_counts(found: DataFrame) -> DataFrame:
    """Of settled postings: a, b, n (how many documents hold the pair linked)."""

    def unpack(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                _, key, docs = _pairs(batch, batch["a"].to_numpy().astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array((key >> 32).astype(np.int32)), pa.array((key & 0xFFFFFFFF).astype(np.int32)), pa.array(docs)], names=["a", "b", "n"])

    return found.filter("kind = 1").select("a", "partners", "docs").mapInArrow(unpack, "a int, b int, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))


def contributions(found: DataFrame, slot: int = SLOT, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Of settled postings: block, row, n_best, count_sum of each document that has links. A task's sums travel by block,
    as lists of documents, and are added up there."""
    held = found.filter("kind = 1").select("a", "block", "size", "partners", "docs", "entries", "rows", "times")
    sizes = settle(held.groupBy("a").agg(F.sum("size").alias("all")).withColumn("slots", F.ceil(F.col("all") / F.lit(slot)).cast("int")))
    # One row for each id of side A at most: a vocabulary's size bounds what is broadcast.
    dealt = held.join(F.broadcast(sizes.select("a", "slots")), "a")
    dealt = dealt.select("a", F.pmod(F.xxhash64("block"), F.col("slots")).cast("int").alias("slot"), "block", "partners", "docs", "entries", "rows", "times", F.lit(None).cast("array<struct<b:int,n:bigint>>").alias("given"))
    split = sizes.filter("slots > 1").select("a", "slots")
    if not split.isEmpty():
        counts = pair_counts(found.join(F.broadcast(split.select("a")), "a", "left_semi"))
        counts = counts.groupBy("a").agg(F.collect_list(F.struct("b", "n")).alias("given")).join(F.broadcast(split), "a")  # side B bounds a list
        none = [F.lit(None).cast("binary").alias(c) for c in ("partners", "docs", "entries", "rows", "times")]
        dealt = dealt.unionByName(counts.select("a", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), F.lit(None).cast("bigint").alias("block"), *none, "given"))
    dealt = dealt.repartition("a", "slot").sortWithinPartitions("a", "slot", F.col("block").asc_nulls_first())

    def walk(batches) -> Iterator:
        import pyarrow as pa

        blocks: dict[int, int] = {}
        sums = np.zeros((2, HELD_BLOCKS * block_docs))

        def rows_of(names: np.ndarray, at: np.ndarray, best: np.ndarray, total: np.ndarray) -> Iterator:
            """Sums by place, which are in order, as a row for each block."""
            edges = np.append(np.flatnonzero(np.diff(at // block_docs, prepend=-1)), len(at))
            for lo in range(0, len(edges) - 1, 64):
                ends = edges[lo : lo + 65]
                some, cuts = slice(ends[0], ends[-1]), ends - ends[0]
                columns = [_binary(x[some].astype(kind), cuts) for x, kind in ((at % block_docs, "<u2"), (best, "<i8"), (total, "<i8"))]
                yield pa.RecordBatch.from_arrays([pa.array(names[at[ends[:-1]] // block_docs]), *columns], names=["block", "rows", "best", "total"])

        def hand_on() -> Iterator:
            at = np.flatnonzero(sums[1])
            yield from rows_of(np.array(list(blocks), np.int64), at, *sums[:, at])
            blocks.clear()
            sums[:] = 0

        def add(part) -> Iterator:
            """Whole runs of a side id."""
            run = np.cumsum((np.diff(part["a"].to_numpy(), prepend=-1) != 0) | (np.diff(part["slot"].to_numpy(), prepend=-1) != 0)) - 1
            told = part["given"].is_valid().to_numpy(zero_copy_only=False)
            own = part.filter(pa.array(~told))
            if not own.num_rows:
                return
            row, key, docs = _pairs(own, run[~told])
            pairs, where = np.unique(key, return_inverse=True)
            counts = np.bincount(where, docs, len(pairs)).astype(np.int64)
            top = np.zeros(int(run[-1]) + 1, np.int64)
            np.maximum.at(top, pairs >> 32, counts)
            for r, given in zip(run[told].tolist(), part["given"].filter(pa.array(told)).to_pylist(), strict=True):
                b, n = (np.array([x[k] for x in given], np.int64) for k in ("b", "n"))
                order, mine = np.argsort(b), np.flatnonzero(pairs >> 32 == r)
                counts[mine] = n[order][np.searchsorted(b[order], pairs[mine] & 0xFFFFFFFF)]
                top[r] = n.max()
            distinct = pa.compute.unique(own["block"]).to_pylist()
            held = blocks
            if len(distinct) > HELD_BLOCKS:
                held = {x: i for i, x in enumerate(distinct)}
            else:
                if len(blocks.keys() | distinct) > HELD_BLOCKS:
                    yield from hand_on()
                for x in distinct:
                    blocks.setdefault(x, len(blocks))
            entries = _numbers(own["entries"], "<u4").astype(np.int64)
            base = np.fromiter(map(held.__getitem__, own["block"].to_pylist()), np.int64, own.num_rows)[row] * block_docs
            place = np.repeat(base, entries) + _numbers(own["rows"], "<u2")
            times = _numbers(own["times"], "u1").astype(np.float64)
            total = times * np.repeat(counts[where], entries)
            best = times * np.repeat(counts[where] == top[pairs >> 32][where], entries)
            if held is blocks:
                np.add.at(sums[1], place, total)
                np.add.at(sums[0], place, best)
            else:  # one side id in very many blocks: its sums are handed on at once
                at, where = np.unique(place, return_inverse=True)
                yield from rows_of(np.array(distinct, np.int64), at, np.bincount(where, best), np.bincount(where, total))

        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            a, slots = part["a"].to_numpy(), part["slot"].to_numpy()
            last = np.flatnonzero((a != a[-1]) | (slots != slots[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield from add(part.slice(0, cut))
            rest = part.slice(cut)
        if rest is not None:
            yield from add(rest)
        yield from hand_on()

    def total(batches) -> Iterator:
        import pyarrow as pa

        now, sums = None, np.zeros((2, block_docs), np.int64)

        def close() -> Iterator:
            at = np.flatnonzero(sums[1])
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), now)), pa.array(at.astype(np.int32)), *(pa.array(x[at]) for x in sums)], names=["block", "row", "n_best", "count_sum"])
            sums[:] = 0

        for batch in batches:
            for block, rows, best, all_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != now:
                    yield from close()
                    now = block
                at = np.frombuffer(rows, "<u2")  # each document once
                sums[0, at] += np.frombuffer(best, "<i8")
                sums[1, at] += np.frombuffer(all_, "<i8")
        yield from close()

    parts = dealt.mapInArrow(walk, "block bigint, rows binary, best binary, total binary")
    return parts.repartition("block").sortWithinPartitions("block").mapInArrow(total, "block bigint, row int, n_best bigint, count_sum bigint")


def align(
    docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text",
    slot: int = SLOT, block_docs: int = BLOCK_DOCS, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """One row per document: ``id_col``, n_a, n_b (tokens of either side), n_groups, n_links, n_best (links whose pair of
    ids is the most widespread one of its id of side A, ties included), count_sum (over links, in how many documents the
    pair is linked), groups_sha256.

    Edge cases: null and empty texts, and those whose bytes side B doesn't give back (they hold U+2581), have no tokens:
    zeros and an empty hash. Repeated rows are documents each. Null ids stay null. Very long texts are encoded whole, a
    block of documents at a time. An empty table gives no rows. Only the id and text columns are read.
    """
    with small_batches(docs.sparkSession):
        found = settle(postings(docs, path_a, path_b, id_col, text_col, block_docs, block_chars))
    with small_batches(docs.sparkSession, 2000):
        sums = settle(contributions(found, slot, block_docs))
    digest = found.filter("kind = 0").select(F.col("id").alias(id_col), "block", "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    out = digest.join(sums, ["block", "row"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(id_col, "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
