"""Best-fit packing of token sequences by exact-complement hashing.

Documents become token ids with a closing id, cut into pieces of at most the sequence length. Packing itself needs
only how many pieces there are of each length: at most ``max_tokens`` numbers, whatever the corpus. The driver indexes
the lengths still available, their pair sums and triple sums, and for the longest piece takes the single, pair or
triple that fills its gap exactly, as many times at once as the counts allow. What has no exact complement is packed
best fit. The result is a short list of patterns with numbers of copies; every piece then finds its own place by its
rank among the pieces of its length. Ranks come from counts of hash buckets, so a length that a third of all pieces
share is never ordered in one task.
"""

from __future__ import annotations

import os
import re
import sys
import types
from bisect import insort

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chainloom.llm.common import settle, small_batches, text_of

MAX_TOKENS = 2048
END_ID = 0
#: Hash buckets of each length, for ranks.
BUCKETS = 256
#: Words whose ids a worker remembers before it forgets those it met in one batch only.
CACHED_WORDS = 500_000

Pattern = tuple[tuple[int, int], ...]  # (length, how often) of a sequence's pieces


class WordIds:
    """Token ids of a text as bytes of little-endian 32-bit numbers.

    The tokenizer lower-cases, splits at white space before anything else, and marks the last token of each run of
    letters; so the ids of a text are those of its words one after another. Words are remembered. New ones are encoded
    many at a time, and a run of letters with a full stop or comma behind it is put together from its two parts.
    Special tokens are matched before lower-casing, so a text that holds one in any case goes to the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.again: set[str] = set()  # words met in more than one batch
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.hint = os.path.commonprefix(self.special)

    def _holds_special(self, text: str) -> bool:
        return self.hint in text.lower() and any(s in text.lower() for s in self.special)

    def of(self, texts: list[str]) -> list[bytes]:
        if odd := [i for i, t in enumerate(texts) if self.special and self.hint[:1] in t and self._holds_special(t)]:
            whole = {i: np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, "<u4").tobytes() for i in odd}
            plain = iter(self.of([t for i, t in enumerate(texts) if i not in whole]))
            return [whole[i] if i in whole else next(plain) for i in range(len(texts))]
        split = [words_of(t) for t in texts]
        distinct = set().union(*split)
        new = distinct.difference(self.known)
        if len(self.known) + len(new) > CACHED_WORDS:
            kept = self.again if len(self.again) < CACHED_WORDS // 2 else distinct - new
            self.known = {w: self.known[w] for w in kept}
            self.again = set()
            new = distinct.difference(self.known)
        self.again |= distinct - new
        self._learn(new)
        get = self.known.__getitem__
        return [b"".join(map(get, words)) for words in split]

    def _learn(self, new: set[str]) -> None:
        known, bases, parts, alone = self.known, [], [], []
        for word in new:
            if word.isalpha():
                bases.append(word)
            elif word[-1] in ".," and (base := word[:-1]).isalpha():
                parts.append((word, base, word[-1]))
            else:
                alone.append(word)
        self._letters(list({base for _, base, _ in parts}.difference(known).union(bases)), alone)
        alone += [t for t in (".", ",") if t not in known]
        for at in range(0, len(alone), 5000):
            few = alone[at : at + 5000]
            for word, e in zip(few, self.tokenizer.encode_batch_fast(few, add_special_tokens=False), strict=True):
                known[word] = np.array(e.ids, "<u4").tobytes()
        for word, base, tail in parts:
            known[word] = known[base] + known[tail]

    def _letters(self, bases: list[str], alone: list[str]) -> None:
        groups = [bases[at : at + 500] for at in range(0, len(bases), 500)]
        coded = self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)
        for group, e in zip(groups, coded, strict=True):
            ids = np.array(e.ids, "<u4")
            ends = (np.flatnonzero(self.ends[ids]) * 4 + 4).tolist()
            if len(ends) != len(group):  # a letter that falls apart in lower case
                alone += group
                continue
            raw, lo = ids.tobytes(), 0
            for word, hi in zip(group, ends, strict=True):
                self.known[word] = raw[lo:hi]
                lo = hi


def word_ids(path: str) -> WordIds:
    """The tokenizer of this worker process, with the words that its earlier tasks have learned."""
    held = sys.modules.setdefault("chainloom_worker", types.ModuleType("chainloom_worker")).__dict__
    if path not in held:
        held[path] = WordIds(path)
    return held[path]


def words_of(text: str) -> list[str]:
    """Words between white space as Unicode has it, A-Z in lower case, which the tokenizer would do itself; the four
    separators U+001C to U+001F are not white space.

    >>> words_of(" A\\tb\\x1cc ")
    ['a', 'b\\x1cc']
    """
    text = text.lower() if text.isascii() else text.encode().lower().decode()
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return [w for w in _SPACES.split(text) if w]
    return text.split()


_SPACES = re.compile(r"[^\S\x1c-\x1f]+")


def token_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS, with_ids: bool = False) -> DataFrame:
    """Pieces of the documents: ``id_col``, piece, start, length, ids_crc32 and, if asked for, ids."""
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids array<bigint>" if with_ids else "")
    end = np.array([END_ID], "<u4").tobytes()

    def encode(batches):
        import gc
        import zlib

        import pyarrow as pa

        words = word_ids(tokenizer_path)
        gc.disable()  # nothing here makes cycles, and looking for them walks over many short lists
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out: dict[str, list] = {n: [] for n in ("row", "piece", "start", "length", "ids_crc32", "ids")}
                for row, ids in enumerate(words.of(part.column(1).to_pylist())):
                    ids += end
                    for piece, lo in enumerate(range(0, len(ids), 4 * max_tokens)):
                        own = ids[lo : lo + 4 * max_tokens]
                        for n, v in zip(out, (row, piece, lo // 4, len(own) // 4, zlib.crc32(own), np.frombuffer(own, "<u4") if with_ids else None), strict=True):
                            out[n].append(v)
                columns = [part.column(0).take(pa.array(out["row"], pa.int64())), pa.array(out["piece"], pa.int32()), *(pa.array(out[n], pa.int64()) for n in ("start", "length", "ids_crc32"))]
                if with_ids:
                    columns.append(pa.array(out["ids"], pa.list_(pa.int64())))
                names = ["id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(encode, schema).withColumnRenamed("id", id_col)


def plan_sequences(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Patterns and how many sequences follow each, for so many pieces of each length.

    >>> plan_sequences({6: 2, 4: 1, 3: 1, 1: 1}, 10)
    [(((6, 1), (4, 1)), 1), (((6, 1), (3, 1), (1, 1)), 1)]
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    out: list[tuple[Pattern, int]] = []

    def use(*lengths: int) -> None:
        """As many sequences of these lengths as there are pieces for."""
        kinds = {x: lengths.count(x) for x in lengths}
        n = int(min(left[x] // k for x, k in kinds.items()))
        for x, k in kinds.items():
            left[x] -= k * n
        out.append((tuple(sorted(kinds.items(), reverse=True)), n))

    def pair(total: int, held: dict[int, int]) -> tuple[int, int] | None:
        """The pair with this sum and the largest first part, beside what is held already."""
        if total < 2:
            return None
        have = left[: total + 1].copy()
        for x, k in held.items():
            if x <= total:
                have[x] -= k
        low = (total + 1) // 2
        both = (have[low:total] > 0) & (have[total - low : 0 : -1] > 0)
        if total % 2 == 0:
            both[0] = have[low] > 1
        found = np.flatnonzero(both)
        return (low + int(found[-1]), total - low - int(found[-1])) if len(found) else None

    if left[capacity]:
        use(capacity)
    rest: list[int] = []
    for length in range(capacity - 1, 0, -1):
        sums = None
        while left[length] > 0:
            gap = capacity - length
            if left[gap] > (1 if gap == length else 0):
                use(length, gap)
                continue
            if two := pair(gap, {length: 1}):
                use(length, *two)
                continue
            if sums is None:  # which sums some pair has, counts aside; lengths only leave, so no sum appears later
                here = (left[: gap + 1] > 0).astype(np.float32)
                sums = np.convolve(here, here)[: gap + 1] > 0.5 if gap >= 3 else np.zeros(gap + 1, bool)
            third = np.flatnonzero((left[: gap + 1] > 0) & sums[::-1])[::-1]
            for a in map(int, third):
                if a == length and left[length] < 2:
                    continue
                if two := pair(gap - a, {length: 1} | {a: 1 + (a == length)}):
                    use(length, a, *two)
                    break
                sums[gap - a] = False
            else:
                rest.append(length)
                break
    return out + _best_fit({x: int(left[x]) for x in rest}, capacity)


def _best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Longest first, each into the open sequences with the least room that is enough."""
    open_: list[tuple[int, int]] = []  # (room, serial), sorted
    held: dict[int, tuple[dict[int, int], int]] = {}
    serial = 0

    def add(room: int, lengths: dict[int, int], copies: int) -> None:
        nonlocal serial
        held[serial] = (lengths, copies)
        insort(open_, (room, serial))
        serial += 1

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            at = next((i for i, (room, _) in enumerate(open_) if room >= length), None)
            if at is None:
                each = min(capacity // length, n)
                add(capacity - each * length, {length: each}, n // each)
                n -= each * (n // each)
                continue
            room, key = open_.pop(at)
            lengths, copies = held.pop(key)
            each = min(room // length, max(1, n // copies))
            used = min(copies, n // each)
            add(room - each * length, lengths | {length: lengths.get(length, 0) + each}, used)
            if used < copies:
                add(room, lengths, copies - used)
            n -= each * used
    return [(tuple(sorted(lengths.items(), reverse=True)), copies) for lengths, copies in held.values()]


def _slots(plan: list[tuple[Pattern, int]]) -> np.ndarray:
    """Rows (key of length and first rank, pieces of that length in a sequence, first sequence, first offset), sorted."""
    next_rank: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, copies in plan:
        offset = 0
        for length, each in pattern:
            rank = next_rank.get(length, 0)
            rows.append(((length << 44) | rank, each, sequence, offset))
            next_rank[length] = rank + each * copies
            offset += each * length
        sequence += copies
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
    max_tokens: int = MAX_TOKENS, buckets: int = BUCKETS, with_ids: bool = False,
) -> DataFrame:
    """One row per piece: ``id_col``, piece, start, length, ids_crc32, sequence_id, offset and, if asked for, ids.

    A document's tokens are its ids and a closing id 0; only documents of more than ``max_tokens`` tokens are cut, into
    pieces of that many and a last, shorter one. A sequence holds at most ``max_tokens`` tokens, its offsets have no gap.

    Edge cases: a null or empty text is one piece of the closing id alone. Repeated rows are packed each. Null ids stay
    null. Pieces of equal length are interchangeable; ties are dealt by hash, id and piece. Very long texts are encoded
    whole, a few documents at a time. An empty table gives no rows. Only the id and text columns are read, so names of
    others don't matter.
    """
    with small_batches(docs.sparkSession):
        pieces = settle(token_pieces(docs, tokenizer_path, id_col, text_col, max_tokens, with_ids))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    before = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    counts = settle(dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")))
    bases = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select("length", "bucket", "base")
    # At most max_tokens rows come to the driver.
    histogram = {int(r[0]): int(r[1]) for r in counts.groupBy("length").agg(F.sum("n")).collect()}
    slots = _slots(plan_sequences(histogram, max_tokens))
    inner = W.partitionBy("length", "bucket").orderBy(id_col, "piece", "ids_crc32")
    ranked = dealt.withColumn("nth", F.row_number().over(inner) - 1).join(bases, ["length", "bucket"])
    ranked = ranked.select(*pieces.columns, (F.col("base") + F.col("nth")).alias("rank"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id bigint, offset bigint"

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            slot = slots[np.searchsorted(slots[:, 0], (length << 44) | rank, side="right") - 1] if batch.num_rows else slots[:0]
            nth = rank - (slot[:, 0] & ((1 << 44) - 1))
            sequence, offset = slot[:, 2] + nth // slot[:, 1], slot[:, 3] + nth % slot[:, 1] * length
            kept = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                names=[*kept, "sequence_id", "offset"],
            )

    return ranked.mapInArrow(place, schema)
