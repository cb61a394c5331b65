"""Token counts that follow edits.

A text is cut into pre-tokens by the tokenizer's pattern; each is encoded by itself, so counts add up. A document keeps
a segment tree over runs of pre-tokens, each node with the characters and tokens below it. An edit walks down to the
leaves it touches, cuts and encodes anew only from the first pre-token that could see the edit to the first cut that
falls together with an old one behind it, puts the result into the first leaf, and updates the sums above.

Where a new cut meets an old one: the pattern looks at two characters behind a pre-token at most (a run of white space
leaves its last one to the next word), so pre-tokens that end two characters before the edit cannot see it, and from a
common cut at or behind the edit's end both texts read on alike. How far a pattern looks ahead is given with it.

Trees can be kept: `token_trees` writes a corpus's leaves as a table, `apply_edits` turns that table into the one after
an edit of some documents. It reads and encodes only the leaves that the edit touches and one behind them, twice as many where
the new cuts haven't met the old ones by then; all other leaves pass by unread. `tree_sums` has the sums of all nodes.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chainloom.llm.common import settle, small_batches, text_of

#: Pre-tokens in a leaf of a new tree.
LEAF = 64
CACHED_PIECES = 500_000
#: Characters behind a pre-token that decide where it ends.
AHEAD = 2
#: Cuts of the byte-level vocabularies (a fixed value of theirs).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class PieceCounter:
    """Tokens of a pre-token, remembered."""

    def __init__(self, ranks_path: str, pattern: str = PATTERN, ahead: int = AHEAD):
        import base64

        import regex
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.cut = regex.compile(pattern)
        self.ahead = ahead
        self.known: dict[str, int] = {}

    def counts(self, pieces: list[str]) -> list[int]:
        known = self.known
        new = set(pieces).difference(known)
        if new:
            if len(known) + len(new) > CACHED_PIECES:
                known.clear()
                new = set(pieces)
            encode = self.encoding.encode_ordinary
            for p in new:
                known[p] = len(encode(p))
        return list(map(known.__getitem__, pieces))


def piece_counter(ranks_path: str, pattern: str, ahead: int) -> PieceCounter:
    """The counter of this worker process, with the pre-tokens that its earlier tasks have met."""
    held = sys.modules.setdefault("chainloom_worker", types.ModuleType("chainloom_worker")).__dict__
    key = f"pieces {ranks_path} {ahead} {pattern}"
    if key not in held:
        held[key] = PieceCounter(ranks_path, pattern, ahead)
    return held[key]


class TokenTree:
    """A document's text with its token count, kept up to date under edits."""

    def __init__(self, text: str, counter: PieceCounter, kept: tuple[list[int], list[int]] | None = None):
        self.text, self.counter, self.encoded, self.met = text, counter, 0, 0
        if kept is None:
            pieces = counter.cut.findall(text)
            kept = list(map(len, pieces)), counter.counts(pieces)
        self._build(*kept)

    def _build(self, lengths: list[int], tokens: list[int]) -> None:
        starts = range(0, max(1, len(lengths)), LEAF)
        self.lengths = [lengths[i : i + LEAF] for i in starts]
        self.tokens = [tokens[i : i + LEAF] for i in starts]
        self.width = 1 << (len(self.lengths) - 1).bit_length()
        self.chars, self.sums = np.zeros(2 * self.width, np.int64), np.zeros(2 * self.width, np.int64)
        k = self.width + np.arange(len(self.lengths))
        self.chars[k], self.sums[k] = [sum(x) for x in self.lengths], [sum(x) for x in self.tokens]
        level = self.width
        while level > 1:
            for a in (self.chars, self.sums):
                a[level // 2 : level] = a[level : 2 * level].reshape(-1, 2).sum(axis=1)
            level //= 2

    @property
    def total(self) -> int:
        return int(self.sums[1])

    @property
    def pieces(self) -> int:
        return sum(map(len, self.lengths))

    def _leaf_at(self, place: int) -> tuple[int, int]:
        """The first leaf whose end is at or behind a character, and where the leaf begins."""
        node, begin = 1, 0
        while node < self.width:
            node *= 2
            if begin + self.chars[node] < place:
                begin += int(self.chars[node])
                node += 1
        return min(node - self.width, len(self.lengths) - 1), begin

    def _update(self, leaf: int) -> None:
        node = self.width + leaf
        self.chars[node], self.sums[node] = sum(self.lengths[leaf]), sum(self.tokens[leaf])
        while node > 1:
            node //= 2
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace the characters from ``start`` to ``end``; places outside the text are moved to its ends."""
        n = len(self.text)
        start = min(max(0, start), n)
        end = min(max(start, end), n)
        text = self.text[:start] + new + self.text[end:]
        shift = len(new) - (end - start)
        leaf, begin = self._leaf_at(start - self.counter.ahead + 1)
        # The first pre-token that could see the edit.
        k = 0
        while k < len(self.lengths[leaf]) and begin + self.lengths[leaf][k] <= start - self.counter.ahead:
            begin += self.lengths[leaf][k]
            k += 1
        last, j, old = leaf, k, begin  # old: the cut before pre-token j of leaf ``last``, in the old text
        pieces, at = [], begin
        while True:
            # Old cuts pass until one is at or behind the new one.
            while old < len(self.text) and (old < end or old + shift < at):
                while j >= len(self.lengths[last]):
                    last, j = last + 1, 0
                old += self.lengths[last][j]
                j += 1
            if old + shift == at and old >= end and at >= start + len(new):
                break
            m = self.counter.cut.match(text, at)
            if m is None:
                break
            pieces.append(m.group())
            at = m.end()
        self.met = at  # from this cut on, the new text is cut like the old one
        counts = self.counter.counts(pieces)
        self.encoded += len(pieces)
        lengths = list(map(len, pieces))
        if last == leaf:
            self.lengths[leaf][k:j] = lengths
            self.tokens[leaf][k:j] = counts
        else:
            self.lengths[leaf][k:], self.tokens[leaf][k:] = lengths, counts
            for x in range(leaf + 1, last):
                self.lengths[x], self.tokens[x] = [], []
            del self.lengths[last][:j], self.tokens[last][:j]
        self.text = text
        if len(self.lengths[leaf]) > 8 * LEAF:
            self._build([x for part in self.lengths for x in part], [x for part in self.tokens for x in part])
            return
        for x in range(leaf, last + 1):
            self._update(x)


def count_tokens(docs: DataFrame, ranks_path: str, edits: Column | None = None, id_col: str = "doc_id", text_col: str = "text", pattern: str = PATTERN, ahead: int = AHEAD) -> DataFrame:
    """One row per document: ``id_col``, n_chars, n_pretokens, n_tokens, and after the edits edited_chars,
    edited_tokens and n_reencoded, the pre-tokens encoded anew.

    ``edits`` is a column array<struct<start int, end int, text string>> of places in code points, applied in order,
    each to the text that the one before has left.

    Edge cases: a null text counts as empty and has no token; null edits are none, and null fields of an edit are 0, the
    start, and the empty text. Places outside the text move to its ends. Very long texts are read whole. Repeated rows
    and null ids give a row each, an empty table none. Other columns are not read unless ``edits`` does, so their names
    don't matter. ``pattern`` may look at most ``ahead`` characters behind a pre-token.
    """
    kind = "array<struct<start:int,end:int,text:string>>"
    column = F.lit(None).cast(kind) if edits is None else edits.cast(kind)
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"), column.alias("edits"))
    id_type = rows.schema["id"].dataType.simpleString()
    names = ["id", "n_chars", "n_pretokens", "n_tokens", "edited_chars", "edited_tokens", "n_reencoded"]

    def run(batches) -> Iterator:
        import pyarrow as pa

        counter = piece_counter(ranks_path, pattern, ahead)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = []
                for text, changes in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    tree = TokenTree(text, counter)
                    before = (len(text), tree.pieces, tree.total)
                    for c in changes or ():
                        c = c or {}
                        start = c.get("start") or 0
                        tree.edit(start, start if c.get("end") is None else c["end"], c.get("text") or "")
                    out.append((*before, len(tree.text), tree.total, tree.encoded))
                columns = [pa.array(x, pa.int64()) for x in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=names)

    schema = f"id {id_type}, " + ", ".join(f"{n} bigint" for n in names[1:])
    with small_batches(docs.sparkSession):
        return settle(rows.mapInArrow(run, schema)).withColumnRenamed("id", id_col)


LEAF_FIELDS = "leaf int, chars bigint, tokens bigint, text string, lengths array<int>, counts array<int>"


def token_trees(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", pattern: str = PATTERN, ahead: int = AHEAD) -> DataFrame:
    """The leaves of all documents' trees, to be kept: (``id_col``, leaf, chars, tokens, text, lengths, counts), the text of
    a leaf and the length and tokens of each of its pre-tokens. A document is known by its id, which must be unique.

    Edge cases: a null or empty text is one empty leaf. Very long texts are many leaves. Null ids are one document's at
    most. An empty table gives no rows. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, {LEAF_FIELDS}"

    def run(batches) -> Iterator:
        import pyarrow as pa

        counter = piece_counter(ranks_path, pattern, ahead)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                own, out = [], []
                for row, text in enumerate(part.column(1).to_pylist()):
                    made = leaves_of(TokenTree(text, counter))
                    own += [row] * len(made)
                    out += made
                yield leaf_batch(part.column(0).take(pa.array(own, pa.int64())), out)

    with small_batches(docs.sparkSession):
        return settle(rows.mapInArrow(run, schema)).withColumnRenamed("id", id_col)


def leaves_of(tree: TokenTree) -> list[tuple]:
    """(leaf, chars, tokens, text, lengths, counts) of a tree's leaves."""
    out, at = [], 0
    for k, (lengths, counts) in enumerate(zip(tree.lengths, tree.tokens, strict=True)):
        n = sum(lengths)
        out.append((k, n, sum(counts), tree.text[at : at + n], lengths, counts))
        at += n
    return out


def leaf_batch(ids, rows: list[tuple], more: dict | None = None):
    import pyarrow as pa

    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()))
    columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
    return pa.RecordBatch.from_arrays([ids, *columns, *(more or {}).values()], names=["id", "leaf", "chars", "tokens", "text", "lengths", "counts", *(more or {})])


def tree_sums(leaves: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(``id_col``, level, node, chars, tokens): the sums of every node above the leaves, up to the root. Node n of a level
    covers the leaves whose number begins with n, so that an edit changes one node of each level for a leaf."""
    height = leaves.groupBy(F.col(id_col).alias("of")).agg(F.max("leaf").alias("most"))
    levels = F.length(F.conv(F.col("most").cast("string"), 10, 2))
    rows = leaves.join(height, F.col(id_col).eqNullSafe(F.col("of"))).select(id_col, "leaf", "chars", "tokens", F.explode(F.sequence(F.lit(1), F.greatest(levels, F.lit(1)))).alias("level"))
    node = F.expr("shiftright(leaf, level)")
    return rows.groupBy(id_col, "level", node.alias("node")).agg(F.sum("chars").alias("chars"), F.sum("tokens").alias("tokens"))


def apply_edits(
    leaves: DataFrame, edits: DataFrame, ranks_path: str, id_col: str = "doc_id", pattern: str = PATTERN, ahead: int = AHEAD, margin: int = 1
) -> tuple[DataFrame, DataFrame]:
    """The leaves after ``edits`` (``id_col``, start, end, text), and (``id_col``, leaves_read, n_reencoded) of the documents
    they change. A document has one edit a call; later ones go into later calls.

    The new pre-tokens go into the first leaf that the edit touches; others that it swallows are left empty, so numbers
    of leaves stay. Edge cases: edits of documents that aren't there, or with a null id, change nothing; null starts are
    0, null ends the start, null texts empty; places outside the text move to its ends; no edits give the same leaves.
    """
    kind = leaves.schema[id_col].dataType.simpleString()
    own = edits.select(
        F.col(id_col).alias("of"), F.coalesce(F.col("start").cast("long"), F.lit(0)).alias("start"),
        F.coalesce(F.col("end").cast("long"), F.col("start").cast("long"), F.lit(0)).alias("end"), F.coalesce(F.col("text"), F.lit("")).alias("new"),
    ).filter("of IS NOT NULL")
    own = settle(own)
    twice = own.groupBy("of").count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"document {twice[0][0]} has several edits in one call")
    # Where leaves begin: only numbers of the edited documents' leaves are ordered here.
    by = W.partitionBy("id").orderBy("leaf")
    narrow = leaves.select(F.col(id_col).alias("id"), "leaf", "chars").join(own.select("of"), F.col("id") == F.col("of"), "left_semi")
    begins = narrow.select("id", "leaf", "chars", (F.sum("chars").over(by) - F.col("chars")).alias("begin"), F.sum("chars").over(W.partitionBy("id")).alias("all"))
    placed = begins.join(own.drop("new"), F.col("id") == F.col("of")).select(
        "id", "leaf", "chars", "begin", "all",
        F.greatest(F.lit(0), F.least("start", "all")).alias("lo"), F.least(F.col("all"), F.greatest("end", F.greatest(F.lit(0), F.least("start", "all")))).alias("hi"),
    )
    placed = settle(placed)
    done = None
    wanted = placed
    while True:
        touched = (F.col("begin") + F.col("chars") >= F.col("lo") - ahead) & (F.col("begin") <= F.col("hi"))
        span = wanted.groupBy("id").agg(F.min(F.when(touched, F.col("leaf"))).alias("first"), (F.max(F.when(touched, F.col("leaf"))) + margin).alias("last"), F.max("leaf").alias("most")).withColumnRenamed("id", "sid")
        near = wanted.join(span, F.col("id") == F.col("sid")).filter("leaf BETWEEN first AND last").select(F.col("id").alias("nid"), F.col("leaf").alias("nleaf"), "begin", (F.col("last") >= F.col("most")).alias("ends"))
        read = leaves.withColumnRenamed("text", "held").join(near, (F.col(id_col) == F.col("nid")) & (F.col("leaf") == F.col("nleaf")))
        read = read.join(own, F.col("nid") == F.col("of"))
        rows = read.groupBy(F.col("nid").alias("id"), "start", "end", "new", "ends").agg(F.sort_array(F.collect_list(F.struct("leaf", "begin", F.col("held").alias("text"), "lengths", "counts"))).alias("leaves"))

        def run(batches) -> Iterator:
            import pyarrow as pa

            counter = piece_counter(ranks_path, pattern, ahead)
            for batch in batches:
                own_row, out, reads, coded, whole = [], [], [], [], []
                for row, r in enumerate(batch.to_pylist()):
                    held = r["leaves"]
                    begin = held[0]["begin"]
                    text = "".join(x["text"] for x in held)
                    tree = TokenTree(text, counter, ([n for x in held for n in x["lengths"]], [n for x in held for n in x["counts"]]))
                    start = min(max(0, r["start"] - begin), len(text))
                    tree.edit(start, min(max(start, r["end"] - begin), len(text)), r["new"])
                    met = r["ends"] or tree.met <= len(tree.text) - ahead
                    lengths, counts = [n for x in tree.lengths for n in x], [n for x in tree.tokens for n in x]
                    made = [(held[0]["leaf"], sum(lengths), sum(counts), tree.text, lengths, counts)] + [(x["leaf"], 0, 0, "", [], []) for x in held[1:]]
                    own_row += [row] * len(made)
                    out += made
                    reads += [len(held)] * len(made)
                    coded += [tree.encoded] * len(made)
                    whole += [met] * len(made)
                more = {"leaves_read": pa.array(reads, pa.int64()), "n_reencoded": pa.array(coded, pa.int64()), "met": pa.array(whole, pa.bool_())}
                yield leaf_batch(batch.column(0).take(pa.array(own_row, pa.int64())), out, more)

        with small_batches(leaves.sparkSession):
            now = settle(rows.mapInArrow(run, f"id {kind}, {LEAF_FIELDS}, leaves_read bigint, n_reencoded bigint, met boolean"))
        done = now.filter("met") if done is None else done.unionByName(now.filter("met"))
        open_ = now.filter("NOT met").select(F.col("id").alias("oid")).distinct()
        if open_.isEmpty():
            break
        wanted, margin = settle(wanted.join(open_, F.col("id") == F.col("oid"), "left_semi")), 2 * margin
    changed = done.select(F.col("id").alias("cid"), F.col("leaf").alias("cleaf"))
    kept = leaves.join(changed, (F.col(id_col) == F.col("cid")) & (F.col("leaf") == F.col("cleaf")), "left_anti")
    new = done.select(F.col("id").alias(id_col), *leaves.columns[1:])
    return settle(kept.unionByName(new)), done.groupBy(F.col("id").alias(id_col)).agg(F.max("leaves_read").alias("leaves_read"), F.max("n_reencoded").alias("n_reencoded"))


def sample_edits(text_col: str = "text") -> Column:
    """Three edits of a text by rule, from right to left so that places are those of the text itself: a deletion at
    three quarters, an insertion at a half, a replacement at a quarter."""
    text = text_of(text_col)
    n = F.length(text)
    part = lambda q: F.floor(n * q / 4).cast("int")
    one = lambda start, end, new: F.struct(start.alias("start"), end.cast("int").alias("end"), new.alias("text"))
    return F.array(
        one(part(3), part(3) + 30, F.lit("")),
        one(part(2), part(2), F.left(text, F.lit(20))),
        one(part(1), part(1) + 10, F.concat(F.lit(" edited "), F.left(text, F.lit(5)))),
    )
