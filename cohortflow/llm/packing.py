"""Operator 10, packing: first-fit decreasing with a tournament tree.

Documents are tokenised once; each is cut into full sequences and one rest.
Rests are packed by first-fit decreasing, independently in randomised groups
of pieces: a tournament tree over the free room of a group's bins finds the
first bin that holds a piece.  Pieces are written once with their ids; only
lengths and checksums are shuffled for the packing, and the ids are joined to
their places by the number of the piece.  A group holds about ``GROUP`` pieces
whatever the size of the corpus or of a document, since pieces are dealt by a
hash of their own.  ``sequences`` gives the ids of each filled sequence.

Nulls and edge cases: a null text counts as empty and has the end id alone.
Rows that repeat a doc_id are packed each for itself; a null doc_id is packed
like any other.  An empty table gives an empty result.  Columns other than
doc_id and text are not read.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow.llm.common import id_in, id_out, lean, query, release, settings, single_thread, staged, table, tokenizer_path

LENGTH = 2048
END_ID = 1
GROUP = 8192
#: Bytes of text that a task encodes at a time (a longer text goes by itself).
SLICE = 1 << 22
#: ids that a task hands on at a time (those of a longer text go together).
BATCH_IDS = 1 << 20
#: Longest part between blanks, in bytes, that is taken apart by WORD_IN_MARKS.
PART_BYTES = 96
#: Most mark sequences whose ids a worker remembers.
MARKS = 10_000
#: Latin letters (without U+0130, whose lower case is two characters) between
#: ASCII marks; an apostrophe before letters may belong to them.
WORD_IN_MARKS = r"^(?P<before>[!-&(-/:-@\[-`{-~]*)(?P<word>[A-Za-zÀ-ÖØ-öø-įı-ſ]+)(?P<after>[!-/:-@\[-`{-~]*)$"
#: Stands for the end of a word; no Latin word holds it.
STOP = b"\x01"


def word_ranks(model: dict) -> tuple[dict[bytes, int], np.ndarray]:
    """Byte ranks that merge as the vocabulary does, and the id of each rank.

    The vocabulary writes bytes as printable characters and the end of a word
    as a suffix of its last byte.  Here the end is a byte of its own that joins
    the byte before it first of all; then come the merges in their order, which
    is that of the ids.  Joining whatever two neighbours spell a token equals
    joining by the merge list as long as each token, encoded by itself, gives
    itself: neighbours x and y that stand when all merges before that of the
    token xy are done are what those merges make of xy, hence its own pair.
    """
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    byte_of = {chr(b): b for b in printable}
    byte_of |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(printable))}
    special = {"<|startoftext|>", "<|endoftext|>"}
    spelt = {}
    for token, i in model["vocab"].items():
        if token not in special:
            ended = token.endswith("</w>") and len(token) > 4
            spelt[bytes(byte_of[c] for c in (token[:-4] if ended else token)) + (STOP if ended else b"")] = i
    order = sorted(spelt, key=lambda t: (len(t) != 2 or t[1:] != STOP, len(t) == 1, spelt[t]))
    return {t: k for k, t in enumerate(order)}, np.array([spelt[t] for t in order], dtype="<u4")


def take_runs(values: np.ndarray, start: np.ndarray, length: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs ``which`` of values, one after the other."""
    n = length[which]
    ends = np.cumsum(n)
    at = np.arange(int(ends[-1]) if len(ends) else 0)
    at += np.repeat(start[which] - (ends - n), n)
    return values[at]


def edges(length: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(length)))


class Encoder:
    """ids of whole texts, as little-endian unsigned 32-bit arrays.

    The tokenizer drops white space and never joins across it, so a text's ids
    are those of its parts between blanks.  Per slice of texts, each distinct
    part is encoded once, and the ids are gathered by arrays.  Case, and marks
    before or after letters, do not change the ids of the letters; Latin words
    are encoded by the vocabulary's ranks, all other parts by the tokenizer.
    """

    def __init__(self, path: str):
        single_thread()
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            ranks, self.id_of = word_ranks(json.load(f)["model"])
        stop = STOP.decode()
        self.words = tiktoken.Encoding("words", pat_str=f"[^{stop}]+{stop}", mergeable_ranks=ranks, special_tokens={})
        self.ends_word = np.array([t.endswith(STOP) for t in ranks], bool)
        self.marks: dict[str, np.ndarray] = {}

    def _one(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _mark(self, text: str) -> np.ndarray:
        ids = self.marks.get(text)
        if ids is None:
            ids = self._one(text)
            if len(self.marks) < MARKS:
                self.marks[text] = ids
        return ids

    def latin(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of lower-case Latin words, one after the other, and how many each has."""
        stop = STOP.decode()
        ranks = np.array(self.words.encode_ordinary(stop.join([*words, ""])), dtype=np.int64)
        return self.id_of[ranks], np.diff(np.flatnonzero(self.ends_word[ranks]), prepend=-1)

    def _parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of distinct parts, one after the other, and how many each has."""
        short = pc.and_(pc.less_equal(pc.binary_length(parts), PART_BYTES), pc.invert(pc.match_substring(parts, "<|")))
        split = pc.extract_regex(pc.if_else(short, parts, ""), WORD_IN_MARKS)
        plain = split.is_valid().to_numpy(zero_copy_only=False)
        split = split.drop_null()
        pool, at = [], 0
        runs = np.zeros((len(parts), 3), dtype=np.int64)  # before, word, after
        for k, field in enumerate(("before", "word", "after")):
            column = pc.struct_field(split, field)
            coded = (pc.utf8_lower(column) if field == "word" else column).dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            if field == "word":
                ids, n = self.latin(distinct) if distinct else (np.empty(0, "<u4"), np.empty(0, np.int64))
                pool.append(ids)
            else:
                some = [self._mark(x) for x in distinct]
                pool += some
                n = np.array([len(x) for x in some], dtype=np.int64)
            runs[plain, k] = at + coded.indices.to_numpy()
            at += len(n)
            runs_n = n if k == 0 else np.concatenate((runs_n, n))
        rest = [self._one(x) for x in parts.filter(pa.array(~plain)).to_pylist()]
        nothing = at + len(rest)
        runs[~plain, 0] = at + np.arange(len(rest))
        runs[~plain, 1:] = nothing
        length = np.concatenate((runs_n, [len(x) for x in rest], [0])).astype(np.int64)
        values = np.concatenate([*pool, *rest, np.empty(0, "<u4")])
        return take_runs(values, edges(length)[:-1], length, runs.ravel()), length[runs].sum(axis=1)

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """ids of each text; null is empty."""
        texts = pc.fill_null(pc.cast(texts, pa.large_string()), "")
        size = edges(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(size, size[at] + SLICE, side="right")) - 1)
            split = pc.split_pattern(pc.replace_substring(texts.slice(at, to - at), "\n", " "), " ")
            coded = split.flatten().dictionary_encode()
            ids, length = self._parts(coded.dictionary)
            which = coded.indices.to_numpy()
            flat = take_runs(ids, edges(length)[:-1], length, which)
            cuts = edges(length[which])[split.offsets.to_numpy() - split.offsets[0].as_py()]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                yield flat[a:b]
            at = to


_encoders: dict[str, Encoder] = {}


def piece_rows(path: str, length: int, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    end = np.array([end_id], dtype="<u4")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        *columns, ids = zip(*rows)
        flat = pa.array(np.concatenate(ids).astype(np.int32))
        lists = pa.ListArray.from_arrays(pa.array(edges(np.array(columns[2])), type=pa.int32()), flat)
        return pa.RecordBatch.from_arrays([*(pa.array(c, type=pa.int64()) for c in columns), lists], names=names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = Encoder(path)
            release()
        enc = _encoders[path]
        for b in batches:
            rows, held = [], 0
            for doc, ids in zip(b.column("doc_id").to_pylist(), enc.encode(b.column("text"))):
                ids = np.append(ids, end)
                n = len(ids)
                for s in range(0, n, length):
                    part = ids[s : s + length]
                    rows.append((doc, s, len(part), zlib.crc32(part.tobytes()), n, part))
                held += n
                if held >= BATCH_IDS:
                    yield batch(rows)
                    rows, held = [], 0
            if rows:
                yield batch(rows)

    return lean(cut)


def first_fit_decreasing(sizes: list[int], room: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each piece; ``sizes`` descend.  ``tree`` is a
    tournament of the bins' free room: a node holds the larger of its two."""
    leaves = 1
    while leaves < max(1, len(sizes)):
        leaves *= 2
    tree = [room] * (2 * leaves)
    bins, offsets = [], []
    for size in sizes:
        node = 1
        while node < leaves:  # the winner's side, the left one first
            node *= 2
            if tree[node] < size:
                node += 1
        bins.append(node - leaves)
        offsets.append(room - tree[node])
        tree[node] -= size
        while node > 1:
            node //= 2
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
    return bins, offsets


COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces_of(docs: DataFrame, path: str | None = None, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row per piece, with its ids and a number of its own; staged."""
    path = path or tokenizer_path("word_bpe_49k.json")
    pieces = docs.select(id_in(), "text").mapInArrow(piece_rows(path, length, end_id), COLUMNS + ", ids array<int>")
    with settings(docs.sparkSession, {"spark.sql.parquet.compression.codec": "zstd"}):
        return staged(pieces.withColumn("piece", F.monotonically_increasing_id()), "pieces")


def places(pieces: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """The staged pieces without their ids, with sequence_id and offset."""
    pieces = pieces.drop("ids")
    groups = max(1, -(-pieces.count() // group))

    def fill(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["length", "doc_id", "start", "ids_crc32", "piece"], ascending=[False, True, True, True, True])
        bins, offsets = first_fit_decreasing(g["length"].tolist(), length)
        out = g.drop(columns="piece_group")
        out["sequence_id"] = np.array(bins, dtype=np.int64) + (int(key[0]) << 32)
        out["offset"] = np.array(offsets, dtype=np.int64)
        return out

    dealt = pieces.withColumn("piece_group", F.pmod(F.xxhash64("piece"), F.lit(groups)))
    placed = dealt.groupBy("piece_group").applyInPandas(fill, COLUMNS + ", piece long, sequence_id long, offset long")
    return placed.withColumn("doc_id", id_out())


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, end_id: int = END_ID, group: int = GROUP) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids."""
    pieces = pieces_of(docs, path, length, end_id)
    return places(pieces, length, group).join(pieces.select("piece", "ids"), "piece").drop("piece")


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence of ``pack``: sequence_id and the ids of its pieces in order."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))


@query()
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(pieces_of(table(spark, sf_dir, "documents"))).drop("piece")
