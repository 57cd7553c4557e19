"""Cross-tokenizer alignment by segments (operator 12).

A byte-level tokenizer (A) encodes a space and the text, a sentence-piece tokenizer (B) the text,
before which it puts a space itself.  Where tokens of both end at one byte, the text is cut into
groups; the last tokens of a group are linked.

Texts are cut into segments before runs of white space, where neither vocabulary has an entry
that could reach across: no entry holds a character other than white space and the run's first
one behind it (``cuttable`` looks at all entries).  Byte pairs merge into entries only, and
tokenizer A's own splitting never joins such characters, so that segments are encoded as they
would be in their text.  They are as few as a language's words, so each is encoded and aligned
once in the corpus:

1. each task reads its texts in blocks of some ``BLOCK`` bytes, numbers a block's segments, and
   writes the texts as runs of these numbers, and the block's dictionary with counts;
2. the dictionaries' different segments are encoded and aligned, and their links counted, as
   often as the segments stand in the corpus, less those in texts that have no tokens;
3. alignments and what their links count for go back to the dictionaries, and with them each
   block composes its documents.

So a row for a segment is shuffled once for each block, not for each word, texts are only as
numbers, and a segment that stands everywhere is no larger than another.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.llm.textkit import KEPT, Scratch, bounded, cut, ids_and_text, only, release, tidy

#: Bytes of the texts of a block; a longer text is a block of its own.
BLOCK = 32 << 20
#: Parts of the blocks that are composed one after another, so that disk holds the alignments of one at a time.
SLICES = 3
#: White space before which a cut may be, if the vocabularies allow it.
BLANKS = " \n\t\r"
#: Rows of segments that are encoded at a time.
BATCH = 4096


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _byte_of() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves,
    the others for the characters from 256 on, in order."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}


class Tokenizers:
    """Both tokenizers of a worker, and the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        byte_of = _byte_of()
        self.bytes_a = {i: bytes(byte_of[c] for c in entry) for entry, i in json.load(open(path_a, encoding="utf-8"))["model"]["vocab"].items()}
        model = sentencepiece_model_pb2.ModelProto()
        with open(path_b, "rb") as f:
            model.ParseFromString(f.read())
        kind = sentencepiece_model_pb2.ModelProto.SentencePiece
        self.bytes_b = [
            bytes([int(p.piece[3:5], 16)]) if p.type == kind.BYTE else p.piece.replace("▁", " ").encode() if p.type in (kind.NORMAL, kind.USER_DEFINED) else b"" for p in model.pieces
        ]
        self.entries = [b.decode("utf-8", "replace") for b in self.bytes_a.values()] + [b.decode("utf-8", "replace") for b in self.bytes_b]
        # a segment brings its own blank, or none
        model.normalizer_spec.add_dummy_prefix = False
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.identity = model.normalizer_spec.name == "identity" and not model.normalizer_spec.remove_extra_whitespaces

    def cuttable(self) -> str:
        """The white space before which no entry of either vocabulary can reach from other characters.

        A normalizer that changes texts could do so across a cut: then there is none.
        """
        if not self.identity:
            return ""
        return "".join(w for w in BLANKS if not any(re.search(rf"\S{re.escape(w)}", e) for e in self.entries))

    def aligned(self, segments: list[str]) -> list[tuple[int, int, bytes, list[tuple[int, int]]] | None]:
        """(tokens of A, of B, groups as text, links) of each segment; None where the tokens' bytes are not its own."""
        some_a = [e.ids for e in self.a.encode_batch(segments, add_special_tokens=False)]
        some_b = self.b.encode(segments, num_threads=1)
        return [self._groups(s.encode(), a, b) for s, a, b in zip(segments, some_a, some_b, strict=True)]

    def _groups(self, text: bytes, ids_a: list[int], ids_b: list[int]):
        parts_a, parts_b = [self.bytes_a.get(i, b"") for i in ids_a], [self.bytes_b[i] for i in ids_b]
        if b"".join(parts_a) != text or b"".join(parts_b) != text or b"" in parts_a or b"" in parts_b:
            return None
        groups, links, j, end_a, end_b = [], [], 0, 0, 0
        from_a = from_b = 0
        for i, part in enumerate(parts_a):
            end_a += len(part)
            while end_b < end_a:
                end_b += len(parts_b[j])
                j += 1
            if end_a == end_b:
                groups.append(f"{','.join(map(str, ids_a[from_a : i + 1]))}|{','.join(map(str, ids_b[from_b:j]))}")
                links.append((ids_a[i], ids_b[j - 1]))
                from_a, from_b = i + 1, j
        return len(ids_a), len(ids_b), ";".join(groups).encode(), links


def _tokenizers(paths: tuple[str, str]) -> Tokenizers:
    only("alignment")
    kept = KEPT.setdefault("alignment", {})
    if paths not in kept:
        kept.clear()
        kept[paths] = Tokenizers(*paths)
    return kept[paths]


def _segments(cuts: str) -> re.Pattern:
    """Segments that make up a text: white space, then what is none, and white space before which is no cut."""
    if not cuts:
        return re.compile(r"(?s).+")
    return re.compile(rf"\s*(?:\S+|[^\S{re.escape(cuts)}]\s*)+|\s+")


_CODED = pa.schema([("block", pa.int64()), ("local", pa.int32()), ("segment", pa.string()), ("times", pa.int64()), ("row", pa.int32()), ("doc_id", pa.int64()), ("codes", pa.binary())])


def _packed(codes: np.ndarray) -> bytes:
    """A run of numbers, after their count; as long as a text."""
    return len(codes).to_bytes(8, "little") + pa.compress(codes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:8], "little")
    return np.frombuffer(pa.decompress(packed[8:], 4 * n, codec="zstd"), np.int32)


def _code(batches: Iterator[pa.RecordBatch], cuts: str) -> Iterator[pa.RecordBatch]:
    """Blocks: their dictionary (local, segment, times), then their documents as runs of local numbers (row, doc_id, codes)."""
    from pyspark import TaskContext

    find, at = _segments(cuts).findall, TaskContext.get().partitionId() << 32
    known: dict[str, int] = {}
    docs: list[tuple[int | None, bytes]] = []
    times, size = np.zeros(1 << 16, np.int64), 0

    def out() -> Iterator[pa.RecordBatch]:
        # the dictionary is written first, in parts, as a text may be a segment
        words, part, a = list(known), 0, 0
        for k, w in enumerate(words):
            part += len(w)
            if part > 1 << 20 or k - a >= 1 << 16 or k + 1 == len(words):
                n = k + 1 - a
                yield pa.RecordBatch.from_arrays([pa.array([at] * n, pa.int64()), pa.array(range(a, k + 1), pa.int32()), pa.array(words[a : k + 1], pa.string()), pa.array(times[a : k + 1].copy()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], schema=_CODED)
                part, a = 0, k + 1
        part, a = 0, 0
        for k, (_, codes) in enumerate(docs):
            part += len(codes)
            if part > 1 << 20 or k + 1 == len(docs):
                own, n = docs[a : k + 1], k + 1 - a
                yield pa.RecordBatch.from_arrays([pa.array([at] * n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), pa.array(range(a, k + 1), pa.int32()), pa.array([d for d, _ in own], pa.int64()), pa.array([c for _, c in own], pa.binary())], schema=_CODED)
                part, a = 0, k + 1
        known.clear()
        docs.clear()
        times[:] = 0

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            own = text.as_py() or ""
            if docs and size + len(own) > BLOCK:
                yield from out()
                size, at = 0, at + 1
            number = known.setdefault
            codes = np.array([number(s, len(known)) for s in find(" " + own)] if own else [], np.int32)
            if len(known) > len(times):
                times = np.concatenate([times, np.zeros(len(known), np.int64)])
            np.add.at(times, codes, 1)
            docs.append((doc_id, _packed(codes)))
            size += len(own) + 16
    if docs:
        yield from out()
    tidy()


_ALIGNED = pa.schema([("segment", pa.string()), ("times", pa.int64()), ("n_a", pa.int32()), ("groups", pa.binary()), ("links", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))])


def _align(batches: Iterator[pa.RecordBatch], paths: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    """n_a, groups and links of each segment; groups is null where the tokens' bytes are not the segment's."""
    both = _tokenizers(paths)
    for batch in batches:
        column = batch.column("segment")
        a = 0
        while a < len(column):
            b, size = a, 0
            while b < len(column) and b - a < BATCH and size < 1 << 20:
                size += len(column[b].as_py())
                b += 1
            found = both.aligned(column.slice(a, b - a).to_pylist())
            pairs = np.array([x for f in found if f for link in f[3] for x in link], np.int32).reshape(-1, 2)
            ends = np.concatenate([[0], np.cumsum([len(f[3]) if f else 0 for f in found])]).astype(np.int32)
            links = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"]))
            yield pa.RecordBatch.from_arrays([column.slice(a, b - a).cast(pa.string()), batch.column("times").slice(a, b - a), pa.array([f[0] if f else 0 for f in found], pa.int32()), pa.array([f[2] if f else None for f in found], pa.binary()), links], schema=_ALIGNED)
            a = b


_TAKEN = pa.schema([("block", pa.int64()), ("local", pa.int32()), ("times", pa.int64())])


def _without_tokens(key, bad: pa.Table, docs: pa.Table) -> pa.Table:
    """How often each segment of a block stands in documents that have one of the bad segments."""
    bad_ones, times = bad.column("local").to_numpy(), np.zeros(0, np.int64)
    for codes in docs.column("codes"):
        own = _unpacked(codes.as_py())
        if np.isin(own, bad_ones).any():
            count = np.bincount(own, minlength=len(times))
            count[: len(times)] += times
            times = count
    held = np.flatnonzero(times)
    return pa.Table.from_arrays([pa.array([key[0].as_py()] * len(held), pa.int64()), pa.array(held, pa.int32()), pa.array(times[held], pa.int64())], schema=_TAKEN)


_COMPOSED = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_best", "count_sum")), ("groups_sha256", pa.string())])


def _compose(key, dictionary: pa.Table, docs: pa.Table) -> pa.Table:
    """A block's documents from the alignments of its segments."""
    n = dictionary.num_rows
    text = dictionary.column("groups").combine_chunks() if n else pa.array([], pa.binary())
    count = lambda c: pc.count_substring(text, c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    place = dictionary.column("local").to_numpy()
    at = np.zeros(n, np.int64)
    at[place] = np.arange(n)
    there = text.is_valid().to_numpy(zero_copy_only=False)
    n_groups = np.where(there, count(";") + 1, 0)
    n_a = dictionary.column("n_a").to_numpy().astype(np.int64)
    # in a group the tokens of a tokenizer are one more than its commas
    n_b = count(",") + 2 * n_groups - n_a
    best, total = dictionary.column("best").to_numpy(), dictionary.column("total").to_numpy()
    groups = text.to_pylist()
    out = [[] for _ in _COMPOSED]
    for doc_id, codes in zip(docs.column("doc_id").to_pylist(), docs.column("codes"), strict=True):
        own = at[_unpacked(codes.as_py())]
        if not len(own) or not there[own].all():
            row = (doc_id, 0, 0, 0, 0, 0, "")
        else:
            digest = hashlib.sha256()
            for a in range(0, len(own), 1 << 16):  # a part at a time
                digest.update(b";" * bool(a) + b";".join([groups[c] for c in own[a : a + (1 << 16)].tolist()]))
            row = (doc_id, *(int(x[own].sum()) for x in (n_a, n_b, n_groups, best, total)), digest.hexdigest())
        for column, x in zip(out, row, strict=True):
            column.append(x)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(out, _COMPOSED, strict=True)], schema=_COMPOSED)


def _ddl(schema: pa.Schema) -> str:
    from pyspark.sql.pandas.types import from_arrow_schema

    return from_arrow_schema(schema)


def segments_of(docs: DataFrame, keep: Scratch, paths: tuple[str, str]) -> DataFrame:
    """Coded documents and dictionaries of all blocks, written once: a block's number is of this writing."""
    cuts = Tokenizers(*paths).cuttable()
    return keep.put(docs.mapInArrow(functools.partial(_code, cuts=cuts), _ddl(_CODED)), "zstd")


def _taken(entries: DataFrame, texts: DataFrame, aligned: DataFrame, keep: Scratch) -> DataFrame | None:
    """segment and taken: how often it stands in texts without tokens; None if there is no such text."""
    unsound = keep.put(aligned.where("groups is null").select("segment"))
    if unsound.isEmpty():
        return None
    bad = keep.put(entries.join(bounded(unsound, 32), "segment", "left_semi").select("block", "local"))
    theirs = texts.join(bounded(bad.select(F.col("block").alias("of")).distinct(), 16), "of", "left_semi")
    taken = bad.groupBy("block").cogroup(theirs.groupBy("of")).applyInArrow(_without_tokens, _ddl(_TAKEN))
    return keep.put(entries.select("block", "local", "segment").join(taken, ["block", "local"]).groupBy("segment").agg(F.sum(taken["times"]).alias("taken")))


def pair_counts(links: DataFrame) -> DataFrame:
    """a, b, n and best from rows a, b and times: how many links hold a pair linked, and whether that is b's most."""
    counted = links.groupBy("a", "b").agg(F.sum("times").alias("n")).where("n > 0")
    most = counted.groupBy(F.col("b").alias("b_")).agg(F.max("n").alias("most"))
    return counted.join(bounded(most, 16), F.col("b") == F.col("b_")).select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs): a row for every row of ``docs`` with doc_id, n_a, n_b, n_groups, n_links, n_best,
    count_sum and groups_sha256; and a, b, n, best for every pair of token ids that is linked.

    n_a and n_b count tokens, n_groups the runs of tokens between bytes where both have an end, n_links the
    linked tokens, n_best those whose pair is the most frequent of its B id in the corpus (ties
    included), count_sum adds the pairs' counts.  groups_sha256 is of the ids, groups parted by
    semicolons.

    Null and empty texts have no tokens, nor has a text that the tokens do not give back (one
    with the character U+2581, say): zeros, and an empty groups_sha256.  Such texts count for no
    pair.  Repeated rows each have a row and count; a null id is kept; an empty table gives
    empty ones.  Columns other than the two named are not read.  A text may be of any length, also one segment.
    """
    paths = tuple(paths or default_paths())
    spark = docs.sparkSession
    with Scratch(spark) as keep:
        coded = segments_of(ids_and_text(docs, id_col, text_col), keep, paths)
        entries, texts = coded.where("local is not null").select("block", "local", "segment", "times"), coded.where("row is not null").select(F.col("block").alias("of"), "doc_id", "codes")
        distinct = entries.groupBy("segment").agg(F.sum("times").alias("times"))
        aligned = keep.put(distinct.mapInArrow(functools.partial(_align, paths=paths), _ddl(_ALIGNED)).withColumn("gid", F.monotonically_increasing_id()), "zstd")
        release(spark)
        taken = _taken(entries, texts, aligned, keep)
        counted = aligned if taken is None else aligned.join(bounded(taken, 48), "segment", "left").withColumn("times", F.col("times") - F.coalesce("taken", F.lit(0)))
        pairs = keep.put(pair_counts(counted.select("times", F.explode("links").alias("x")).select("x.a", "x.b", "times")))
        release(spark)
        links = aligned.select("gid", F.explode("links").alias("x")).select("gid", "x.a", "x.b")
        sums = keep.put(links.join(bounded(pairs, 24), ["a", "b"]).groupBy("gid").agg(F.sum(F.col("best").cast("long")).alias("best"), F.sum("n").alias("total")))
        release(spark)
        # segments that only texts without tokens have are in no pair
        of = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
        worth = keep.put(aligned.select("segment", "gid", "n_a", "groups").join(sums, "gid", "left").select("segment", "n_a", "groups", of("best"), of("total")), "zstd")
        keep.drop(aligned, sums)
        release(spark)
        parts = []
        for k in range(SLICES):
            of_slice = lambda c, k=k: F.pmod(F.xxhash64(c), F.lit(SLICES)) == k
            placed = entries.where(of_slice("block")).select("block", "local", "segment").join(worth, "segment").select("block", "local", "n_a", "groups", "best", "total")
            parts.append(keep.put(placed.groupBy("block").cogroup(texts.where(of_slice("of")).groupBy("of")).applyInArrow(_compose, _ddl(_COMPOSED))))
            release(spark)
        composed = keep.both(parts)
        out = composed.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")
        return cut(out), cut(pairs)
