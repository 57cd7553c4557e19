"""Exact dedup by recipes of content-defined chunks (operator 11), in DataFrame functions only.

A text, its white space made single spaces, is cut into chunks where its content says so: after
a blank behind one of ``ENDS``, ``LEAST`` characters on at least, and after ``MOST`` in any case.
So equal texts have equal chunks, and a text's recipe is the list of its chunks' identifiers.

One pass over the texts makes recipes of chunk hashes; from there on only recipes move, of some
eight bytes for a thousand characters, until it is known which recipes more than one row has.
Then the chunks of these, and of no others, are read again and merged by their whole content, a
task's copies before they are shuffled.  A hash that has one content is a verified identifier;
where one has more, they are numbered, and the recipes that have it get the numbers as well.
Rows are equal if their lists of verified identifiers are.

Which texts have a chunk to verify is told by a bitmap of fixed size over the recipes that
repeat.  A false hit there costs the shuffle of some chunks and changes nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moraine.llm.textkit import Scratch, bounded, cut

#: Characters of a chunk, the least and the most.
LEAST, MOST = 512, 4096
#: A chunk ends with one of these and a blank.
ENDS = "dgkmoz.!?"
#: Bits of the bitmap of repeated recipes (2 MB).
BITS = 1 << 24


def normalised(text: Column | str) -> Column:
    """A text with one space for each run of ASCII white space; a null is empty."""
    own = F.coalesce((F.col(text) if isinstance(text, str) else text).cast("string"), F.lit(""))
    return F.regexp_replace(own, r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def chunked(text: Column | str) -> Column:
    """The chunks of a text, which make it up when put together; none of an empty text."""
    least, most = LEAST - 2, MOST - 2
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{{least},{most}}}?(?:[{ENDS}] |\z)|.{{1,{MOST}}}"), F.lit(0))


def _hash(chunk: Column, bits: int) -> Column:
    return F.xxhash64(chunk) if bits == 64 else F.shiftrightunsigned(F.xxhash64(chunk), 64 - bits)


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bits: int = 64) -> DataFrame:
    """doc_id, text_sha256 of the normalised text, its n_chars, and recipe, the hashes of its chunks in order."""
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), normalised(docs[text_col]).alias("norm"))
    return own.select(
        "doc_id", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), F.length("norm").cast("long").alias("n_chars"),
        F.transform(chunked("norm"), lambda c: _hash(c, hash_bits)).alias("recipe"),
    )


def _bit(recipe: Column | str) -> Column:
    return F.pmod(F.xxhash64(recipe), F.lit(BITS))


def _bitmap(repeated: DataFrame) -> DataFrame:
    """One row: an array of longs with a bit for each recipe; null without any."""
    at = repeated.select(_bit("recipe").alias("bit"))
    longs = at.groupBy(F.shiftright("bit", 6).cast("int").alias("place")).agg(F.expr("bit_or(shiftleft(1L, int(bit & 63)))").alias("bits"))
    every = repeated.sparkSession.range(0, BITS >> 6, 1, 8).select(F.col("id").cast("int").alias("place"))
    full = every.join(F.broadcast(longs), "place", "left").select("place", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    return full.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "bits"))), lambda x: x["bits"]).alias("bitmap"))


def _odd_chunks(docs: DataFrame, repeated: DataFrame, id_col: str, text_col: str, hash_bits: int, keep: Scratch) -> DataFrame:
    """doc_id, text_sha256 and marks: the places and numbers of chunks that share their hash with another content.

    Only for texts whose recipe is repeated; nearly always there is no such chunk.
    """
    read = docs.select(docs[id_col].cast("long").alias("doc_id"), normalised(docs[text_col]).alias("norm"))
    read = read.select("doc_id", "norm", chunked("norm").alias("chunks"))
    bit = _bit(F.transform("chunks", lambda c: _hash(c, hash_bits)))
    read = read.where(F.getbit(F.get(_bitmap(repeated).scalar(), F.shiftright(bit, 6).cast("int")), bit.bitwiseAND(63).cast("int")) == 1)
    contents = keep.put(read.select(F.explode("chunks").alias("chunk")).groupBy(_hash(F.col("chunk"), hash_bits).alias("h"), "chunk").agg(F.count("*").alias("n")).select("h", "chunk"))
    several = contents.groupBy("h").agg(F.count("*").alias("contents")).where("contents > 1").select("h")
    numbered = contents.join(bounded(several, 8), "h").withColumn("number", F.row_number().over(Window.partitionBy("h").orderBy("chunk")))
    numbered = keep.put(numbered.select("h", "chunk", "number"))
    if numbered.isEmpty():
        return read.sparkSession.createDataFrame([], "doc_id long, text_sha256 string, marks array<struct<p:int,number:int>>")
    places = read.select("doc_id", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), F.posexplode("chunks").alias("p", "chunk")).withColumn("h", _hash(F.col("chunk"), hash_bits))
    found = places.join(numbered, ["h", "chunk"]).groupBy("doc_id", "text_sha256").agg(F.sort_array(F.collect_set(F.struct("p", "number"))).alias("marks"))
    return keep.put(found)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bits: int = 64) -> DataFrame:
    """A row for every row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, n_chunks and n_chars.

    Texts are equal if they are so after each run of ASCII white space is made one space (a null
    is an empty text, and empty texts are equal).  keep_id is the least id of the equal ones and
    group_size their number; kept marks the row that stays.  Of rows that repeat the least id as
    well, one stays and the others go.  Null ids come after all others; in a group that has only
    such rows keep_id is null and one of them stays.  An empty table gives no rows; columns other
    than the two named are not read, whatever their names.

    ``hash_bits`` cuts the chunk hashes short, so that tests see different chunks of one hash.
    """
    with Scratch(docs.sparkSession) as keep:
        # written once: a row's number is of this writing
        made = keep.put(recipes(docs, id_col, text_col, hash_bits).withColumn("row", F.monotonically_increasing_id()))
        repeated = keep.put(made.groupBy("recipe").agg(F.count("*").alias("n")).where("n > 1").select("recipe"))
        odd = _odd_chunks(docs, repeated, id_col, text_col, hash_bits, keep)
        own = made
        if not odd.isEmpty():
            marks = odd.select(F.col("doc_id").alias("m_id"), F.col("text_sha256").alias("m_sha"), "marks")
            own = keep.put(made.join(bounded(marks, 48, "marks"), made["doc_id"].eqNullSafe(F.col("m_id")) & (F.col("text_sha256") == F.col("m_sha")), "left").drop("m_id", "m_sha"))
        else:
            own = made.withColumn("marks", F.lit(None).cast("array<struct<p:int,number:int>>"))
        same = own.groupBy("recipe", "marks").agg(F.count("*").alias("size"), F.min("doc_id").alias("least"), F.coalesce(F.min_by("row", "doc_id"), F.min("row")).alias("stays")).where("size > 1")
        same = keep.put(same.select(F.col("recipe").alias("r"), F.col("marks").alias("m"), "size", "least", "stays"))
        out = own.join(bounded(same, 64, "r"), (F.col("recipe") == F.col("r")) & F.col("marks").eqNullSafe(F.col("m")), "left")
        return cut(out.select(
            "doc_id", F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("keep_id"), F.coalesce("size", F.lit(1).cast("long")).alias("group_size"),
            (F.col("size").isNull() | (F.col("row") == F.col("stays"))).alias("kept"), "text_sha256", F.size("recipe").cast("long").alias("n_chunks"), "n_chars",
        ))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever these are named.

    Which stay is told by ``groups``; of rows that are equal in id and text any one stays.
    """
    names = {c: f"own_{k}" for k, c in enumerate(docs.columns)}
    told = groups(docs, id_col, text_col).groupBy(F.col("doc_id").alias("told_id"), F.col("text_sha256").alias("told_sha")).agg(F.max("kept").alias("stays"), F.count("*").alias("rows"))
    told = told.where("not stays or rows > 1")
    own = docs.select(*(docs[c].alias(n) for c, n in names.items()))
    id_, sha = F.col(names[id_col]).cast("long"), F.sha2(normalised(names[text_col]).cast("binary"), 256)
    both = own.join(bounded(told, 96), id_.eqNullSafe(F.col("told_id")) & (sha == F.col("told_sha")), "left")
    # only rows that repeat an id and a text are moved to pick one of them
    again = both.where("stays").withColumn("one", F.row_number().over(Window.partitionBy("told_id", "told_sha").orderBy(names[id_col]))).where("one = 1")
    back = [F.col(n).alias(c) for c, n in names.items()]
    return both.where("stays is null").select(*back).union(again.select(*back))
