"""Line dedup by an exact set-similarity join (operator 6), in DataFrame functions only.

A line is the set of its words.  Two lines match if the Jaccard similarity of their sets is
``threshold`` or more.  A line is removed if a line that comes earlier in the corpus, by
document and then by place, matches it.

Equal sets are merged first: the first line of a set stands for it.  The words of a set are
put in one order for the whole corpus, rare ones first.

The prefix filter is that of two words: let two sets of sizes m and n share s words, so that
u = m + n - 2 s words are in one of them only.  In the order of the shared words at most u
pairs of neighbours are parted by a word that is not shared, so of the first u + 4 shared
words three pairs of neighbours are neighbours in both sets (two, where a set of four words
matches one of five: these share no more words).  They stand among the first m - s + u + 4
words of the set of m, which is 2 (1 - threshold) m + 4 at most, whatever n is, and less the
larger n is.  So every set sends out the pairs of neighbours of its prefix, and only sets that
meet in two of them are compared.  A single rare word is shared by many lines
that have nothing else in common, and ever more as the corpus grows; two neighbours are so by
far fewer, and fewer again by lines of about one length: sets meet within a class of sizes, from
a power of two up to the next, and one that can match a set of the next class is sent there
too, with the prefix that sets of that class ask for.

Sets that meet are first verified with the set of the least id, the lead, of those that meet
in a pair of neighbours, if they meet at two.  Ids go up with the documents' ids, by ``CUTS``
of them, so that a lead stands earlier than nearly all that it leads, and what matches it is
settled.

What is not settled by that shares two pairs of neighbours in which neither set is the lead (of
three at most one has it), or is of four and five words.  So only pairs of neighbours that
three sets or more have go on, without their leads, only for sets that have two such or are
that short, and only where two of these sets are left, one of them without a match.  What falls
away takes others along, so this is done ``PRUNINGS`` times: a match has its two pairs of
neighbours with both its sets and never falls away, while chance meetings seldom hold each
other.  There sets without a match meet all others.
The length filter (sizes), the positional filter (what can follow the shared words) and a
bitmap (which words of the whole set stand at 256 places an odd number of times: two sets
differ in as many words at least as in these bits) drop what cannot match before it is
written.  Two sets that have the pair of neighbours before this one in common too have met
there.  Verification is of whole sets, read from the texts again.

Rarity comes from counts of the words of all lines of all documents in ``BUCKETS`` hash buckets: a
fixed size at any corpus, and any order gives the same matches.  Words are compared as hashes
of 64 bits; words that are one in the 31 bits of their place in the order only make sets meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moraine.llm.textkit import Scratch, bounded, cut, ids_and_text, release

THRESHOLD = 0.8
BUCKETS = 1 << 16
#: Parts of the neighbours that are shuffled one after another, so that disk holds one at a time.
SLICES = 2
#: Times that what cannot match is left out before sets that meet are paired.
PRUNINGS = 3
#: Quantiles of the documents' ids that ids of lines follow.
CUTS = 255
_BLANKS = ("\t", "\x0b", "\x0c", "\r")


def _spaced(text: Column | str) -> Column:
    """A text whose words stand between single spaces and line ends only."""
    out = F.col(text) if isinstance(text, str) else text
    for c in _BLANKS:
        out = F.replace(out, F.lit(c), F.lit(" "))
    return out


def _hashes(line: Column | str) -> Column:
    """The different words of a line as hashes."""
    return F.array_remove(F.array_distinct(F.transform(F.split(line, " "), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def _bucket(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - BUCKETS.bit_length() + 1).cast("int")


def _rarity(hashed: DataFrame) -> DataFrame:
    """``rarity`` of lines that are hashed already."""
    counts = hashed.select(F.explode("words").alias("h")).groupBy(_bucket(F.col("h")).alias("bucket")).agg(F.count("*").alias("n"))
    step = F.shiftleft(F.least(F.lit(126), F.floor(3 * F.log2(F.col("n") + 1))).cast("long"), 56)
    every = hashed.sparkSession.range(0, BUCKETS, 1, 8).select(F.col("id").cast("int").alias("bucket"))
    full = every.join(counts.select("bucket", step.alias("step")), "bucket", "left").select("bucket", F.coalesce("step", F.lit(0).cast("long")).alias("step"))
    ordered = lambda key, value: F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: x[value])
    parts = full.groupBy(F.shiftright("bucket", 10).alias("part")).agg(ordered("bucket", "step").alias("steps"))
    return parts.agg(F.flatten(ordered("part", "steps")).alias("steps"))


def _split(source: DataFrame, *columns: str) -> DataFrame:
    """l and line: every line with a word."""
    return source.select(*columns, F.posexplode(F.split(_spaced("text"), "\n")).alias("l", "line")).where(F.trim("line") != "")


def rarity(source: DataFrame) -> DataFrame:
    """One row with an array: for each bucket in how many lines its words are, in steps of
    a third of a doubling, in the eight bits above 56.  Words of one step are ordered by hash."""
    return _rarity(_split(source).select(_hashes("line").alias("words")))


def _needed(a: Column, b: Column, threshold: float) -> Column:
    """Words that sets of sizes a and b must share."""
    return F.ceil(F.lit(threshold / (1 + threshold)) * (a + b) - F.lit(1e-9))


def _possible(an: Column, bn: Column, ap: Column, bp: Column, threshold: float) -> Column:
    """Whether sets of these sizes that share the words at these places can match."""
    length = F.least(an, bn) >= F.lit(threshold) * F.greatest(an, bn) - F.lit(1e-9)
    # words up to this place, then what can follow it
    return length & (F.least(ap, bp) + F.least(an - ap, bn - bp) >= _needed(an, bn, threshold))


def _dense(places: Column | str, value) -> Column:
    """An array with value(x) at place x.l of each entry and null elsewhere, from entries sorted by l."""
    gap = lambda x, k: x["l"] - F.coalesce(F.get(places, k - 1)["l"], F.lit(-1)) - 1
    return F.flatten(F.transform(places, lambda x, k: F.concat(F.array_repeat(F.when(F.lit(False), value(x)), gap(x, k)), F.array(value(x)))))


def _ids(cut_: Column) -> Column:
    """Ids of rows, those of a lower cut first; a partition has 2 ** 31 rows at most."""
    row = F.monotonically_increasing_id()  # the partition in the bits above 33
    return F.shiftleft(cut_.cast("long"), 55) + F.shiftleft(F.shiftright(row, 33), 31) + row.bitwiseAND((1 << 33) - 1)


#: The parts of a bitmap, 64 bits each.
_BITMAP = ("b0", "b1", "b2", "b3")


def _bits(part: int) -> str:
    """The bits of one part of the bitmap of ``bytes``, an array with a byte of each word."""
    return f"aggregate(bytes, 0L, (bits, w) -> bits ^ if((shiftright(int(w), 6) & 3) = {part}, shiftleft(1L, int(w) & 63), 0L))"


def _hashed(source: DataFrame) -> DataFrame:
    """id, d, t, l, set (hash), check (another), n and words (sorted hashes) of every line with a word."""
    cuts = source.agg(F.percentile_approx("d", [(k + 1) / (CUTS + 1) for k in range(CUTS)], 10 * CUTS).alias("cuts")).scalar()
    lines = source.withColumn("cuts", cuts).select("d", "t", "text", F.size(F.filter("cuts", lambda c: c < F.col("d"))).alias("cut"))
    lines = _split(lines, "d", "t", "cut").select("d", "t", "l", "cut", F.sort_array(_hashes("line")).alias("words"))
    return lines.select(_ids(F.col("cut")).alias("id"), "d", "t", "l", F.xxhash64("words").alias("set"), F.hash("words").alias("check"), F.size("words").alias("n"), "words")


def _ordered(firsts: DataFrame, hashed: DataFrame, threshold: float) -> DataFrame:
    """id, d, n, words (31 bits of each of the prefix, rare ones first) and rest (8 bits of each of the
    others) of sets of four words or more; smaller ones match only their equals."""
    # the step above 24 bits of the hash that do not tell the bucket
    steps = _rarity(hashed).select(F.transform("steps", lambda s: F.shiftright(s, 32).cast("int")).alias("steps")).scalar()
    order = lambda h: F.get("steps", _bucket(h)).bitwiseOR(F.shiftright(h, 24).bitwiseAND(0xFFFFFF).cast("int"))
    sets = firsts.where("n >= 4").withColumn("steps", steps).select("id", "d", "n", F.sort_array(F.transform("words", order)).alias("words"))
    n = F.col("n")
    head = _prefix_size(n, F.lit(threshold) * n, threshold)
    rest = F.transform(F.slice("words", head + 1, n), lambda h: (h.bitwiseAND(0xFF) - 128).cast("tinyint"))
    return sets.select("id", "d", "n", F.slice("words", F.lit(1), head).alias("words"), rest.alias("rest"))


def _meetings(firsts: DataFrame, threshold: float, keep: Scratch) -> DataFrame:
    """k, lead, more, id and at: the pairs of neighbours k that more than one set of a class has; lead is the
    least id of these, and more tells whether they are over two.  at is four times the place, two more for a
    set of up to five words, and one more for a set that is sent to the class above its own."""
    n = F.col("n")
    class_ = F.floor(F.log2(n + 0.5)).cast("int")
    up = F.lit(threshold) * F.pow(F.lit(2), F.col("class") + 1) <= n + 1e-9
    sent = firsts.select("id", "n", "words", class_.alias("class"))
    sent = sent.select("id", "n", "words", "class", F.explode(F.when(up, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("up"))
    sent = sent.withColumn("class", F.col("class") + F.col("up"))
    # the least size of a set that can match this one and is of the class
    size = _prefix_size(n, F.greatest(F.lit(threshold) * n, F.pow(F.lit(2), F.col("class"))), threshold)
    every = sent.select("id", "class", "up", "words", (n <= 5).cast("int").alias("short"), F.posexplode(F.slice("words", F.lit(1), size - 1)).alias("p", "x"))
    every = every.select("id", (4 * F.col("p") + 2 * F.col("short") + F.col("up")).alias("at"), F.xxhash64("x", F.get("words", F.col("p") + 1), "class").alias("k"))
    parts = []
    for s in range(SLICES):
        # counted and looked up where they are: one shuffle, and rows of one pair stream through
        own = every.where(F.pmod("k", F.lit(SLICES)) == s).repartition("k")
        # sets of one class that are all sent to the next meet in their own
        met = own.groupBy("k").agg(F.count("*").alias("times"), F.min("id").alias("lead"), F.min(F.col("at").bitwiseAND(1)).alias("up")).where("times > 1 and up = 0")
        met = met.select("k", "lead", (F.col("times") > 2).alias("more"))
        parts.append(keep.put(own.join(met.hint("shuffle_hash"), "k").select("k", "lead", "more", "id", "at")))
        release(firsts.sparkSession)
    return keep.both(parts)


def _prefix_size(m: Column, n: Column, threshold: float) -> Column:
    """Words of the prefix of a set of m for sets of n words or more."""
    shared = F.lit(3 * threshold / (1 + threshold)) * (m + n)
    return F.least(m, (F.floor(2 * m + n - shared + F.lit(1e-9)) + 4).cast("int"))


def _verified(pairs: DataFrame, sets: DataFrame, source: DataFrame, threshold: float, keep: Scratch) -> DataFrame:
    """id, and the place (ad, al) of an earlier set that matches it, for the pairs (a, b) of sets that do."""
    asked = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    places = sets.join(asked, "id").groupBy("d", "t").agg(F.sort_array(F.collect_set(F.struct("l", "id"))).alias("asked"))
    places = keep.put(places.select(F.col("d").alias("asked_d"), F.col("t").alias("asked_t"), "asked"))
    again = source.join(bounded(places, 48, "asked"), (F.col("d") == F.col("asked_d")) & (F.col("t") == F.col("asked_t")))
    # the array is made below the lines, or it would be made for each of them
    again = again.select("d", "t", "text", _dense("asked", lambda x: x["id"]).alias("ids")).select("d", "t", "ids", F.posexplode(F.split(_spaced("text"), "\n")).alias("l", "line"))
    whole = keep.put(again.select("d", "t", "l", F.get("ids", F.col("l")).alias("id"), "line").where("id is not null").select("id", "d", "t", "l", _hashes("line").alias("words")))
    side = lambda s: whole.select(F.col("id").alias(s), F.struct("d", "t", "l").alias(f"at_{s}"), F.col("words").alias(f"words_{s}"))
    both = F.size(F.array_intersect("words_a", "words_b"))
    similarity = both / (F.size("words_a") + F.size("words_b") - both)
    found = pairs.join(side("a"), "a").join(side("b"), "b").where(similarity >= threshold - 1e-9)
    later = F.col("at_a") > F.col("at_b")
    earlier = F.when(later, F.col("at_b")).otherwise(F.col("at_a"))
    found = found.select(F.when(later, F.col("a")).otherwise(F.col("b")).alias("id"), earlier["d"].alias("ad"), earlier["l"].alias("al"))
    out = keep.put(found.groupBy("id").agg(F.min(F.struct("ad", "al")).alias("a")).select("id", "a.ad", "a.al"))
    keep.drop(whole, places)
    release(source.sparkSession)
    return out


def _candidates(met: DataFrame, found: DataFrame, firsts: DataFrame, threshold: float, keep: Scratch) -> DataFrame:
    """Pairs (a, b) of sets that may match and do not meet at a lead; a stands earlier than b, which is not in ``found``."""
    at = F.col("at")
    done = found.select("id", F.lit(True).alias("done"))
    rows = met.where("more and id <> lead").select("k", "id", F.shiftright(at, 2).alias("p"), (at.bitwiseAND(2) > 0).alias("short"), at.bitwiseAND(1).alias("up"))
    rows = rows.join(bounded(done, 16), "id", "left").select("k", "id", "p", "short", "up", F.col("done").isNull().alias("open"))
    two = F.count("*").over(Window.partitionBy("id", "up")) > 1
    for _ in range(PRUNINGS):
        # a set needs two pairs of neighbours, these two sets, of which one is open: what loses them takes others along
        held = keep.put(rows.withColumn("two", two).where("two or short").select("k", "id", "p", "short", "up", "open"))
        rows = held.join(held.groupBy("k").agg(F.count("*").alias("left"), F.count_if("open").alias("opened")).where("left > 1 and opened > 0").select("k"), "k")
    rows = keep.put(rows)
    release(met.sparkSession)
    every = F.concat(F.transform("words", lambda w: (w.bitwiseAND(0xFF) - 128).cast("tinyint")), "rest")
    about = firsts.join(bounded(rows.select("id").distinct(), 16), "id", "left_semi").select("id", "d", "n", every.alias("bytes"))
    about = about.select("id", "d", "n", *(F.expr(_bits(k)).alias(b) for k, b in enumerate(_BITMAP)))
    own = Window.partitionBy("id", "up").orderBy("p")
    known = keep.put(rows.withColumn("prev", F.lag("k").over(own)).drop("short").join(about, "id"))
    release(met.sparkSession)
    open_ = known.where("open")
    other = known.select("k", *(F.col(c).alias(f"a_{c}") for c in known.columns if c != "k"))
    before = (F.col("a_d") < F.col("d")) | ((F.col("a_d") == F.col("d")) & (F.col("a_id") != F.col("id")))
    before &= (F.col("a_up") == 0) | (F.col("up") == 0)  # these have met in their own class
    a_n, n = F.col("a_n"), F.col("n")
    differ = sum((F.bit_count(F.col(f"a_{b}").bitwiseXOR(F.col(b))) for b in _BITMAP[1:]), F.bit_count(F.col("a_b0").bitwiseXOR(F.col("b0"))))
    new = F.col("prev").isNull() | F.col("a_prev").isNull() | (F.col("prev") != F.col("a_prev"))
    pairs = open_.join(other, "k").where(before & new & (differ <= a_n + n - 2 * _needed(a_n, n, threshold)) & _possible(a_n, n, F.col("a_p"), F.col("p"), threshold))
    pairs = keep.put(pairs.select(F.col("a_id").alias("a"), F.col("id").alias("b")).distinct())
    keep.drop(known, rows)
    release(met.sparkSession)
    return pairs


def _earlier(firsts: DataFrame, sets: DataFrame, source: DataFrame, threshold: float, keep: Scratch) -> DataFrame:
    """id, ad, al: for every set that has a match which stands earlier, the place of one."""
    met = _meetings(firsts, threshold, keep)
    first = met.where("id <> lead").groupBy(F.col("lead").alias("a"), F.col("id").alias("b")).agg(F.min(F.shiftright("at", 2)).alias("p"), F.max(F.shiftright("at", 2)).alias("last")).where("p < last")
    first = keep.put(first.select("a", "b"))
    found = _verified(first, sets, source, threshold, keep)
    rest = _candidates(met, found, firsts, threshold, keep)
    keep.drop(met)
    rest = keep.put(rest.join(first, ["a", "b"], "left_anti"))
    more = _verified(rest, sets, source, threshold, keep)
    return found.unionByName(more).groupBy("id").agg(F.min(F.struct("ad", "al")).alias("a")).select("id", "a.ad", "a.al")


def _judged(docs: DataFrame, threshold: float, id_col: str, text_col: str, keep: Scratch) -> DataFrame:
    """d, t, l, n, copies, the place of the set's first line and that of a match (ad, al) for every line with a word."""
    if not 0.8 <= threshold <= 1:
        raise ValueError("the prefix filter holds for thresholds from 0.8 to 1")
    source = ids_and_text(docs, id_col, text_col).where("doc_id is not null and text is not null").select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("t"), "text")
    hashed = keep.put(_hashed(source))
    lines = keep.put(hashed.drop("words"))
    sets = lines.groupBy("set", "check", "n").agg(F.min(F.struct("d", "t", "l", "id")).alias("at"), F.count("*").alias("copies"))
    sets = keep.put(sets.select("set", "check", "at.d", "at.t", "at.l", "at.id", "copies"))
    release(docs.sparkSession)
    # one line of each set: all but the copies
    repeated = sets.where("copies > 1").select(F.col("set").alias("set_"), F.col("check").alias("check_"), F.col("id").alias("id_"))
    same = (F.col("set") == F.col("set_")) & (F.col("check") == F.col("check_"))
    firsts = hashed.join(bounded(repeated, 40), same, "left").where("id_ is null or id = id_").select("id", "d", "n", "words")
    firsts = keep.put(_ordered(firsts, hashed, threshold))
    keep.drop(hashed)
    release(docs.sparkSession)
    earlier = _earlier(firsts, sets, source, threshold, keep)
    known = sets.join(bounded(earlier, 32), "id", "left").select(F.col("set").alias("set_"), F.col("check").alias("check_"), F.col("d").alias("first_d"), F.col("t").alias("first_t"), F.col("l").alias("first_l"), "copies", "ad", "al")
    return lines.select("d", "t", "l", "set", "check", "n").join(known, same)


def verdicts(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for every line with a word.

    doc_id and line (from 0) tell the line, n_words the number of its different words.
    first_doc and first_line tell the first line of the same set, which names its class, and
    n_copies how many lines have that set.  removed tells that an earlier line matches;
    match_doc and match_line one such: for a later copy the first line of its set, else one of
    the sets that were found to match; they are null if there is none.

    Null and empty texts, blank lines and rows without an id have no rows.  Rows that repeat
    both id and text are one document, so their lines are judged alike; rows of one id and
    different texts are documents of their own, in the order of a hash of their texts.  Lines
    of one or two words match only their equals.  A text or a line may be of any length.
    """
    with Scratch(docs.sparkSession) as keep:
        all_ = _judged(docs, threshold, id_col, text_col, keep)
        copy = (F.col("d") != F.col("first_d")) | (F.col("t") != F.col("first_t")) | (F.col("l") != F.col("first_l"))
        match = lambda first, found: F.when(copy, F.col(first)).otherwise(F.col(found))
        return cut(all_.select(
            F.col("d").alias("doc_id"), F.col("l").alias("line"), F.col("n").cast("long").alias("n_words"), F.col("first_d").alias("first_doc"), F.col("first_l").alias("first_line"),
            F.col("copies").alias("n_copies"), (copy | F.col("ad").isNotNull()).alias("removed"), match("first_d", "ad").alias("match_doc"), match("first_l", "al").alias("match_line"),
        ))


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the lines that an earlier line matches, all rows and columns kept.

    A document whose lines all go keeps its row with an empty text; a null text stays null,
    and rows without an id stay as they are.  Other columns may have any names.  Which lines go is
    told by ``verdicts``.
    """
    with Scratch(docs.sparkSession) as keep:
        gone = _judged(docs, threshold, id_col, text_col, keep).where("ad is not null or d <> first_d or t <> first_t or l <> first_l")
        gone = gone.groupBy(F.col("d").alias("gone_d"), F.col("t").alias("gone_t")).agg(F.sort_array(F.collect_set(F.struct("l"))).alias("gone"))
        gone = cut(gone)
    names = {c: f"own_{k}" for k, c in enumerate(docs.columns)}
    own = docs.select(*(docs[c].alias(n) for c, n in names.items()))
    id_, text_ = F.col(names[id_col]).cast("long"), F.col(names[text_col])
    both = own.join(bounded(gone, 48, "gone"), (id_ == F.col("gone_d")) & (F.xxhash64(text_.cast("string")) == F.col("gone_t")), "left")
    both = both.select(*names.values(), _dense("gone", lambda x: F.lit(True)).alias("gone"))
    kept = F.array_join(F.filter(F.split(text_, "\n"), lambda x, k: F.get("gone", k).isNull()), "\n")
    text = F.when(F.col("gone").isNull(), text_).otherwise(kept)
    return both.select(*((text if c == text_col else F.col(n)).alias(c) for c, n in names.items()))
