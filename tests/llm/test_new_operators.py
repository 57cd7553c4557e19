"""Exact dedup, alignment of tokenizers and divergence of sources against brute-force versions, and on odd rows."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from moraine.llm import alignment, divergence, recipes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, recipe string, block int, local int, segment string, term string, n long, told_id long, stays boolean"


def table(spark, rows):
    """Documents (doc_id, text, lang, source) with columns whose names operators use inside."""
    return spark.createDataFrame([(*r, None, 1, "r", 2, 3, "s", "t", 4, 5, True) for r in rows], SCHEMA).repartition(3)


def texts(seed=1):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["the", "of", "Cat", "dog.", "run", "é中", f"w{rnd.randrange(40)}"])
    made = [rnd.choice([" ", "\n", "\t "]).join(word() for _ in range(rnd.choice([1, 30, 900]))) for _ in range(25)]
    made += ["", None, " ", "\n\t", "a", "x" * 9000, "same  text", "same\ttext", "same text", "same text ", "long " * 30000]
    return made + [t and t.replace(" ", "  ") for t in made[:12]] + made[5:15]


# --- exact dedup --------------------------------------------------------------------


def equal_texts(rows):
    by = collections.defaultdict(list)
    for i, t in rows:
        by[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = []
    for norm, ids in by.items():
        known = [i for i in ids if i is not None]
        least = min(known, default=None)
        for i in ids:
            out.append((i, least, len(ids), hashlib.sha256(norm.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("bits", [64, 3, 1])
def test_equal_texts(spark, bits):
    rows = list(enumerate(texts()))
    random.Random(2).shuffle(rows)
    got = recipes.groups(table(spark, [(i, t, "en", "s") for i, t in rows]), hash_bits=bits).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == sorted(equal_texts(rows))
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "a b"), (1, "a  b"), (0, "a b "), (None, "a b"), (None, "z"), (None, "z"), (7, None), (6, ""), (1, "other")]
    got = recipes.groups(table(spark, [(i, t, "en", "s") for i, t in rows])).collect()
    assert sorted(map(repr, ((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got))) == sorted(map(repr, equal_texts(rows)))
    assert sorted(map(repr, ((r.doc_id, r.group_size) for r in got if r.kept))) == sorted(map(repr, [(0, 1), (1, 3), (None, 2), (6, 2), (1, 1)]))
    assert recipes.groups(table(spark, rows and [(1, "a", "", "")]).where("false")).count() == 0


def test_chunks_make_up_the_text(spark):
    df = spark.createDataFrame([(t,) for t in texts(4)], "t string").select(recipes.normalised("t").alias("t")).select("t", recipes.chunked("t").alias("c"))
    for r in df.collect():
        assert "".join(r.c) == r.t and all(0 < len(c) <= recipes.MOST for c in r.c)
    a, b = spark.createDataFrame([("abc dog. " * 3000,), ("new start, then " + "abc dog. " * 3000,)], "t string").select(recipes.chunked("t").alias("c")).collect()
    assert len(set(a.c) & set(b.c)) > 0  # cuts follow the content


def test_rows_that_stay(spark):
    rows = [(i, t, "en", "s") for i, t in enumerate(texts(3))] + [(0, texts(3)[0], "de", "s")]
    df = table(spark, rows)
    out = recipes.deduplicate(df).collect()
    want = {i for i, least, *_ in equal_texts([(r[0], r[1]) for r in rows]) if i == least}
    assert sorted(r.doc_id for r in out) == sorted(want) and out[0].asDict().keys() == set(df.columns)


# --- alignment ----------------------------------------------------------------------


def aligned(rows):
    """Whole texts by both tokenizers as their libraries give them."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(c): c for c in own} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in own)}
    of_a = {i: bytes(byte[c] for c in e) for e, i in a.get_vocab().items() if e != "<|endoftext|>"}
    of_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    docs, counts = [], collections.Counter()
    for doc, text in rows:
        x, y = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        ends = [[], []]
        for k, parts in enumerate(([of_a[i] for i in x], [of_b(i) for i in y])):
            if text and b"".join(parts) != (" " + text).encode():
                x, y = [], []
            at = 0
            for p in parts:
                at += len(p)
                ends[k].append(at)
        groups, links, i, j = [], [], 0, 0
        for e in sorted(set(ends[0]) & set(ends[1])) if x else []:
            p, q = ends[0].index(e) + 1, ends[1].index(e) + 1
            groups.append(",".join(map(str, x[i:p])) + "|" + ",".join(map(str, y[j:q])))
            links.append((x[p - 1], y[q - 1]))
            i, j = p, q
        counts.update(links)
        docs.append((doc, x, y, groups, links))
    most = collections.Counter()
    for (_, q), n in counts.items():
        most[q] = max(most[q], n)
    sha = lambda g: hashlib.sha256(";".join(g).encode()).hexdigest()
    return sorted((d, len(x), len(y), len(g), len(l), sum(counts[k] == most[k[1]] for k in l), sum(counts[k] for k in l), sha(g) if x else "") for d, x, y, g, l in docs), counts


def test_alignment_is_that_of_whole_texts(spark, monkeypatch):
    rnd = random.Random(5)
    some = ["a", " ", "  ", "\n", "\r", "\r\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "　", "​", "▁", "<s>", "<0x0A>", "<|endoftext|>", "'s", "é", "é", "中", "😀", "12", ";", "});", "\x00", "ﬁ", "İ", "word", "the"]
    rows = [(k, "".join(rnd.choice(some) for _ in range(rnd.randrange(1, 30)))) for k in range(400)]
    rows += [(500, "the cat sat"), (500, "the cat sat"), (501, ""), (502, None), (503, "y" * 20000), (504, " the ▁ cat")]
    rows += [(600 + k, t) for k, t in enumerate(texts(6)) if t and len(t) < 10000]
    out, pairs = alignment.align(table(spark, [(i, t, "en", "s") for i, t in rows]))
    want, counts = aligned(rows)
    assert sorted(map(tuple, out.collect())) == want and any(w[1] == 0 for w in want)
    assert {(r.a, r.b): r.n for r in pairs.collect()} == counts


def test_alignment_of_nothing(spark):
    df = table(spark, [(1, "", "", ""), (2, None, "", "")])
    assert sorted(tuple(r)[:7] for r in alignment.align(df)[0].collect()) == [(1, 0, 0, 0, 0, 0, 0), (2, 0, 0, 0, 0, 0, 0)]
    out, pairs = alignment.align(df.where("false"))
    assert out.count() == pairs.count() == 0


def test_cuts_are_verified():
    both = alignment.Tokenizers(*alignment.default_paths())
    assert both.cuttable() == " \n\t"  # pieces end in a carriage return
    both.entries.append("x y")
    assert both.cuttable() == "\n\t"
    both.identity = False
    assert both.cuttable() == ""
    find = alignment._segments(" \n").findall
    assert find(" a b\n c\td\xa0e \n") == [" a", " b", "\n c\td\xa0e", " \n"] and find("") == []
    assert alignment._unpacked(alignment._packed(np.arange(5, dtype=np.int32))).tolist() == [0, 1, 2, 3, 4]


def test_small_blocks(spark, monkeypatch):
    rows = [(k, t) for k, t in enumerate(texts(7)) if t is None or len(t) < 10000]
    df = table(spark, [(i, t, "en", "s") for i, t in rows])
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([t for _, t in rows])], ["doc_id", "text"])
    monkeypatch.setattr(alignment, "BLOCK", 2000)
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: type("T", (), {"partitionId": lambda self: 3})())
    made = pa.Table.from_batches(alignment._code([batch], " \n\t")).to_pylist()
    held = {(r["block"], r["local"]): r["segment"] for r in made if r["local"] is not None}
    docs = {r["doc_id"]: "".join(held[r["block"], c] for c in alignment._unpacked(r["codes"]).tolist()) for r in made if r["row"] is not None}
    assert docs == {i: " " + t if t else "" for i, t in rows} and len({r["block"] for r in made}) > 3
    times = collections.Counter((r["block"], c) for r in made if r["row"] is not None for c in alignment._unpacked(r["codes"]).tolist())
    assert times == {(r["block"], r["local"]): r["times"] for r in made if r["local"] is not None} and df.count() == len(rows)


# --- divergence ---------------------------------------------------------------------


def divergences(rows, least=10, top=10):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    groups = collections.defaultdict(collections.Counter)
    docs = collections.Counter()
    for _, text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))
        groups[lang or "", source or ""].update(terms)
        docs.update((lang or "", t) for t in set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (l, t), n in docs.items() if l == lang and n >= least)
        own = {s: c for (l, s), c in groups.items() if l == lang}
        total = sum(own.values(), collections.Counter())

        def share(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 1000000000 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        f = lambda p, q: (p - q) * (p - q) // (p + q)
        p, whole = {s: share(c) for s, c in own.items()}, share(total)
        for s in own:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in own if o != s]
            terms = [(f(p[s][t], whole[t]), t) for t in kept if own[s][t] and p[s][t] > whole[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                for rank, (value, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode())), 1):
                    if part == "pair" or rank <= top:
                        out.append((lang, s, part, item, value, rank))
    return sorted(out)


def test_divergence(spark, monkeypatch):
    rnd = random.Random(8)
    rows = [(k, " ".join(rnd.choice(["The", "of", "cat's", "x_y", "é中", "ÀB", f"w{chr(97 + rnd.randrange(26))}", f"q{chr(97 + k % 26)}"]) for _ in range(rnd.choice([0, 5, 60]))), rnd.choice(["en", "de", None]), rnd.choice(["s1", "s2", "s3", "", None])) for k in range(300)]
    rows += [(900, None, "fr", "s1"), (901, "", "fr", "s2"), (902, "one", "fr", None), (903, "x" * 3_000_000 + " of the of", "en", "s1"), (904, "of the " * 400_000, "en", "s4"), (5, rows[5][1], rows[5][2], rows[5][3])]
    got = divergence.audit(table(spark, rows))
    assert sorted(map(tuple, got.select("lang", "source", "part", "item", "value", "rank").collect())) == divergences(rows)
    assert divergence.audit(table(spark, rows).where("false")).count() == 0


def test_parts_of_a_task(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 3)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in (["en", "en", "de"], ["s", "s", "t"], ["a b c d e", "a f g h a", ""])], ["lang", "source", "text"])
    parts = list(divergence._count_terms(iter([batch])))
    total = collections.Counter()
    for p in parts:
        for r in p.to_pylist():
            total[r["lang"], r["source"], r["term"], "n"] += r["n"]
            total[r["lang"], r["source"], r["term"], "docs"] += r["docs"]
    assert len(parts) > 2 and total["en", "s", b"a", "n"] == 3 and total["en", "s", b"a", "docs"] == 2 and ("de", "t", None, "n") in total


def test_pieces_of_a_long_text():
    text = b"ab " * 800_000 + b"x" * 2_500_000 + b" end"
    words = [w for p in divergence._pieces(text) for w in p]
    assert words == text.split()


def test_shares_beyond_64_bits(spark):
    n, total = 10**17, 10**18
    assert spark.createDataFrame([(n, total, 5)], "n long, total long, v long").select(divergence._share("n", "total", "v")).first()[0] == 1 + 10**9 * (n + 2) // (total + 10)


def test_queries_are_the_operators(spark):
    from moraine.llm import queries

    d = "/root/testdata/sf0.001"
    for name in ("op11_exact", "op12_alignment"):
        out = queries.queries()[name](spark, d)
        assert out.count() == spark.read.parquet(f"{d}/documents.parquet").count() and out.columns[0] == "doc_id"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang", "source").collect()
    assert sorted(map(tuple, queries.op13_divergence(spark, d).collect())) == divergences([tuple(r) for r in docs])
    assert sorted(map(tuple, queries.op12_alignment(spark, d).collect())) == aligned([(r.doc_id, r.text) for r in docs])[0]


def test_other_columns_of_any_name(spark):
    """Every operator that gives back the documents keeps them as they are, whatever their other columns are called."""
    from moraine.llm import decontam, lines, simhash, toxicity

    clash = ["gone_id", "gone_d", "gone_t", "gone", "d", "t", "l", "id", "item_id", "told_id", "own_0", "score", "predicted", "component_id", "n_hit", "contaminated", "kept", "k", "fp", "node", "root"]
    long = " ".join(f"word{k}" for k in range(30))
    rows = [(1, long + "\nthe same line of words", "en"), (2, "the same line of words\nother words of this one", "en"), (3, long + "\nthe same line of words", "en"), (None, None, "en")]
    df = spark.createDataFrame([(*r, *range(len(clash))) for r in rows], "doc_id long, text string, lang string, " + ", ".join(f"{c} int" for c in clash))
    labels = spark.createDataFrame([(1, 0, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    for out in (lines.deduplicate(df), simhash.deduplicate(df), simhash.deduplicate(df, similarity=None), recipes.deduplicate(df), toxicity.drop_toxic(df, toxicity.train(df, labels)), decontam.decontaminate(df, spark.createDataFrame([(1, "nothing of these at all here")], "item_id long, text string"))):
        assert out.columns == df.columns
        assert all(tuple(r)[3:] == tuple(range(len(clash))) for r in out.collect())
    assert sorted(str(r.doc_id) for r in simhash.deduplicate(df).collect()) == ["1", "2", "None"]
    assert {r.doc_id: r.text for r in lines.deduplicate(df).collect()} == {1: rows[0][1], 2: "other words of this one", 3: "", None: None}
