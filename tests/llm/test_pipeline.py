import hashlib
import os
import random
import re

import pytest
from test_text_operators import families, lines_brute, machine_brute, without

import corpus_pipeline
from moraine.llm import bpe, similar, simhash, toxicity
from moraine.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_stages_in_turn(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.toPandas(), docs.schema)
        assert 0 < docs.count() <= n
        n = docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, whole.collect()))


def shingles(text):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", w)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def groups_brute(rows):
    """The smallest id of each row's group of documents of similarity 0.8 or more."""
    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}
    for i in sets:
        for j in sets:
            if j < i and root[i] != root[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    return root


def test_near_copies_go(spark):
    rnd = random.Random(3)
    texts = ["", " ", None, "a b", "A  b", "one two three four five six"]
    shared = [f"s{k}" for k in range(60)]  # a passage of many documents that are not similar
    for n in range(12):
        base = [f"w{rnd.randrange(300)}" for _ in range(rnd.choice([40, 90, 200]))] + (shared if n % 2 else [])
        for k in range(6):  # single words changed, some more often than a match allows
            own = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2, 3, 4]) if k else 0):
                own[rnd.randrange(len(own))] = f"x{rnd.randrange(1000)}"
            texts.append(" ".join(own))
    rnd.shuffle(texts)
    root = groups_brute(list(enumerate(texts)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    stage = dict(corpus_pipeline.STAGES)["simhash_dedup"]
    assert sorted(r["doc_id"] for r in stage(spark, docs, SF).collect()) == sorted(set(root.values()))
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_near_copies_come_from_the_tree(spark, monkeypatch):
    """Without the search by shingles the stage still finds what lies within two bits, and verifies it."""
    rnd = random.Random(13)
    texts = ["", None, "a b", "A b"]
    for _ in range(12):
        base = [f"w{rnd.randrange(300)}" for _ in range(600)]
        texts += [" ".join(base), " ".join([*base, "end"]), " ".join([*base[:300], "new", *base[300:]])]
    texts += [" ".join(["a b c d e"] * 9), " ".join(["a b c d e"] * 30), "a b c d e " * 60 + "f"]  # fingerprints that are near by repeats
    sets, fp = [shingles(t) for t in texts], [simhash.fingerprint((t or "").encode(), 5) for t in texts]
    root = list(range(len(texts)))
    for i in root[:]:
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= simhash.RADIUS and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    assert 8 < len(texts) - len(set(root)) < 30
    met = similar._meetings
    monkeypatch.setattr(similar, "_meetings", lambda firsts, keep: met(firsts.limit(0), keep))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = dict(corpus_pipeline.STAGES)["simhash_dedup"](spark, docs, SF)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(root))


def test_all_stages_against_brute_force(spark, tmp_path):
    import tiktoken

    rnd = random.Random(12)
    calm, rude = ["sun", "rain", "tree", "road", "cloud", "river"], ["Grumbler!", "nitwit"]
    texts = [None, "", "sun\nrain tree\n\nsun"]
    for k in range(160):
        text = "\n".join(" ".join(rnd.choice(calm) + str(rnd.randrange(9)) for _ in range(rnd.randrange(1, 9))) for _ in range(rnd.randrange(1, 7)))
        texts.append(text + " " + rnd.choice(rude) if k % 5 == 0 else text)
    texts += families(rnd, 40)
    item = " ".join(f"item{k}" for k in range(14))
    texts += [f"look here {item} end", item.upper(), "item1 item2 item3"] + [t + " more" for t in texts[5:25]] + texts[30:40]
    docs = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    made = {
        "documents": spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3),
        "labels": spark.createDataFrame([(k, 1, int(any(w in (t or "") for w in rude))) for k, t in enumerate(texts)], "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(1, item)], "item_id long, text string"),
    }
    for name, df in made.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    machine = toxicity.train(made["documents"], made["labels"])
    left = [(k, t) for k, t, *_ in docs if machine_brute(machine, t) < toxicity.THRESHOLD]
    assert 20 < len(docs) - len(left) < 80
    want, _ = lines_brute(left)
    left = [(k, without(t, k, want)) for k, t in left]
    root = groups_brute(left)
    left = [(k, t) for k, t in left if root[k] == k]
    windows = {tuple(item.split()[k : k + 10]) for k in range(5)}
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    left = [(k, t) for k, t in left if not any(tuple(w[i : i + 10]) in windows for w in [words(t)] for i in range(len(w)))]
    lines_, pattern = bpe.vocabulary()
    codec = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(lines_), special_tokens={})
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    told = [(k, len(x), sha(",".join(map(str, x))), sha(t or "")) for k, t in left for x in [codec.encode_ordinary(t or "")]]
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(told)


def test_names():
    names = list(queries())
    assert [next(n for n in names if n.startswith(f"op{k}_")) for k in range(1, 11)] and "pipeline" in names
    assert set(oracle_sql()) <= set(names)
