"""Token counts, SentencePiece, sharding, quality, toxicity, decontamination and licences on small hand-made tables."""

import os
import random

import pytest
from pyspark.sql import functions as F

from siteward.llm import decontamination, license_scans, quality_rules, sentencepiece_stream, sharding, token_counts, toxicity
from siteward.llm.common import tokenizer_path

DIR = "/root/testdata/sf0.001"
ODD = [None, "", " ", "a", "<|endoftext|> x<|endoftext|>", "naïve café  \n\n\tx", "日本語の文 😀", "x" * 3000, "▁▁ a ▁b", "ab " * 9000, "0123456789" * 4000, "\x00\x01", "é" * 50]


def documents(spark, texts):
    return spark.createDataFrame([(k, t, "en", "src", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


def test_token_counts_are_the_librarys(spark, real):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    docs = documents(spark, ODD).select("doc_id", "text").union(real.select("doc_id", "text"))
    for limit, ranks in ((2_000, "byte_bpe_50k.tiktoken"), (32_768, "byte_bpe_50k.tiktoken"), (32_768, None)):
        got = token_counts.with_token_counts(docs, "byte_bpe_50k.json", 512, max_chars=limit, ranks=ranks).collect()
        for r in got:
            n = len(t.encode(r.text or "", add_special_tokens=False).ids)
            assert (r.n_tokens, r.over_limit, r.n_bytes) == (n, n > 512, len((r.text or "").encode()))


def test_resynchronised_counts(spark):
    t = token_counts.load(tokenizer_path("byte_bpe_50k.json"))
    r = random.Random(3)
    for _ in range(20):
        text = "".join(r.choice(["word ", "  ", "\n", "1234", "x" * 40, "é", "'s", "日本", "<|endoftext|>", "-" * 9]) for _ in range(r.randint(1, 400)))
        assert token_counts.count_resynchronised(t, text, 64, 8) == len(t.encode(text, add_special_tokens=False).ids)


def test_sentencepiece_is_the_librarys(spark, real):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    docs = documents(spark, ODD).select("doc_id", "text").union(real.select("doc_id", "text"))
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append(r.text or "")
    rows = sentencepiece_stream.encoded(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.ids in [sp.encode(t) for t in texts[r.doc_id]]
        assert r.round_trip or any("▁" in t or not t for t in texts[r.doc_id])


def test_sharding_moves_rows_only_into_the_new_shard(spark):
    docs = documents(spark, ["t"] * 40 + [None, ""]).union(documents(spark, ["t"]))
    rows = sharding.shard_rows(docs, [1.0] * 4, [1.0] * 5).collect()
    assert len(rows) == 43
    assert all(r.grown_shard in (r.shard, 4) for r in rows)
    for s in range(4):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    assert {r["size"] for r in rows} == {2, 1}
    assert len({r.shard for r in rows if r.doc_id == 0}) == 1


def xx(*parts):
    """Spark's xxhash64 of strings, as an unsigned number."""
    import xxhash

    seed = 42
    for p in parts:
        seed = xxhash.xxh64_intdigest(p.encode(), seed)
    return seed


def rendezvous(key, weights):
    import math

    draw = [((xx(str(key), f"shard-{s}") >> 11) + 0.5) / 2**53 for s in range(len(weights))]
    return max(range(len(weights)), key=lambda s: (-weights[s] / math.log(draw[s]), s))


def test_unequal_weights_are_rendezvous_hashing(spark):
    weights = [1.0, 5.0, 0.5, 2.0]
    docs = documents(spark, ["t"] * 4000)
    rows = sharding.shard_rows(docs, weights, [*weights, 3.0]).collect()
    assert all((r.shard, r.grown_shard) == (rendezvous(r.doc_id, weights), rendezvous(r.doc_id, [*weights, 3.0])) for r in rows)
    for s, w in enumerate(weights):
        share = sum(r.shard == s for r in rows) / len(rows)
        assert abs(share - w / sum(weights)) < 0.03
    moved = sum(r.shard != r.grown_shard for r in rows) / len(rows)
    assert abs(moved - 3 / (3 + sum(weights))) < 0.03
    with pytest.raises(ValueError):
        sharding.shard_rows(docs, [1.0, 0.0], [1.0, 1.0])


def test_empty_tables_and_clashing_columns(spark):
    """Every operator on texts takes a table without rows, and one whose other columns have the names of its own."""
    odd = documents(spark, [None, "", "a b c", "a b c"])
    for c in ("n_tokens", "n_bytes", "over_limit", "shard", "slot", "size", "score", "predicted", "ids", "matches", "n_items", "fingerprint", "fp", "node", "root", "component_id", "law"):
        odd = odd.withColumn(c, F.lit("clash"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    from siteward.llm import simhash

    for f in (
        lambda d: token_counts.with_token_counts(d, "byte_bpe_50k.json", 512),
        lambda d: sharding.shard_rows(d, [1.0] * 3, [1.0] * 4),
        lambda d: toxicity.score_documents(d, labels),
        lambda d: decontamination.contaminated(d, items),
        lambda d: sentencepiece_stream.encoded(d),
        lambda d: simhash.near_duplicates(d),
    ):
        assert f(odd).count() == 4
        assert f(odd.limit(0)).count() == 0
    kept = simhash.keep_one_of_each(odd.withColumn("m", F.create_map(F.lit("k"), F.lit(1))))
    assert kept.count() == 2 and kept.columns == [*odd.columns, "m"]
    assert [x.n_items for x in decontamination.contaminated(odd, items).orderBy("doc_id").collect()] == [0, 0, 1, 1]


def repeated_words(words, width=5):
    windows = [tuple(words[k : k + width]) for k in range(len(words) - width + 1)]
    twice = {w for w in windows if windows.count(w) > 1}
    return len({k + j for k, w in enumerate(windows) if w in twice for j in range(width)})


def test_quality_counts(spark):
    r = random.Random(1)
    texts = [*ODD, "a b c d e\na b c d e\n\n x", *(" ".join(r.choice("abc") for _ in range(r.randint(0, 40))) for _ in range(30))]
    rows = {x.doc_id: x for x in quality_rules.quality(documents(spark, texts).withColumn("n_words", F.lit("clash"))).collect()}
    for k, t in enumerate(texts):
        words = (t or "").replace("\x0b", " ").split(" ")
        words = [w for x in words for w in x.replace("\t", " ").replace("\n", " ").split(" ") if w]
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\r\x0b\x0c")]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), repeated_words(words))
        assert tuple(rows[k][c] for c in quality_rules.COUNTS) == want
        assert rows[k].base_failed == (len(words) < 10 or 100 * want[4] > 20 * len(words))
        assert not (rows[k].base_failed and rows[k].kept)


def test_quality_of_nothing(spark):
    assert quality_rules.quality(documents(spark, [])).count() == 0
    kept = quality_rules.keep_good(documents(spark, [None, "", "one two"]))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"] and kept.count() == 0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def least_errors(word, terms):
    """The errors of the nearest term, or -1, by edit distances to the terms, and of stems to all beginnings of the word."""
    best = []
    for t in terms:
        d = min(edit_distance(word[:k], t.text) for k in range(len(word) + 1)) if t.stem else edit_distance(word, t.text)
        best += [d] if d <= t.limit else []
    return min(best, default=-1)


def misspelt(r, word):
    k = r.randrange(len(word))
    return word[:k] + r.choice(["", "x", word[k] + "q"]) + word[k + 1 :]


def test_the_automaton_is_edit_distance():
    terms = [toxicity.Term(*t) for t in [("abcde", 1, False), ("vermin", 1, False), ("abominable", 2, False), ("zqx", 0, False), ("stem", 0, True), ("verbose", 1, True), ("abo", 0, False)]]
    lexicon, r = toxicity.Lexicon(terms), random.Random(5)
    for _ in range(3000):
        w = r.choice(terms).text + r.choice(["", "", "er", "xq"])
        for _ in range(r.randint(0, 3)):
            w = misspelt(r, w) or "a"
        assert lexicon.errors(w) == least_errors(w, terms), w


@pytest.fixture(scope="module")
def detector(spark):
    d = "/root/testdata/sf0.1"
    return toxicity.train_detector(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))


def test_scores_by_edit_distances_alone(spark, real, detector):
    """The query's score is that of a plain count over all words and all terms."""
    import math
    import re

    words_of = lambda w: re.findall(r"[^\W\d_]+", w)
    known = {}
    r = random.Random(1)
    texts = [x.text for x in real.limit(60).collect() if x.text and len(x.text) < 3000] + [f'he said "you {t.text} {misspelt(r, t.text)}" and went, {misspelt(r, t.text)}' for t in detector.terms] + [None, ""]
    rows = documents(spark, texts).select("doc_id", toxicity.toxicity_score(F.col("text"), detector).alias("score")).collect()
    for row in rows:
        words, hits = (texts[row.doc_id] or "").lower().split(), []
        for k, w in enumerate(words):
            found = []
            for x in words_of(w):
                if x not in known:
                    known[x] = least_errors(x, detector.terms)
                found += [known[x]] if known[x] >= 0 else []
            if found:
                hits.append((k, min(found)))
        counts = [0] * 5
        for k, e in hits:
            quoted = toxicity.Detector.quoted(words, k)
            counts[2 * quoted + (e > 0)] += 1
            counts[4] += not quoted and any(j != k and abs(j - k) <= toxicity.WINDOW for j, _ in hits)
        z = detector.weights[-1] + sum(w * math.log1p(c) for w, c in zip(detector.weights, counts))
        assert abs(row.score - 1 / (1 + math.exp(-z))) < 1e-9


def test_misspelt_terms_are_found(spark, detector):
    """Every term of 5 letters that clean texts have no neighbours of is met misspelt, and held-out toxic texts are as well found
    with all of their terms misspelt as without."""
    r = random.Random(9)
    fuzzy = [t for t in detector.terms if t.limit]
    assert len(fuzzy) >= 5 and detector.weights[1] > 0
    for t in fuzzy:
        assert detector.lexicon.errors(misspelt(r, t.text)) >= 0
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = docs.where(toxicity.held_out(F.col("doc_id"))).join(labels.where("toxic = 1").select("doc_id"), "doc_id").collect()
    caught = again = 0
    for row in rows:
        words = row.text.lower().split()
        met = [detector.lexicon.met(x)[:1] for w in words for x in toxicity.WORD.findall(w)]
        if detector.score(detector.features(row.text)) >= 0.7 and all(detector.terms[m[0][1]].limit for m in met if m):
            worse = " ".join(misspelt(r, w) if any(detector.lexicon.errors(x) == 0 for x in toxicity.WORD.findall(w)) else w for w in words)
            caught += 1
            again += detector.score(detector.features(worse)) >= 0.7
    assert caught >= 20 and again >= 0.9 * caught


def test_toxicity_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    scored = toxicity.score_documents(docs, labels)
    assert scored.count() == docs.count()
    rows = scored.where("held_out").join(labels.select("doc_id", "toxic"), "doc_id").collect()
    hits = sum(r.predicted and r.toxic for r in rows)
    assert hits >= 0.8 * sum(r.toxic for r in rows)
    assert hits >= 0.9 * sum(r.predicted for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_toxicity_of_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.score_documents(documents(spark, ODD), none).collect()
    assert len(got) == len(ODD) and all(r.predicted == 0 for r in got)
    assert toxicity.keep_clean(documents(spark, []), none).count() == 0


def shingles(text, width=5):
    words = text.lower().split() if text else []
    return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def test_decontamination_is_exact_containment(spark):
    r = random.Random(2)
    word = lambda: r.choice("abcdefghij") + str(r.randrange(80))
    items = [" ".join(word() for _ in range(r.choice([3, 6, 20, 90]))) for _ in range(30)] + [None, ""]
    texts = [None, "", "x"]
    for _ in range(60):
        own = [word() for _ in range(r.randint(0, 600))]
        k = r.randint(0, len(own))
        part = (r.choice(items) or "").split()
        for _ in range(r.randint(0, 2)):
            if part:
                part[r.randrange(len(part))] = "changed"
        texts.append(" ".join(own[:k] + part + own[k:]))
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {x.doc_id: x.item_ids for x in decontamination.contaminated(documents(spark, texts), benchmark).collect()}
    for k, t in enumerate(texts):
        have = shingles(t)
        want = [i for i, x in enumerate(items) if (s := shingles(x)) and len(s & have) >= 0.8 * len(s)]
        assert got[k] == want
    blocks = decontamination.contaminated(documents(spark, texts), benchmark, block_bytes=20_000).collect()
    assert {x.doc_id: x.item_ids for x in blocks} == got
    clean = decontamination.drop_contaminated(documents(spark, texts), benchmark)
    assert {x.doc_id for x in clean.collect()} == {k for k in got if not got[k]}


def test_decontamination_of_odd_tables(spark):
    items = spark.createDataFrame([("a", "one two three four five six"), (None, "x"), ("b", None), ("a", "one two three four five six")], "item_id string, text string")
    docs = documents(spark, ["zero one two three four five six seven", None, ""]).withColumn("item_id", F.lit("clash"))
    got = decontamination.contaminated(docs, items).orderBy("doc_id").collect()
    assert [x.item_ids for x in got] == [["a", "a"], [], []]
    assert decontamination.contaminated(docs.limit(0), items).count() == 0
    assert decontamination.drop_contaminated(docs, items.limit(0)).count() == 3


def test_scattered_and_edited_items_are_found():
    """Items of all sizes, whole or in two parts, with 15 % of the shingles gone: the index misses none."""
    r = random.Random(11)
    items, texts = [], []
    for k, n in enumerate([5, 12, 20, 21, 25, 37, 70, 90, 133, 260]):
        words = [f"w{k}_{j}" for j in range(n)]
        items.append((k, " ".join(words)))
        cut = n // 2
        noise = lambda m: [f"n{r.randrange(10**6)}" for _ in range(m)]
        texts.append(" ".join(noise(300) + words + noise(200)))
        texts.append(" ".join(words[: cut + 2] + noise(900) + words[cut - 2 :]))
    index = decontamination.Index(items, 0.8, 5, decontamination.PERMUTATIONS)
    have = [shingles(t) for t in texts]
    for found, h in zip(index.matches(texts), have):
        assert [k for k, _ in found] == [k for k, t in items if len(shingles(t) & h) >= 0.8 * len(shingles(t))]


def test_licences_and_inheritance(spark):
    rows = [
        ("a/LICENSE", "Released under the MIT License."),
        ("a/b/x.py", "import os"),
        ("a/b/LICENSE", "Licensed under the Apache License, Version 2.0."),
        ("a/b/c/y.py", "code\ncode"),
        ("a/b/c/z.py", "# This work is licensed under the GNU General Public License, version 3.\n" + "code and more of it\n" * 9),
        ("d/w.py", "nothing"),
        (None, "nothing"),
        ("a/b/x.py", "import os"),
        ("a/n.py", None),
    ]
    f = spark.createDataFrame(rows, "path string, text string").withColumn("licence_key", F.lit(1))
    got = sorted((r.path or "", r.licence, r.how, r.licence_path) for r in license_scans.scan(f).collect())
    assert got == sorted(
        [
            ("a/LICENSE", "MIT", "file", "a/LICENSE"),
            ("a/b/x.py", "Apache-2.0", "inherited", "a/b/LICENSE"),
            ("a/b/x.py", "Apache-2.0", "inherited", "a/b/LICENSE"),
            ("a/b/LICENSE", "Apache-2.0", "file", "a/b/LICENSE"),
            ("a/b/c/y.py", "Apache-2.0", "inherited", "a/b/LICENSE"),
            ("a/b/c/z.py", "GPL-3.0", "header", "a/b/c/z.py"),
            ("d/w.py", None, None, None),
            ("", None, None, None),
            ("a/n.py", "MIT", "inherited", "a/LICENSE"),
        ],
        key=lambda r: (r[0], str(r[1])),
    )
    assert license_scans.scan(f.limit(0)).count() == 0


def test_texts_of_licences(spark):
    t = license_scans.TEMPLATES
    mit = f"/*\n * Copyright (c) 2020 A. Nyone\n *\n * {t['MIT#grant'].replace(chr(10), chr(10) + ' * ')}\n *\n * The above copyright notice and this permission notice\n * shall be included in all copies.\n */\n" + "int main() { return 0; }\n" * 40
    gpl = "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n" + "Everyone is permitted to copy and distribute verbatim copies. " * 30
    bsd2 = t["BSD-2-Clause#full"].replace("(c)", "(c) 2001, Some Body.")
    bsd3 = "// " + t["BSD-2-Clause#generic"] + "\n//\n// * " + t["BSD-3-Clause#endorse"].replace("the copyright holder", "Some Body") + "\n\ncode();"
    apache = "#\n# " + t["Apache-2.0#header"].replace("\n", "\n# ") + "\n#\nprint(1)\n" + "x = 1\n" * 50
    rows = [
        ("m/src/a.c", mit, "MIT", "header", "m/src/a.c"),
        ("g/COPYING", gpl, "GPL-3.0", "file", "g/COPYING"),
        ("g/src/b.c", "nothing of the kind", "GPL-3.0", "inherited", "g/COPYING"),
        ("g/src/c.c", "// SPDX-License-Identifier: Apache-2.0\ncode", "Apache-2.0", "header", "g/src/c.c"),
        ("g/src/d.c", "// SPDX-License-Identifier: GPL-2.0-or-later\ncode", "GPL-2.0", "header", "g/src/d.c"),
        ("g/src/e.c", "// SPDX-License-Identifier: Unheard-Of\ncode", "GPL-3.0", "inherited", "g/COPYING"),
        ("b/LICENSE.txt", bsd2, "BSD-2-Clause", "file", "b/LICENSE.txt"),
        ("c/x.js", bsd3, "BSD-3-Clause", "header", "c/x.js"),
        ("d/x.py", apache, "Apache-2.0", "header", "d/x.py"),
        ("e/x.c", "/* This library is free software; " + t["LGPL-2.1#header"].partition("; ")[2] + " */", "LGPL-2.1", "file", "e/x.c"),
        ("f/LICENSE", f"Copyright (c) 2020 A. Nyone\n\n{t['MIT#grant']}\n\nshort of the rest", "MIT", "file", "f/LICENSE"),
        ("f/z.py", "", "MIT", "inherited", "f/LICENSE"),
        ("h/y.txt", "all rights reserved by nobody in this long sentence about quite other things", None, None, None),
    ]
    f = spark.createDataFrame([r[:2] for r in rows], "path string, text string")
    got = {r.path: (r.licence, r.how, r.licence_path) for r in license_scans.scan(f).collect()}
    assert got == {r[0]: r[2:] for r in rows}


def test_pipeline_stages_keep_columns(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, DIR)
        assert out.columns == docs.columns, name
        kept = {r.doc_id for r in out.collect()}
        assert kept <= ids and kept
    assert pipeline.run(spark, DIR).count() > 0
    assert os.path.exists(DIR)


def test_table_of_numbers_is_a_dict():
    import numpy as np

    r, table, want = random.Random(7), sentencepiece_stream.Table(4), {}
    for _ in range(30):
        new = {k: r.randrange(9) for k in (r.randrange(2**45) >> r.choice([0, 38]) for _ in range(r.randrange(90))) if k not in want}
        table.put(np.array(list(new), np.int64), np.array(list(new.values()), np.int32))
        want |= new
        keys = [*want, *(r.randrange(3000) for _ in range(50))]
        assert table.get(np.array(keys, np.int64)).tolist() == [want.get(k, -1) for k in keys]
