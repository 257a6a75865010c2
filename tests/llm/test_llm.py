"""The training-data operators against brute force, on small tables with awkward rows."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from tests.check_catalog import difference, views
from tidewheel.llm import (_graph, decontaminate, embedding_dedup, langid, licenses, line_dedup, lm_score, minhash_dedup, packing, toxicity, warc)

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id int, key int, component_id string"


def docs(spark, rows):
    """(doc_id, text) rows beside columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "en", "src0", len(t or ""), 7, 8, "x") for i, t in rows], DOCS)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def awkward(n=60, seed=3):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 7))) for _ in range(80)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(40)) for _ in range(n // 3)]
    rows = [(k, t) for k, t in enumerate(base)]
    for k, t in enumerate(base):  # near copies
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        rows.append((100 + k, " ".join(w) + "\n" + base[0]))
    rows += [(200, None), (201, ""), (202, " \n\t "), (203, "one"), (204, "ONE"), (205, base[1]), (206, base[1]), (205, base[1]), (None, base[1]), (None, None),
             (207, " ".join(rng.choice(vocabulary) for _ in range(30000)))]
    return rows


def test_registered():
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in QUERIES) == 1
    assert "pipeline" in QUERIES and [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "minhash", "decontamination", "packing"]


@pytest.mark.parametrize("name", sorted(k for k in SQL if re.match(r"op\d", k)))
def test_sql(spark, name):
    assert difference(QUERIES[name](spark, SF).toPandas(), views(SF).execute(SQL[name]).df()) == ""


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(250)] + [(k, k + 1) for k in range(1000, 1100)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in _graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert _graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, size, percent):
    rows = awkward()
    sets = collections.defaultdict(list)
    for i, t in rows:
        w = words(t)
        sets[i].append({tuple(w[k:k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    ids = sorted(i for i in sets if i is not None)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in ids:
        for b in ids:
            x, y = sets[a][0], sets[b][0]
            if a < b and x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    got = minhash_dedup.near_duplicates(docs(spark, rows), size=size, percent=percent).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.kept and r.component_id is None
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id][0]), find(r.doc_id), find(r.doc_id) == r.doc_id)
    left = minhash_dedup.without_near_duplicates(docs(spark, rows), size=size, percent=percent)
    kept = sorted(r.doc_id for r in left.collect() if r.doc_id is not None)
    assert left.columns == docs(spark, rows).columns and kept == sorted(i for i in ids if find(i) == i)
    assert minhash_dedup.near_duplicates(docs(spark, [])).count() == 0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance():
    rng = random.Random(1)
    pairs = []
    for _ in range(800):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(0, 14)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            b[rng.randint(0, len(b)):rng.randint(0, len(b))] = rng.choice(["", "a", "c"])
        pairs.append((a, "".join(b)))
    for edits in range(4):
        got = line_dedup.within([a for a, _ in pairs], [b for _, b in pairs], edits)
        assert got.tolist() == [edit_distance(a, b) <= edits for a, b in pairs]


def test_segments_meet():
    """Lines within the threshold share a probed segment."""
    rng = random.Random(2)
    for _ in range(500):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(15, 60)))
        b = list(a)
        for _ in range(2):
            k = rng.randrange(len(b))
            b[k:k + rng.randint(0, 1)] = rng.choice(["", "a", "b"])
        short, long = sorted((a, "".join(b)), key=len)
        index = {(i, short[p:p + n]) for i, (p, n) in enumerate(line_dedup.segments(len(short), 2))}
        assert any((i, long[p:p + n]) in index for i, p, n in line_dedup.probes(len(long), len(short), 2))


def test_line_dedup(spark):
    line = "The same line stands in many of the documents here, again."
    near = line.replace("many", "mamy")
    rows = [(1, f"First words.\n{line}\nLast words of one."), (2, f" {near} \nSomething else entirely here."), (3, line), (4, None), (5, ""),
            (6, "short\nshort"), (7, f"{line}\n{line}x\nOwn line of the seventh document."), (None, line), (8, "Nothing repeats in this one\n\n")]
    got = {(r.doc_id, r.line_no, r.rep_doc_id, r.rep_line_no) for r in line_dedup.repeated_lines(docs(spark, rows)).collect()}
    assert got == {(2, 0, 1, 1), (3, 0, 1, 1), (7, 0, 1, 1), (7, 1, 1, 1)}
    left = line_dedup.without_repeated_lines(docs(spark, rows))
    assert left.columns == docs(spark, rows).columns
    texts = {r.doc_id: (r.text, r.n_chars) for r in left.collect()}
    assert texts[2] == ("Something else entirely here.", 29) and texts[7][0] == "Own line of the seventh document."
    assert 3 not in texts and texts[4] == (None, 0) and texts[5] == ("", 0) and texts[None][0] == line and texts[8][0].endswith("one\n\n")
    assert line_dedup.repeated_lines(docs(spark, [])).count() == 0


def test_line_dedup_brute_force(spark):
    """Lines of 15 to 80 characters, edited, over documents that share ids."""
    rng = random.Random(8)
    known = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(13, 80))).strip() for _ in range(60)]
    rows = []
    for i in range(120):
        lines = []
        for _ in range(rng.randint(0, 6)):
            b = list(rng.choice(known))
            for _ in range(rng.choice([0, 0, 1, 2, 3, 4])):
                k = rng.randrange(len(b))
                b[k:k + rng.randint(0, 1)] = rng.choice(["", "a", "x"])
            lines.append(rng.choice(["", " ", "\t"]) + "".join(b) + rng.choice(["", " "]))
        rows.append((i % 90, "\n".join(lines)))
    seen = sorted({(i, k, x.strip()) for i, t in rows for k, x in enumerate(t.split("\n")) if len(x.strip()) >= 15})
    texts = sorted({x for _, _, x in seen})
    part = {x: x for x in texts}

    def root(x):
        while part[x] != x:
            x = part[x]
        return x
    for a, b in itertools.combinations(texts, 2):
        if abs(len(a) - len(b)) <= 2 and root(a) != root(b) and edit_distance(a, b) <= 2:
            part[root(a)] = root(b)
    first = {}
    for i, k, x in seen:
        first.setdefault(root(x), (i, k))
    want = collections.Counter((i, k, len(x), *first[root(x)]) for i, k, x in seen if first[root(x)] != (i, k))
    got = collections.Counter(tuple(r) for r in line_dedup.repeated_lines(docs(spark, rows)).collect())
    assert got == want and sum(want.values()) > 100


def test_decontaminate(spark):
    items = spark.createDataFrame([(1, "If Anna has 12 apples and buys 5 km of rope, how many apples does Anna have now in total?"), (2, None), (3, ""),
                                   (4, "A shop sells 40 red pens. Then Bob buys 7 of them for 3 dollars each today.")], "item_id long, text string")
    rows = [(1, "intro. If Peter has 99 apples and buys 31 miles of rope, how many apples does Peter have now in total? tail"),
            (2, "clean text about Anna and 12 apples that shares nothing else with any question"), (3, None), (4, ""),
            (5, "a shop sells 1,000 red pens. Then Li buys 2 of them for 3.50 euros each today."), (5, "a"),
            (6, "if Peter has 1 apples and buys 2 miles of rope, how many apples does Zoe have"), (None, "If Anna has 12 apples and buys 5 km of rope")]
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs(spark, rows), items, consistency=0.95).collect()}
    assert got == {(1, 1), (5, 4)}  # the sixth is short and maps one name to two
    assert {2, 3, 4, None} <= {r.doc_id for r in decontaminate.without_benchmark(docs(spark, rows), items).collect()} <= {2, 3, 4, 6, None}
    assert decontaminate.matches(docs(spark, []), items).count() == 0 == decontaminate.matches(docs(spark, rows), items.limit(0)).count()


ASKED = [(1, "If Anna has 12 apples and buys 5 km of rope, how many apples does Anna have now in total?")]
VARIANT = "If Peter has 99 apples and buys 31 miles of rope, how many apples does Peter have now in total?"
OTHER = "If Maria has 7 apples and buys 2 miles of rope, how many apples does Maria have now in total?"
SPOILT = "If Peter has 99 apples and buys 31 miles of rope, how many apples does Zoe have now in total?"


def test_decontaminate_occurrences(spark):
    """Each place is judged by itself: copies beside variants, variants beside each other."""
    items = spark.createDataFrame(ASKED, "item_id long, text string")
    own, filler = ASKED[0][1], " ".join(f"word{chr(97 + k % 26)} of a text" for k in range(60))
    rows = [(1, f"{own} {VARIANT}"), (2, f"{VARIANT} {filler} {own}"), (3, f"{VARIANT} {OTHER}"), (4, f"{filler}. {VARIANT} {filler}. {OTHER} {filler}. {own}"),
            (5, f"{SPOILT} {filler}"), (6, own), (7, f"{SPOILT} {SPOILT}")]
    got = {r.doc_id: r for r in decontaminate.matches(docs(spark, rows), items, consistency=0.95).collect()}
    assert set(got) == {1, 2, 3, 4, 6}
    assert all(r.n_matched == r.n_windows and r.coverage == r.consistency == 1 for r in got.values())


def test_decontaminate_short_and_placeholder_items(spark):
    items = spark.createDataFrame([(1, "What is 17 * 24?"), (2, "Here Anna has apples."), (3, "17 24 31 8 99 5 m, 12 kg"), (4, "Name the capital"), (5, "12 34")],
                                  "item_id long, text string")
    filler = " ".join(f"word{chr(97 + k % 26)} of a text" for k in range(30))
    rows = [(1, f"{filler}. What is 17 * 24? {filler}"), (2, f"{filler}. What is 18 * 24? {filler}"), (3, "what is 17 24"), (4, f"{filler}. Here Tom has apples. {filler}"),
            (5, f"{filler} 17 24 31 8 99 5 m, 12 kg {filler}"), (6, f"{filler} 17 24 31 9 98 5 m, 13 kg {filler}"), (7, f"{filler}; name the capital of {filler}"),
            (8, f"{filler} 1 2 3 4 5 6 7 8 {filler}"), (9, "Anna has"), (10, f"{filler} 12 34 {filler}"), (11, None), (12, "")]
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs(spark, rows), items).collect()}
    assert got == {(1, 1), (3, 1), (4, 2), (5, 3), (7, 4), (10, 5)}


def test_planted_passages(spark):
    plain = lambda t: " ".join(re.findall(r"[^\W_]+", (t or "").lower()))
    items = [(r.item_id, plain(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {(r.doc_id, i) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() for i, t in items if f" {t} " in f" {plain(r.text)} "}
    assert {(r.doc_id, r.item_id) for r in QUERIES["op2_template_decontamination"](spark, SF).collect()} == want


def check_packing(rows, texts, capacity):
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    left = collections.Counter(texts.values())
    by_doc = collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    for doc, pieces in by_doc.items():
        ids = np.array(model.encode(texts[doc] or "", add_special_tokens=False).ids + [1], dtype="<u4")
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and bytes(p.ids) == ids[at:at + p.length].tobytes()
            at += p.length
        assert at == len(ids)
    fill = collections.defaultdict(int)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill[r.sequence_id]
        fill[r.sequence_id] += r.length
    assert max(fill.values(), default=0) <= capacity and left
    return fill


def test_packing(spark):
    rows = [(i, t) for i, t in awkward() if i is not None and i not in (205,)]
    texts = dict(rows)
    fill = check_packing(packing.pack(docs(spark, rows), public_tokenizers.path("word_bpe_49k.json"), capacity=256).collect(), texts, 256)
    padding = sum(256 - n for n in fill.values() if n & (n - 1))
    assert padding <= 0.05 * sum(fill.values())
    some = docs(spark, [(None, "a"), (1, "a b"), (1, "a b"), (2, None)])
    assert packing.pack(some, public_tokenizers.path("word_bpe_49k.json")).count() >= 4
    assert packing.pack(docs(spark, []), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_word_tokens():
    from tidewheel.llm._bpe import WordTokens
    model = WordTokens(public_tokenizers.path("word_bpe_49k.json"))
    odd = ["a<|endoftext|>b c", "x y z", "é ó́ ́a", "İstanbul ΑΣ Σ", "don't I'LL 12,3 ½ ﬁ 'tis !!'t", "\x1c\x1d ​ a​b", "", "  ",
           "漢字 🙂 × ÷ ÿß ǅ", "x" * 100 + " " + "thé" * 30, "a\tb\r\nc\x0b\x0c d"]
    for text, ids in zip(odd, model.encode(odd), strict=True):
        assert np.frombuffer(ids, model.dtype).tolist() == model.library.encode(text, add_special_tokens=False).ids


def test_cutting_stock():
    lengths, demand = np.array([4, 6, 10]), np.array([40, 30, 20])
    patterns, times = packing.cutting_stock(lengths, demand, 20)
    assert (patterns @ lengths <= 20).all() and np.allclose(times @ patterns, demand)
    assert times.sum() <= 1.01 * (lengths * demand).sum() / 20


def test_toxicity(spark):
    rng = random.Random(4)
    vocabulary = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(200)]
    rows, labels = [], []
    for k in range(600):
        bad = k % 5 == 0
        rows.append((k, " ".join([rng.choice(vocabulary) for _ in range(30)] + ["villain"] * bad)))
        if k < 400:
            labels.append((k, int(k % 7 > 0), int(bad)))
    labels += [(None, 1, 1), (3, None, 0), (9999, 1, None)]
    rows += [(1000, None), (1001, ""), (None, "villain"), (1002, "villain " + " ".join(rng.choice(vocabulary) for _ in range(50000)))]
    truth = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.toxic for r in toxicity.flagged(docs(spark, rows), truth, ["quality", "toxic"], target="toxic").collect()}
    assert all(got[k] == (k % 5 == 0) for k in range(600)) and got[1002] and got[None] and not got[1000] and not got[1001]
    left = toxicity.without_toxic(docs(spark, rows), truth, ["quality", "toxic"], target="toxic")
    assert left.columns == docs(spark, rows).columns and left.count() == len(rows) - 122
    assert toxicity.flagged(docs(spark, rows), truth.limit(0), ["quality", "toxic"], target="toxic").filter("toxic").count() == 0
    assert toxicity.flagged(docs(spark, []), truth, ["quality", "toxic"], target="toxic").count() == 0


def test_licenses(spark):
    rows = [("r/LICENSE", "Released under the MIT License."), ("r/a/b.py", "code"), ("r/a/c.py", "x\nLicensed under the Apache License, Version 2.0.\ny"),
            ("r/a/COPYING", "This work is licensed under the GNU General Public License, version 3."), ("s/d.py", "licensed by nobody in particular, this is"),
            (None, "Released under the MIT License."), ("top", None), ("r/a/d/e.py", "")]
    files = spark.createDataFrame([(k, p, t, "x") for k, (p, t) in enumerate(rows)], "doc_id long, path string, text string, license string")
    got = {r.doc_id: (r.own_license, r.license, r.inherited_from) for r in licenses.scan(files, id_col="doc_id", path=F.col("path")).collect()}
    assert got == {0: ("MIT", "MIT", None), 1: (None, "GPL-3.0", "r/a"), 2: ("Apache-2.0", "Apache-2.0", None), 3: ("GPL-3.0", "GPL-3.0", None),
                   4: (None, None, None), 5: ("MIT", "MIT", None), 6: (None, None, None), 7: (None, "GPL-3.0", "r/a")}


def test_licenses_of_headers_and_files(spark):
    """Notices wrapped in comments, whole license files, ids, titles; unlicensed prose; one, two and three levels up."""
    import textwrap
    texts = dict()
    for name, text in licenses.TEMPLATES:
        texts[name] = max(texts.get(name, ""), text, key=len)
    def comment(t):
        return "\n".join("# " + x for x in textwrap.wrap(t, 70))
    def file(t, title):
        return f"{title}\n\nCopyright (c) 2021 Jane Doe and the Others\nCopyright 2022 Another Company Limited\n\n" + "\n\n".join(textwrap.wrap(t, 200))
    body = "\n\nimport os\n\ndef walk(top):\n    return list(os.walk(top))\n" * 5
    prose = "the work is not subject to any terms and a copy of it was made by another person without software of any kind"
    rows = [("r/LICENSE", file(texts["MIT"], "The MIT License (MIT)"), "MIT"), ("r/x.py", "#!/bin/python\n#\n" + comment(texts["GPL-3.0"]) + body, "GPL-3.0"),
            ("r/a/LICENSE.txt", file(texts["BSD-3-Clause"], "BSD"), "BSD-3-Clause"), ("r/y.c", "// SPDX-License-Identifier: Apache-2.0" + body, "Apache-2.0"),
            ("r/z.c", "/* SPDX-License-Identifier: MIT */" + body, "MIT"), ("r/m.js", "/* " + comment(texts["MPL-2.0"]) + " */" + body, "MPL-2.0"),
            ("g/COPYING", "GNU GENERAL PUBLIC LICENSE\n   Version 2, June 1991\n\n" + prose, "GPL-2.0"), ("r/p.txt", prose, None),
            ("r/unknown.c", "// SPDX-License-Identifier: Nobody" + body, None), ("r/a/b/q.txt", prose, None), ("r/c/d/e/s.txt", prose, None),
            ("r/h.py", comment(texts["Apache-2.0"]) + body, "Apache-2.0"), ("r/c/two.txt", prose, None), ("g/i/j/k/LICENSE", file(texts["ISC"], "ISC"), "ISC")]
    rows += [(f"w/{k}", " ".join(random.Random(k).choices(prose.split(), k=30)) + body, None) for k in range(60)]
    files = spark.createDataFrame([(k, p, t) for k, (p, t, _) in enumerate(rows)], "doc_id long, path string, text string")
    got = {r.path: r for r in licenses.scan(files, id_col="doc_id", path=F.col("path")).collect()}
    assert {p: got[p].own_license for p, _, _ in rows} == {p: w for p, _, w in rows}
    assert (got["r/a/b/q.txt"].license, got["r/a/b/q.txt"].inherited_from) == ("BSD-3-Clause", "r/a")
    assert (got["r/c/d/e/s.txt"].license, got["r/c/d/e/s.txt"].inherited_from) == ("MIT", "r") and got["r/c/two.txt"].inherited_from == "r"
    assert got["w/3"].license is None


def test_licenses_of_long_units(spark):
    """A license over and over in one line is many times as long as any template, and has its cosine."""
    longest = max(len(t.split()) for _, t in licenses.TEMPLATES)
    texts = [" ".join([t] * (5 * longest // len(t.split()) + 1)) for t in ("Released under the MIT License.", licenses._APACHE)]
    files = spark.createDataFrame([(k, f"a/{k}", t) for k, t in enumerate([*texts, " ".join(["code"] * 9 * longest)])], "doc_id long, path string, text string")
    got = {r.doc_id: r.own_license for r in licenses.scan(files, id_col="doc_id", path=F.col("path")).collect()}
    assert got == {0: "MIT", 1: "Apache-2.0", 2: None}


def test_licenses_awkward(spark):
    """Empty tables, repeated ids with different texts, null ids, a text of blank lines only."""
    files = spark.createDataFrame([(1, "a/x", "nothing"), (1, "a/y", "Released under the MIT License."), (None, "a/z", "Released under the MIT License."),
                                   (2, "b/x", "\n" * 5000), (3, "b/y", None)], "doc_id long, path string, text string")
    got = sorted(((r.doc_id or 0, r.path, r.own_license) for r in licenses.scan(files, id_col="doc_id", path=F.col("path")).collect()))
    assert got == [(0, "a/z", None), (1, "a/x", "MIT"), (1, "a/y", "MIT"), (2, "b/x", None), (3, "b/y", None)]
    assert licenses.scan(files.limit(0), id_col="doc_id", path=F.col("path")).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((40, 16))
    rows = [(k, v.tolist()) for k, v in enumerate(base)]
    rows += [(100 + k, (v + 0.05 * rng.standard_normal(16)).tolist()) for k, v in enumerate(base[:20])]
    rows += [(200 + k, base[0].tolist()) for k in range(30)] + [(300 + k, (base[1] + 0.1 * rng.standard_normal(16)).tolist()) for k in range(60)]
    x = np.array([v for _, v in rows])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    ids = np.array([i for i, _ in rows])
    from tidewheel.llm._groups import least_labels
    want = {int(i): (int(n), int(c)) for i, n, c in zip(ids, near.sum(axis=1), least_labels(near, ids), strict=True)}
    bad = [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [None] * 16), (905, base[0][:8].tolist())]
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows + bad + [(None, base[0].tolist())]], "vec_id long, embedding array<double>, label int, rep string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(table).collect()}
    assert {i: got[i] for i in want} == want
    assert all(got[i] == (0, i) for i, _ in bad) and got[None] == (0, None)
    assert embedding_dedup.near_vectors(table.limit(0)).count() == 0


@pytest.mark.parametrize("n_pivots", [450, 4096])
def test_embeddings_recall(spark, monkeypatch, n_pivots):
    """Links just above the threshold among spread vectors, with as many pivots as large tables have."""
    monkeypatch.setattr(embedding_dedup, "PIVOTS", (n_pivots, n_pivots))
    rng = np.random.default_rng(4)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    base = unit(rng.standard_normal((1500, 64)))
    away = rng.standard_normal(base.shape)
    away = unit(away - (away * base).sum(axis=1, keepdims=True) * base)
    c = rng.uniform(0.9001, 0.92, (1500, 1))
    x = np.vstack([base, c * base + np.sqrt(1 - c * c) * away])
    want = (x @ x.T >= 0.9).sum() - len(x)
    table = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    got = embedding_dedup.near_vectors(table).agg(F.sum("n_links")).first()[0]
    print("recall", n_pivots, got / want)
    assert 0.99 * want <= got <= want


def test_context_tree():
    """Counts in closed form equal the estimate's product, and the gamma function its definition."""
    import math
    x = np.array([0.5, 1.0, 3.5, 1000.5])
    assert np.allclose(lm_score._log_gamma(x), [math.lgamma(v) for v in x], atol=1e-10)
    p, n = 1.0, [0, 0]
    for bit in (0, 1, 1, 0, 1):
        p *= (n[bit] + 0.5) / (sum(n) + 1)
        n[bit] += 1
    assert np.isclose(lm_score.kt_log(np.array([2.0]), np.array([3.0]))[0], math.log(p))


def test_lm_score(spark):
    import math
    rows = [(i, t) for i, t in awkward() if i is not None]
    train = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 1
    got = lm_score.score(docs(spark, rows), train, depth=3).collect()
    counts = collections.Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update([*words(t), None])
    total, distinct = sum(counts.values()), len(counts)
    texts = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        w = [*words(texts[r.doc_id]), None]
        base = sum(math.log10((counts[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in w)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(counts[x] > 0 for x in w), total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0

    # The tree's predictions against a plain recursion.
    table = lm_score.word_scores(spark.createDataFrame([(bytearray(b"ab"), 3, 3), (bytearray(b"abc"), 1, 1), (bytearray(b""), 2, 2), (bytearray(b"zz"), 1, 0)],
                                                       "word binary, n long, c long"), depth=2).collect()
    seen = collections.Counter()
    for r in table:
        for _, g in zip(*lm_score.grams(np.frombuffer(bytes(r.word), np.uint8), np.array([0, len(r.word)]), 2), strict=True):
            seen[int(g)] += r.c

    def node(context, depth, k, prefix):
        n = [0, 0]
        for g, c in seen.items():
            if (g >> 8) & ((1 << 8 * depth) - 1) == context and (g & 255) >> (8 - k) == prefix:
                n[(g >> (7 - k)) & 1] += c
        return n

    def weigh(context, depth, k, prefix):
        n = node(context, depth, k, prefix)
        kt = math.exp(lm_score.kt_log(np.array([float(n[0])]), np.array([float(n[1])]))[0])
        if depth == 2:
            return kt, 1.0
        below = 1.0
        for c in {(g >> 8) & ((1 << 8 * (depth + 1)) - 1) for g in seen}:
            if c & ((1 << 8 * depth) - 1) == context:
                below *= weigh(c, depth + 1, k, prefix)[0]
        return 0.5 * kt + 0.5 * below, 0.5 * kt / (0.5 * kt + 0.5 * below)

    for r in table:
        want = 0.0
        for _, g in zip(*lm_score.grams(np.frombuffer(bytes(r.word), np.uint8), np.array([0, len(r.word)]), 2), strict=True):
            g = int(g)
            for k in range(8):
                prefix, bit, p, rest, last = (g & 255) >> (8 - k), (g >> (7 - k)) & 1, 0.0, 1.0, 0.5
                for depth in range(3):
                    context = (g >> 8) & ((1 << 8 * depth) - 1)
                    n = node(context, depth, k, prefix)
                    if depth and not sum(n):
                        break
                    last, own = (n[bit] + 0.5) / (sum(n) + 1), weigh(context, depth, k, prefix)[1]
                    p, rest = p + rest * own * last, rest * (1 - own)
                want += math.log10(p + rest * last)
        assert math.isclose(r.logp, want, rel_tol=1e-9), bytes(r.word)


def test_warc(spark):
    html = [(1, "http://a/\r\nX: y", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (5, "ü v", "é" * 100000), (1, "u", "same"), (None, "n", "same"), (None, "n", "only")]
    pages = spark.createDataFrame([(*r, "x") for r in html], "page_id long, url string, html string, digest string")
    archives = warc.write_archives(pages, warc.archive_folder(pages))
    got = warc.read_archives(archives).collect()
    assert collections.Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got) == collections.Counter(
        [(1, "response", None, 4), (1, "response", None, 4), (2, "revisit", 1, 4), (3, "response", None, 0), (4, "revisit", 3, 0),
         (5, "response", None, 200000), (None, "revisit", 1, 4), (None, "response", None, 4)])
    assert {bytes(r.payload).decode() for r in got if r.record_type == "response"} == {"same", "", "é" * 100000, "only"}
    assert archives.agg(F.sum("records")).first()[0] == 8
    none = warc.write_archives(pages.limit(0), warc.archive_folder(pages))
    assert warc.read_archives(none).count() == 0


def test_warc_dictionary(spark):
    """Headers of responses and revisits are learnt; the sample is bounded although ids are null."""
    pages = spark.range(12000).selectExpr("cast(null as long) AS page_id", "concat('http://host/', id) AS url", "concat('page ', id % 400, ' ', sha1(string(id % 400))) AS html")
    rows = warc.roles(pages.withColumn("page_id", F.expr("cast(substr(url, 13) as long)")), id_col="page_id", payload_col="html", least_bytes=0)
    words = warc.build_dictionary(rows, 12000, "1970-01-01T00:00:00Z")
    assert b"WARC-Payload-Digest: sha1:" in words and b"WARC-Profile: " in words
    unknown = warc.roles(pages, id_col="page_id", payload_col="html", least_bytes=0)
    assert 0 < len(warc.build_dictionary(unknown, 12000, "1970-01-01T00:00:00Z")) <= warc.DICTIONARY


def test_viterbi():
    rng = np.random.default_rng(2)
    for k in (2, 3):
        per = np.array([0, 1, 5, 700, 300, 0])
        scores = rng.standard_normal((per.sum(), k)) * 3
        got = langid.best_paths(scores, per, 4.0)
        at = 0
        for n in per:
            value, back = np.zeros(k), []
            for t in range(n):
                moves = value[:, None] - 4.0 * (1 - np.eye(k))
                back.append(moves.argmax(axis=0))
                value = moves.max(axis=0) + scores[at + t]
            mine = scores[at:at + n][np.arange(n), got[at:at + n]].sum() - 4.0 * (np.diff(got[at:at + n]) != 0).sum()
            assert not n or np.isclose(mine, value.max())
            at += n


def test_langid(spark):
    got = QUERIES["op8_viterbi_langid"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert got.filter("held_out and lang = lang_pred").count() >= 0.97 * got.filter("held_out").count()
    source = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.learn(source)
    texts = {r.lang: r.text for r in source.collect()}
    mixed = texts["en"][:400] + " " + texts["de"][:2000]
    rows = [(1, None), (2, ""), (3, "123 — …"), (4, mixed), (None, texts["en"]), (5, "漢字")]
    out = {r.doc_id: r for r in langid.label(docs(spark, rows), model).collect()}
    assert [out[k].lang_pred for k in (1, 2, 3, 4, None)] == ["und", "und", "und", "de", "en"] and all(0 <= r.score <= 1 for r in out.values())
    assert [s.lang for s in out[4].spans] == ["en", "de"] and out[5].lang_pred in model.languages
    assert langid.label(docs(spark, rows), langid.learn(docs(spark, []))).filter("lang_pred != 'und'").count() == 0


def test_pipeline(spark):
    """Each stage on its own input; all but the last keep the columns of documents."""
    table = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, SF).cache()
        assert out.schema == table.schema, name
        assert 0 < out.count() <= table.count()
        out.unpersist()
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_keys_follow_probes():
    """The keys of many lines at once are those of the written-out probes."""
    from tidewheel.llm._words import RangeHash, mix
    rng = np.random.default_rng(0)
    points = rng.integers(97, 100, 4000).astype(np.uint32)
    start, size = np.array([0, 100, 1000, 2500, 3000]), np.array([15, 16, 41, 97, 300])
    ranges = RangeHash(points)
    line, key = line_dedup._keys(ranges, start, size, 2)
    for k in range(5):
        want = {int(mix(ranges(np.array([start[k] + p]), np.array([start[k] + p + n])) + np.uint64(indexed * 64 + i))[0])
                for indexed in range(max(15, size[k] - 2), size[k] + 1) for i, p, n in line_dedup.probes(int(size[k]), int(indexed), 2)}
        assert {int(x) for x in key[line == k]} == want
