"""Filter audit, quality scores and alignment against plain versions."""

import collections
import hashlib
import itertools

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewheel.llm import align, filter_audit, quality

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# -- filter audit ------------------------------------------------------------

def plain_audit(rows, filters, tallies):
    """rows: (part, {filter: fails}, {tally: holds})."""
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        removed = collections.Counter()
        for order in itertools.permutations(filters):
            for step, f in enumerate(order, 1):
                gone_before = [any(r[1][g] for g in order[:step - 1]) for r in mine]
                here = [r[1][f] and not g for r, g in zip(mine, gone_before)]
                removed[f] += sum(here)
                out[part, "".join(order), step] = [
                    sum(not g and not h for g, h in zip(gone_before, here)), sum(here), sum(r[1][f] and g for r, g in zip(mine, gone_before)),
                    sum(r[1][f] and sum(r[1].values()) == 1 for r in mine), *[sum(h and r[2][t] for r, h in zip(mine, here)) for t in tallies], f]
        for key in [k for k in out if k[0] == part]:
            out[key][-1] = removed[out[key][-1]]
    return {k: tuple(v) for k, v in out.items()}


def test_audit_matches_plain_counts(spark):
    rng = np.random.default_rng(3)
    rows = [(str(rng.choice(["", "x", "yy"])), {f: bool(rng.random() < 0.4) for f in "PQR"}, {"t": bool(rng.random() < 0.5)}) for _ in range(300)]
    df = spark.createDataFrame([(p or None, *f.values(), t["t"]) for p, f, t in rows], "part string, P boolean, Q boolean, R boolean, t boolean")
    got = filter_audit.audit(df.repartition(5), list("PQR"), ["t"], F.col("part")).collect()
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in got} == plain_audit(rows, "PQR", ["t"])
    assert len(got) == 3 * 6 * 3


def test_audit_of_nothing_and_nulls(spark):
    empty = spark.createDataFrame([], "part string, A boolean, id long")
    assert filter_audit.audit(empty, ["A"], [], F.col("part")).count() == 0
    one = spark.createDataFrame([(None, None), (None, True)], "part string, A boolean")
    assert [tuple(r) for r in filter_audit.audit(one, ["A"], [], F.col("part")).collect()] == [("", "A", 1, 1, 1, 0, 1, 1)]


def test_fields_do_not_overflow():
    packed = filter_audit.packed_masks(5, 2)
    big = (1 << 62) // 128
    counts = filter_audit.unpack(sum(p * big for p in packed), 5, 2)
    _, fields = filter_audit.outcome_fields(5, 2)
    assert fields.shape == (128, 6, 120, 5)
    assert (counts == fields.sum(axis=0, dtype=np.int64) * big).all()


def test_document_masks(spark):
    words = " ".join(f"w{k}" for k in range(200))
    docs = spark.createDataFrame([
        (1, None, "en", 0), (2, "", None, 0), (3, words, "en", 0), (3, words, "en", 0), (4, words, "de", 0), (None, words, "de", 0), (5, words + " $", "en", 0),
        (6, "w " * 200, "en", 0), (7, words + " ABCDEFGHIJKLMNOPQRSTUVWXYZABCDEFG", "en", 0), (8, words + " Q", "en", 0)],
        "doc_id long, text string, lang string, digest int")
    labels = spark.createDataFrame([(3, 1, None), (3, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    tallies = {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1}
    got = filter_audit.document_masks(docs, labels, tallies).collect()
    flags = lambda r: "".join(f for f in "ABCDE" if r[f]) + ("+" if r["good"] else "") + ("!" if r["toxic"] else "")
    assert sorted((r["doc_id"] or 0, flags(r)) for r in got) == [
        (0, ""), (1, "A"), (2, "AE"), (3, "+!"), (3, "+!"), (4, "E"), (5, "D"), (6, "B"), (7, "C"), (8, "")]


# -- quality -----------------------------------------------------------------

def test_statistics_of_odd_texts():
    texts = [None, "", " ", "a", "a a a b", "A1!|\n\nA1!|", "é" * 1000, "x" * 300_000]
    x = quality.statistics(pa.array(texts, pa.string()))
    at = quality.STATISTICS.index
    assert np.isfinite(x).all() and (x[:2] == 0).all()
    assert x[4, at("distinct")] == 0.5 and x[4, at("top")] == 0.75 and x[4, at("echo")] == 0.5
    assert x[5, at("same_lines")] == pytest.approx(1 - 2 / 3) and x[5, at("capitals")] == 0.2 and x[5, at("bars")] == 0.2
    assert x[6, at("wide")] == 1.0 and x[7, at("longest")] == pytest.approx(np.log1p(300_000))
    assert np.allclose(quality.statistics(pa.array(texts[3:5], pa.string())), x[3:5])


def test_isotonic_is_the_least_squares_fit():
    at, level = quality.isotonic(np.arange(5.0), np.array([10, 10, 10, 10, 10]), np.array([1, 5, 3, 9, 8]))
    assert np.allclose(at, [0, 1.5, 3.5]) and np.allclose(level, [1.5 / 11, 8.5 / 21, 17.5 / 21])
    assert all(len(v) == 0 for v in quality.isotonic(np.zeros(0), np.zeros(0), np.zeros(0)))


def test_quality_learns_a_kernel(spark):
    rng = np.random.default_rng(8)
    junk = lambda: " ".join(rng.choice(["AB$$", "C|D", "!!X"]) for _ in range(rng.integers(5, 60)))
    good = lambda: ". ".join(" ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(8)) for _ in range(rng.integers(1, 8)))
    rows = [(k, junk() if k % 3 == 0 else good(), 5.0) for k in range(600)]
    docs = spark.createDataFrame([*rows, (None, "x", 1.0), (7000, None, 1.0), (7001, "", 1.0), (7001, "", 1.0)], "doc_id long, text string, x double")
    labels = spark.createDataFrame([(k, int(k % 3 != 0)) for k in range(300)] + [(2, 1), (None, 1), (3, None)], "doc_id long, quality int")
    table = quality.with_statistics(docs)
    scored = {r["doc_id"]: r for r in quality.score(table, quality.learn(table, labels, F.col("quality"))).collect()}
    assert len(scored) == 603 and quality.score(table, quality.learn(table, labels, F.col("quality"))).count() == 604
    assert np.mean([scored[k]["predicted"] == int(k % 3 != 0) for k in range(300, 600)]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in scored.values())


def test_quality_without_labels(spark):
    table = quality.with_statistics(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))
    nothing = spark.createDataFrame([], "doc_id long, quality int")
    assert [tuple(r) for r in quality.score(table, quality.learn(table, nothing, F.col("quality"))).collect()] == [(1, 0.5, 1)]
    one_class = quality.learn(table, spark.createDataFrame([(1, 0)], "doc_id long, quality int"), F.col("quality"))
    assert quality.score(table, one_class).first()["score"] < 0.5


# -- alignment ---------------------------------------------------------------

def plain_alignment(texts):
    """Per text: n_a, n_b, n_overlaps, n_groups, n_links, n_best, count_sum, digest."""
    a_lib, b_lib = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    a_lib.encode_special_tokens = True
    letters = {chr(b): b for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    spare = [b for b in range(256) if b not in letters.values()]
    letters |= {chr(256 + k): b for k, b in enumerate(spare)}
    links, groups, counts = [], [], collections.Counter()
    for t in texts:
        found, cut, whole = [], [], b" " + (t or "").encode()
        a = a_lib.encode(" " + t, add_special_tokens=False).ids if t else []
        b = b_lib.encode(t) if t else []
        ab = [bytes(letters[c] for c in a_lib.id_to_token(k)) for k in a]
        bb = [bytes([int(b_lib.id_to_piece(k)[3:5], 16)]) if b_lib.is_byte(k) else b_lib.id_to_piece(k).replace("▁", " ").encode() for k in b]
        if b"".join(ab) != whole or b"".join(bb) != whole:
            a, b, ab, bb = [], [], [], []
        ea, eb = np.cumsum([len(x) for x in ab]).tolist(), np.cumsum([len(x) for x in bb]).tolist()
        start = (0, 0)
        for i, e in enumerate(ea):
            if e in eb:
                j = eb.index(e)
                found.append((a[i], b[j]))
                cut.append(f"{','.join(map(str, a[start[0]:i + 1]))}|{','.join(map(str, b[start[1]:j + 1]))}")
                start = (i + 1, j + 1)
        counts.update(found)
        links.append((len(a), len(b), len(set(ea) | set(eb)), found))
        groups.append(hashlib.sha256(";".join(cut).encode()).hexdigest() if a else "")
    most = collections.Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return [(n_a, n_b, n_o, len(f), len(f), sum(counts[p] == most[p[1]] for p in f), sum(counts[p] for p in f), g)
            for (n_a, n_b, n_o, f), g in zip(links, groups)], counts


TEXTS = [None, "", " ", "a", "Hello, world! <|endoftext|> </s>", "▁odd", "naïve café 東京 \U0001f600\U0001f600", "tabs\t\tand\n\nlines  ", "same text here", "same text here",
         "zzqxj " * 300, "the the the", "\x00\x01 control", "don't we'll 1234567890 ++--"]


@pytest.mark.parametrize(("size", "hot"), [(16_384, 1_000_000), (7, 20), (2, 0), (1, 5)])
def test_alignment_matches_the_plain_one(spark, size, hot):
    rng = np.random.default_rng(size)
    texts = TEXTS + ["".join(rng.choice(list("aeiou thnr.,é\n"), 200)) for _ in range(20)]
    docs = spark.createDataFrame([(None if k == 3 else k // 2, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, row int")
    got = align.aligned(docs.repartition(3), A_PATH, B_PATH, size=size, hot_pairs=hot)
    want, _ = plain_alignment(texts)
    key = lambda r: tuple(str(v) for v in r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(((None if k == 3 else k // 2, *w) for k, w in enumerate(want)), key=key)


def test_overlaps_and_counts(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")
    _, counts = plain_alignment(TEXTS)
    rows = {}
    for size in (16_384, 3):
        parts = align.pieces(docs, A_PATH, B_PATH, size=size)
        rows[size] = sorted(tuple(r)[1:] for r in align.overlaps(parts, A_PATH, B_PATH).collect())
        assert {(r["a_id"], r["b_id"]): r["n"] for r in align.pair_counts(parts, A_PATH, B_PATH).collect()} == counts
    assert rows[3] == rows[16_384]
    assert collections.Counter((a, b) for _, a, b, _, linked in rows[3] if linked) == counts


def test_pieces_are_of_equal_work(spark):
    docs = spark.createDataFrame([(1, "some words of a long text, " * 4000)], "doc_id long, text string")
    parts = align.pieces(docs, A_PATH, B_PATH, size=1000).orderBy("piece").collect()
    work = [(len(p["a"]) + len(p["b"])) // 2 for p in parts]
    assert len(parts) > 30 and max(work) <= 1001 and min(work[:-1]) >= 999


def test_diagonals_against_a_plain_merge():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (np.sort(rng.choice(60, rng.integers(0, 30), replace=False)) for _ in range(2))
        merged = sorted([(x, 0) for x in a.tolist()] + [(x, 1) for x in b.tolist()])
        at = np.arange(len(merged) + 1)
        assert align.diagonals(a, b, at).tolist() == [sum(s == 0 for _, s in merged[:d]) for d in at]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert align.aligned(docs, A_PATH, B_PATH).count() == 0
