"""Alignment of two tokenizers against a walk over both lists of tokens, and against the tokenizers library."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tapeline.llm import alignment as al
from tapeline.llm.common import written

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(public_tokenizers.path(al.VOCABULARY))
    found.encode_special_tokens = True
    return found


@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t'<|>endoftx")), max_size=60))
@settings(max_examples=300, deadline=None)
def test_ids_are_those_of_the_tokenizers_library(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = getattr(test_ids_are_those_of_the_tokenizers_library, "_plain", None) or Tokenizer.from_file(public_tokenizers.path(al.VOCABULARY))
    plain.encode_special_tokens = True
    test_ids_are_those_of_the_tokenizers_library._plain = plain
    tokens = al.byte_level(al.VOCABULARY)
    ids = tokens.encode([text])[0].tolist()
    assert ids == plain.encode(f" {text}", add_special_tokens=False).ids
    assert b"".join(tokens.entries[i] for i in ids) == f" {text}".encode()


@given(st.lists(st.tuples(st.sets(st.integers(1, 30)), st.sets(st.integers(1, 30)), st.integers(30, 33)), min_size=1, max_size=5))
@settings(max_examples=200, deadline=None)
def test_cuts_are_all_shared_ends(texts):
    a, b, first, last, base = [], [], [], [], 0
    for x, y, end in texts:
        first.append(len(a))
        a += sorted({base + i for i in x} | {base + end})
        b += sorted({base + i for i in y} | {base + end})
        last.append(len(a))
        base += end
    got = al.shared_ends(np.array(a), np.array(b), np.array(first), np.array(last))
    assert got.tolist() == [x in set(b) for x in a]


def walked(library, texts):
    """Per text (ids of A, ids of B, links with counts, groups) by a walk over both, or None."""
    alphabet, names, pieces = al.byte_alphabet(), {i: t for t, i in library.get_vocab().items()}, al.piece_level(al.PIECES)
    out = []
    for text in texts:
        ids_a, ids_b = (library.encode(f" {text}", add_special_tokens=False).ids, pieces.encode([text])[0]) if text else ([], [])
        raw_a, raw_b = [bytes(alphabet[c] for c in names[i]) for i in ids_a], [pieces.entries[i] for i in ids_b]
        if not text or b"".join(raw_a) != f" {text}".encode() or b"".join(raw_b) != f" {text}".encode():
            out.append(None)
            continue
        links, groups, i, j, a, b, end_a, end_b = Counter(), [], 0, 0, [ids_a[0]], [ids_b[0]], len(raw_a[0]), len(raw_b[0])
        while True:
            links[ids_a[i], ids_b[j]] += 1
            both = end_a == end_b
            if both:
                groups.append(",".join(map(str, a)) + "|" + ",".join(map(str, b)))
                a, b = [], []
                if i + 1 == len(ids_a):
                    break
            if both or end_a < end_b:
                grow_a, grow_b = True, both
            else:
                grow_a, grow_b = False, True
            if grow_a:
                i += 1
                end_a += len(raw_a[i])
                a.append(ids_a[i])
            if grow_b:
                j += 1
                end_b += len(raw_b[j])
                b.append(ids_b[j])
        out.append((ids_a, ids_b, links, groups))
    return out


def expected(library, rows):
    found = walked(library, [text for _, text in rows])
    total = Counter()
    for x in found:
        total.update(x[2] if x else {})
    most = Counter()
    for (_, b), n in total.items():
        most[b] = max(most[b], n)
    out = []
    for (doc_id, _), x in zip(rows, found, strict=True):
        if x is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
        else:
            a, b, links, groups = x
            out.append((doc_id, len(a), len(b), len(groups), sum(links.values()), sum(n for p, n in links.items() if total[p] == most[p[1]]), sum(n * total[p] for p, n in links.items()), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()), key=str)


def test_whole_table_equals_the_walk(spark, library):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    assert got(al.op12_align(spark, FOLDER)) == expected(library, rows)


AWKWARD = [(1, None), (2, ""), (3, " "), (4, " \n\t "), (5, "a b " * 40_000), (6, "same text"), (6, "same text"), (7, "▁ is a space to pieces"), (8, "Ünï çödé 日本語 \0 end 👩‍👩‍👧"), (9, "<|endoftext|> <s> <0x41>"), (None, "no id"), (10, "x" * 3000)]


@pytest.mark.parametrize("most", [al.BROADCAST_PAIRS, 0])
def test_awkward_rows_by_both_joins(spark, library, monkeypatch, most):
    monkeypatch.setattr(al, "BROADCAST_PAIRS", most)
    docs = spark.createDataFrame(AWKWARD, "doc_id long, text string").withColumns({"row": F.lit("x"), "n": F.lit(1), "pair": F.lit(None).cast("int")}).repartition(2)
    aligned = al.alignments(docs).withColumn("groups_sha256", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(""))
    assert got(al.scored(written(aligned))) == expected(library, AWKWARD)


def test_empty_table(spark):
    empty = al.alignments(spark.createDataFrame([], "doc_id long, text string")).withColumn("groups_sha256", F.lit(""))
    assert al.scored(written(empty)).count() == 0
