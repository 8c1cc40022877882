"""Phrase and proximity matches of a positional index against a plain version."""

from __future__ import annotations

import random
import re

import pytest

from shopmetrics.llm import positional_index as P

DOCS = "doc_id long, text string, segment long, row int, n_hit string"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(UPPER))


def windows(items, size):
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - size + 1, min(len(w), 1))):
            yield item, tuple(w[i : i + size])


def occurrences(have, window, slop):
    """(start, stop) of the nearest match from each place where one begins."""
    for start in range(len(have)):
        at = start
        if have[start] != window[0]:
            continue
        for term in window[1:]:
            at = next((i for i in range(at + 1, len(have)) if have[i] == term), None)
            if at is None or at - start >= len(window) + slop:
                at = None
                break
        if at is not None:
            yield start, at + 1


def brute(rows, items, size, slop):
    asked = list(windows(items, size))
    for doc, text in rows:
        have = words(text)
        hit, named = set(), set()
        for item, window in asked:
            for start, stop in occurrences(have, window, slop):
                hit.update(range(start, stop))
                named |= {str(item)} if item is not None else set()
        yield doc, len(have), len(hit), tuple(sorted(named)), bool(hit)


def key(row):
    return tuple((v is not None, str(v)) for v in row)


def found(df):
    rows = df.select("doc_id", "n_words", "n_hit", "n_items", "items", "contaminated").collect()
    assert all(r.n_items == len(r["items"]) for r in rows)
    return sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in rows), key=key)


def tables(spark, rows, items):
    docs = spark.createDataFrame([(d, t, 1, 2, "x") for d, t in rows], DOCS).repartition(3)
    return docs, spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, window int")


@pytest.mark.parametrize("size, slop, segment, block", [(10, 0, 1 << 20, 1 << 16), (3, 0, 17, 2), (3, 2, 17, 3), (4, 1, 5, 1 << 16)])
def test_against_brute_force(spark, monkeypatch, size, slop, segment, block):
    monkeypatch.setattr(P, "WINDOW_BLOCK", block)
    rng = random.Random(size + slop)
    vocabulary = [f"w{i}" for i in range(6)] + ["Été", "日本"]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, make(rng.randint(1, 14))) for i in range(12)]
    items += [(None, "w0 w0 w0"), (3, make(12)), (20, ""), (21, None), (22, "..."), (23, "unseen word here " * 4)]
    rows = [(i, make(rng.randint(0, 25))) for i in range(40)]
    rows += [(None if i % 5 == 0 else i % 3, f"{make(6)}, {t}.\n{make(6)}") for i, (_, t) in enumerate(items)]
    rows += [(7, "w1 w1 " * 30)] * 3 + [(50, None), (51, ""), (52, ".,"), (None, make(300)), (53, (items[0][1] + " ") * 9)]
    docs, asked = tables(spark, rows, items)
    index = P.positional_index(docs, reach=size + slop - 1, segment_terms=segment)
    assert found(P.decontaminate(docs, asked, size, slop, index)) == sorted(brute(rows, items, size, slop), key=key)


def test_passage_of_many_documents(spark):
    """One passage in all documents, one word in all windows."""
    passage = " ".join(f"p{i} the" for i in range(30))
    rows = [(i, f"own{i} the the {passage} end{i}") for i in range(500)]
    items = [(i, f"{passage} item{i}") for i in range(50)]
    docs, asked = tables(spark, rows, items)
    assert found(P.decontaminate(docs, asked)) == sorted(
        ((i, 64, 60, tuple(sorted(map(str, range(50)))), True) for i in range(500)), key=key
    )


def test_merged_joins(spark, monkeypatch):
    monkeypatch.setattr(P, "MOST_BROADCAST", 0)
    rows = [(i, " ".join(f"w{(i + j) % 19}" for j in range(30))) for i in range(30)]
    items = [(i, " ".join(f"w{(2 * i + j) % 23}" for j in range(12))) for i in range(20)]
    docs, asked = tables(spark, rows, items)
    assert found(P.decontaminate(docs, asked, 5)) == sorted(brute(rows, items, 5, 0), key=key)


def test_matches(spark):
    docs, asked = tables(spark, [(1, "x A, b c a b d c")], [(9, "a b c")])
    (row,) = P.decontaminate(docs, asked, 3, slop=1).collect()
    assert [(m.start, m.stop) for m in sorted(row.matches)] == [(1, 4), (4, 8)]


def test_empty_tables(spark):
    docs, asked = tables(spark, [(1, "a b")], [(1, "a")])
    none = docs.limit(0)
    assert P.decontaminate(none, asked).collect() == []
    (row,) = P.decontaminate(docs, asked.limit(0)).collect()
    assert (row.n_words, row.n_hit, row.n_items, row.contaminated) == (2, 0, 0, False)
