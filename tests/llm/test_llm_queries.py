"""Registered training-data queries against their SQL on the smallest tables."""

import itertools
import unicodedata

import compare
import pytest

from basewise.llm import bpe, leaks, lookalike
from basewise.llm.queries import QUERIES
from basewise.llm.sql import SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    ok, message = compare.same(QUERIES[name](spark, FOLDER), SQL[name], con)
    assert ok, message


def texts(con):
    return con.execute("SELECT doc_id, text FROM documents").fetchall()


def test_ids_of_all_documents(spark, con):
    """Ids decode to the text, and null and empty texts have none."""
    vocab = bpe.vocabulary(f"{bpe.FOLDER}/byte_bpe_50k.json")
    got = {r["doc_id"]: r["ids"] for r in QUERIES["p6_ids"](spark, FOLDER).collect()}
    want = dict(texts(con))
    assert got.keys() == want.keys()
    assert all(vocab.decode(ids) == want[i] if want[i] else ids == [] for i, ids in got.items())


def test_looks_of_all_documents(spark, con):
    docs = texts(con)
    look = {i: None if t is None else unicodedata.normalize("NFC", unicodedata.normalize("NFD", t).translate(lookalike._TABLE)) for i, t in docs}
    assert {r["doc_id"]: r["canonical"] for r in QUERIES["p8_texts"](spark, FOLDER).collect()} == look
    by = {}
    for i, t in docs:
        if t:
            by.setdefault(look[i], []).append((i, t))
    want = {(min(a, b), max(a, b)) for m in by.values() for (a, x), (b, y) in itertools.combinations(m, 2) if x != y}
    assert {tuple(r) for r in QUERIES["p8_found"](spark, FOLDER).collect()} == want and want


def test_leaks_of_all_documents(spark, con):
    """Runs of ten words and more in all documents against all items, and passages within one edit where they have none."""
    docs = [(i, leaks.words_of(t)) for i, t in texts(con)]
    items = [(i, leaks.words_of(t)) for i, t in con.execute("SELECT item_id, text FROM eval_items").fetchall()]
    at = {}
    for i, w in items:
        for k in range(len(w) - 9):
            at.setdefault(tuple(w[k : k + 10]), []).append((i, k))
    joined = {i: " " + " ".join(w) + " " for i, w in items}
    want, exact = set(), set()
    for d, w in docs:
        for k in range(len(w) - 9):
            for i, p in at.get(tuple(w[k : k + 10]), []):
                exact.add((d, i, p, k))
                iw, n = dict(items)[i], 10
                while p + n < len(iw) and k + n < len(w) and iw[p + n] == w[k + n]:
                    n += 1
                run = " " + " ".join(iw[p : p + n]) + " "
                if not any(run in t for j, t in joined.items() if j != i):
                    want.add((d, i))
    assert {tuple(r) for r in QUERIES["p7_found"](spark, FOLDER).collect()} == want and want
    rows = QUERIES["p7_passages"](spark, FOLDER).collect()
    got = {(r["doc_id"], r["item_id"], r["item_at"] + k, r["doc_at"] + k) for r in rows if r["edits"] == 0 for k in range(r["n_words"] - 9)}
    assert got == exact
