import hashlib

import pytest

from likenet.llm.exact_dedup import exact_dedup, fingerprint, tree_merge

ROWS = [(1, "Abc"), (2, "aBC"), (3, "abc "), (4, None), (5, ""), (6, "Ä"), (7, "ä"), (8, "x" * 300_000), (9, "X" * 300_000), (9, "X" * 300_000), (None, "abc"), (None, "lone")]


def brute(rows, best):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").encode().lower(), []).append(i)
    out = []
    for i, t in rows:
        key = (t or "").encode().lower()
        ids = [x for x in groups[key] if x is not None]
        keep = best(ids) if ids else None
        out.append((i, keep, len(groups[key]), i == keep, hashlib.sha256(key).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("keep", "best"), [("max", max), ("min", min)])
def test_against_brute_force(spark, keep, best):
    rows = ROWS + [(100 + i, f"t{i % 7}") for i in range(200)]
    docs = spark.createDataFrame([(*r, "k", 5) for r in rows], "doc_id long, text string, digest string, keep_id int").repartition(7)
    got = exact_dedup(docs, keep=keep, fan_in=2).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.digest).hex()) for r in got), key=str) == brute(rows, best)


def test_hot_group_and_ranges(spark):
    rows = [(i, "hot" if i % 2 else f"t{i}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup(docs).collect()}
    assert len(got) == 6000 and got[1] == (5999, 3000) and got[2] == (2, 1)


def test_empty_table(spark):
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_two_lengths_under_one_digest_are_an_error(spark):
    prints = fingerprint(spark.createDataFrame([(1, "a")], "doc_id long, text string")).selectExpr("*", "0 as run")
    forged = prints.unionByName(prints.selectExpr("doc_id", "digest", "n_bytes + 1 as n_bytes", "1 as run"))
    with pytest.raises(Exception, match="two text lengths"):
        tree_merge(forged, 2).collect()
