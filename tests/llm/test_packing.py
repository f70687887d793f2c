import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from likenet.llm.packing import PIECE_SCHEMA, SumOfSquares, pack

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", None, "The cat sat.", "  É ü\tΣΑΣ naïve é <|endoftext|> don't's 1234", "word " * 9000, "x" * 50_000, "The cat sat.", "a\nb\r\n\x0bc", "UP<|endoftext|>Down <|ENDOFTEXT|> é<|startoftext|>"]


@pytest.fixture
def docs(spark):
    rows = [(i, t, "en", 1) for i, t in enumerate(TEXTS)] + [(None, "no id", None, 2), (0, "", "de", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, length string, sequence_id long")


def test_each_id_lies_in_one_piece(docs):
    tok = Tokenizer.from_file(PATH)
    rows = pack(docs, PATH, with_ids=True).collect()
    for i, text in enumerate(TEXTS):
        want = tok.encode(text or "", add_special_tokens=False).ids + [2]
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        if i == 0:  # given twice
            assert [list(r.ids) for r in mine] == [[2], [2]]
            continue
        assert sum((list(r.ids) for r in mine), []) == want
        assert {r.doc_tokens for r in mine} == {len(want)}
        assert [r.start for r in mine] == list(np.cumsum([0] + [r.length for r in mine])[:-1])
    assert sum(r.doc_id is None for r in rows) == 1
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids)


def test_windows_are_gapless_and_full_or_powers_of_two(docs):
    by = {}
    for r in pack(docs.repartition(3), PATH).collect():
        by.setdefault(r.sequence_id, []).append(r)
    for rows in by.values():
        rows.sort(key=lambda r: r.offset)
        ends = np.cumsum([r.length for r in rows])
        assert [r.offset for r in rows] == [0, *ends[:-1]]
        assert ends[-1] <= 4096 and ends[-1] & (ends[-1] - 1) == 0


def test_empty_table(docs):
    out = pack(docs.limit(0), PATH)
    assert out.collect() == [] and out.columns == [x.split()[0] for x in PIECE_SCHEMA.split(", ")]


def test_special_tokens(spark):
    """Spelled in a text they are themselves; in capitals they are not."""
    docs = spark.createDataFrame([(1, "A <|endoftext|> b"), (2, "A <|ENDOFTEXT|> b")], "doc_id long, text string")
    rows = sorted(pack(docs, PATH, end_id=None, with_ids=True).collect(), key=lambda r: r.start)
    ids = {k: [x for r in rows if r.doc_id == k for x in r.ids] for k in (1, 2)}
    assert 49407 in ids[1] and 49407 not in ids[2] and len(ids[2]) > len(ids[1])


@pytest.mark.parametrize("run_ids", [0, 500, 1 << 24])
def test_rule_against_brute_force(run_ids):
    rng = np.random.default_rng(5)
    cap, sizes = 64, rng.integers(0, 200, 400)
    packer, done = SumOfSquares(cap, 7, run_ids), []
    for doc, n in enumerate(sizes):
        before, held = packer.levels[1:cap].copy(), packer.held
        s = n % cap
        done += packer.place(doc, np.arange(n, dtype="<u4").tobytes())
        if s and held + s <= run_ids:
            tried = []
            for h in [0, *np.flatnonzero(before) + 1]:
                if h + s <= cap:
                    after = np.concatenate([[0], before, [0]])
                    after[h] -= h > 0
                    after[h + s] += 1
                    tried.append((after[1:cap] ** 2).sum())
            assert (packer.levels[1:cap] ** 2).sum() == min(tried)
    done += packer.close()
    for doc, n in enumerate(sizes):
        mine = sorted((p for p in done if p[0] == doc), key=lambda p: p[1])
        assert b"".join(p[2] for p in mine) == np.arange(n, dtype="<u4").tobytes()
    fills = {}
    for p in done:
        fills[p[4]] = fills.get(p[4], 0) + len(p[2]) // 4
    assert all(f & (f - 1) == 0 for f in fills.values())
    if run_ids == 1 << 24:
        assert sum(f < cap for f in fills.values()) <= 6 and packer.moved < 0.1 * sizes.sum()


def test_most_ids_stay_where_the_rule_put_them():
    """Document lengths as in prose, in few and in many partitions."""
    rng = np.random.default_rng(9)
    sizes = np.minimum(rng.lognormal(6, 1.3, 10_000), 30_000).astype(int) + 1
    for partitions in (8, 32):
        moved = 0
        for part in np.array_split(sizes, partitions):
            packer = SumOfSquares(4096, 0)
            for n in part:
                packer.place(0, bytes(4 * n))
            packer.close()
            moved += packer.moved
        assert moved < 0.1 * sizes.sum()
