"""Each stage, and all of them, against brute force on a small fixture."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline

from . import test_near_dedup, test_quality_rules

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def fixture():
    rng, rows = random.Random(11), []
    words = [f"word{i}" for i in range(900)]
    passage = " ".join(rng.choice(words) for _ in range(70))
    for i in range(60):
        text = [rng.choice(words) for _ in range(rng.randint(70, 140))]
        if i % 7 == 3:
            text[20:20] = passage.split()
        rows.append([i, " ".join(text), "en", f"s{i % 3}"])
    rows += [[100 + i, rows[i][1].upper(), "en", "s1"] for i in range(5)]
    for i in range(5):
        text = rows[10 + i][1].split()
        text[5] = "changed"
        rows.append([200 + i, " ".join(text), "en", "s2"])
    rows += [[300, None, "en", "s0"], [301, "", None, None], [302, "few words", "de", "s1"], [303, "again and " * 60, "fr", None], [None, rows[0][1] + " null", "en", None]]
    rows += [[400 + i, rows[20][1] if i % 9 == 0 else "bad", "en", "spam"] for i in range(40)]
    return [(*r, len(r[1] or "")) for r in rows]


def rejected_hosts(rows):
    """By the rule of the operator: rates shrunk by a beta prior that has the hosts' mean and variance."""
    hosts = defaultdict(list)
    for _, text, _, source, _ in rows:
        if source is not None:
            n, chars, symbols, lines, repeats = test_quality_rules.brute(text)
            hosts[source].append((n < 50, 100 * repeats > 50 * n, 10 * symbols > chars, 10 * lines > n))
    out = set()
    for k in range(4):
        rates = {h: (sum(x[k] for x in v), len(v)) for h, v in hosts.items()}
        r = np.array([a / n for a, n in rates.values()])
        m, v = r.mean(), r.var()
        s = m * (1 - m) / v - 1 if v > 1e-12 else None
        for h, (a, n) in rates.items():
            rate = m if s is None else a / n if s <= 0 else (a + m * s) / (n + s)
            if rate > 0.5:
                out.add(h)
    return out


def quality(rows):
    bad, out = rejected_hosts(rows), []
    for r in rows:
        n, _, _, _, repeats = test_quality_rules.brute(r[1])
        if n >= 50 and 100 * repeats <= 50 * n and r[3] not in bad:
            out.append(r)
    return out


def exact(rows):
    best = {}
    for r in rows:
        key = (r[1] or "").encode().lower()
        if r[0] is not None:
            best[key] = max(r[0], best.get(key, r[0]))
    return [r for r in rows if r[0] == best.get((r[1] or "").encode().lower())]


def near(rows):
    kept = {i for i, _, component in test_near_dedup.brute([r[:2] for r in rows], 5) if i == component}
    return [r for r in rows if r[0] in kept]


def suffix(rows):
    seen, out = set(), []
    for r in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        data = (r[1] or "").encode()
        hit = bytearray(len(data))
        for p in range(len(data) - 199):
            w = data[p : p + 200]
            if w in seen:
                hit[p : p + 200] = b"\1" * 200
            seen.add(w)
        text = bytes(b for b, h in zip(data, hit) if not h).decode("utf-8", "ignore")
        out.append((r[0], text, *r[2:4], len(text)))
    return out


BRUTE = [quality, exact, near, suffix]


def same(frame, rows):
    assert frame.columns == [c.split()[0] for c in COLUMNS.split(", ")]
    assert sorted((tuple(r) for r in frame.collect()), key=str) == sorted(rows, key=str)


def test_every_stage(spark):
    rows = fixture()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "near dedup", "suffix dedup", "packing"]
    for (_, stage), brute in zip(corpus_pipeline.STAGES, BRUTE):
        got = stage(spark, spark.createDataFrame(rows, COLUMNS).repartition(3), "")
        want = brute(rows)
        assert 0 < len(want) <= len(rows)
        same(got, want)
        assert brute is suffix or len(want) < len(rows)
        rows = want
    assert sum(r[4] for r in rows) < sum(r[4] for r in near(exact(quality(fixture()))))


def test_run(spark, tmp_path):
    rows = fixture()
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    for brute in BRUTE:
        rows = brute(rows)
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {r[0]: tok.encode(r[1], add_special_tokens=False).ids + [2] for r in rows}
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == set(want)
    for p in pieces:
        ids = np.array(want[p.doc_id][p.start : p.start + p.length], "<u4")
        assert p.ids_crc32 == zlib.crc32(ids.tobytes()) and p.doc_tokens == len(want[p.doc_id])
    assert sum(p.length for p in pieces) == sum(map(len, want.values()))


def test_further_columns_with_clashing_names(spark):
    rows = fixture()
    extra = "dropped_id long, kept string, row int, body string, doc int, label string, kept_text string, host string, words int, digest string, body_ string"
    more = (7, "no", 3, "b", 1, "l", "kt", "h", 9, "d", "e")
    docs = spark.createDataFrame([(*r, *more) for r in rows], f"{COLUMNS}, {extra}").repartition(3)
    for (_, stage), brute in zip(corpus_pipeline.STAGES, BRUTE):
        got, rows = stage(spark, docs, ""), brute(rows)
        assert got.columns == docs.columns
        assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(((*r, *more) for r in rows), key=str)
        docs = spark.createDataFrame([(*r, *more) for r in rows], f"{COLUMNS}, {extra}")
    assert corpus_pipeline.packing_stage(spark, docs, "").count() >= len(rows)


def test_dropped_rows_beyond_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "BROADCAST_DROPPED", 0)
    same(corpus_pipeline.exact_stage(spark, spark.createDataFrame(fixture(), COLUMNS), ""), exact(fixture()))


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None)]])
def test_tables_that_leave_nothing(spark, rows):
    docs = spark.createDataFrame(rows, COLUMNS)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").collect() == []


def test_workers_give_memory_back():
    """What a partition took isn't kept by a worker that waits for the next stage."""
    import subprocess
    import sys

    code = """
import pyarrow as pa
from likenet.llm.common import trimmed

def held():
    return int(open("/proc/self/statm").read().split()[1]) * 4096 >> 20

def run(batches):
    for b in batches:
        kept = [bytes(4000) for _ in range(50_000)]
        pin = bytes(5000)  # lies above what is freed
        pins.append(pin)
        del kept
        yield b

pins = []
batch = pa.RecordBatch.from_arrays([pa.array([1])], ["x"])
before = held()
assert list(trimmed(run)([batch])) == [batch]
assert held() < before + 60, (before, held())
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=60)
    assert done.returncode == 0, done.stderr
    assert subprocess.run([sys.executable, "-c", code.replace("trimmed(run)", "run")], capture_output=True, timeout=60).returncode != 0


def test_other_operators_words_are_forgotten():
    from likenet.llm import packing
    from likenet.llm.common import trimmed

    packing._TOKENIZERS["a path"] = "words"
    assert list(trimmed(iter, "packing")([])) == [] and "a path" in packing._TOKENIZERS
    assert list(trimmed(iter)([])) == [] and not packing._TOKENIZERS
