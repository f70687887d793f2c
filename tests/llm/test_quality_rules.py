import re
from collections import Counter

import pytest

from likenet.llm.quality_rules import host_verdicts, measures, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [None, "", " \n ", "one two", "a b c a b c", "x\ny\nx\n\n \nx", "wörd # $$ <b> 東京 x", "go on " * 8000, "z" * 100_000, "a b c a b c", " ".join(f"w{i}" for i in range(60))]


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + d for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_measures(spark):
    docs = spark.createDataFrame([(i, t, "s", 7) for i, t in enumerate(TEXTS)], "doc_id long, text string, source string, n_words int")
    for r in measures(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(TEXTS[r.doc_id])


@pytest.mark.parametrize("broadcast", [0, 50_000])
def test_hosts(spark, monkeypatch, broadcast):
    monkeypatch.setattr("likenet.llm.quality_rules.BROADCAST_HOSTS", broadcast)
    good, bad = " ".join(f"w{i}" for i in range(60)), "few words"
    rows = [(i, good, "clean") for i in range(200)] + [(200 + i, good if i % 10 == 0 else bad, "spam") for i in range(200)]
    rows += [(400, bad, "tiny"), (401, good, None), (402, bad, None), (None, good, "clean"), (400, bad, "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = quality_rules(docs).collect()
    assert len(got) == len(rows)
    kept = {r.doc_id: r.kept for r in got}
    assert all(kept[i] for i in range(200)) and not any(kept[200 + i] for i in range(200))
    assert kept[401] and not kept[402] and not kept[400] and kept[None]
    assert sum(not r.base_failed and not r.kept for r in got) == 20
    rates = {r.host: r.short_rate for r in host_verdicts(measures(docs)).collect()}
    assert 0 <= rates["clean"] < 0.05 and 0.85 < rates["spam"] <= 0.9 and 0.5 < rates["tiny"] < 1


@pytest.mark.parametrize("text", ["few", " ".join(map(str, range(60)))])
def test_hosts_that_do_not_differ(spark, text):
    docs = spark.createDataFrame([(i, text, f"s{i % 3}") for i in range(9)], "doc_id long, text string, source string")
    assert {r.kept for r in quality_rules(docs).collect()} == {text != "few"}


def test_empty_table(spark):
    assert quality_rules(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a", "s")], "doc_id long, text string, source string")
    plan = quality_rules(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
