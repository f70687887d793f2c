import random

import public_tokenizers

from likenet.llm.merge_replay import read_ranks
from likenet.llm.word_pieces import LongestMatch, pieces_of_ranks, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCRIPTS = {
    "latin": "straße naïve Zürich", "greek": "Ελλάδα λόγος", "cyrillic": "Привет мир", "hebrew": "שלום עולם", "arabic": "مرحبا بالعالم", "devanagari": "नमस्ते दुनिया",
    "bengali": "বাংলা লেখা", "thai": "สวัสดีชาวโลก", "georgian": "საქართველო", "han": "中文文本 漢字", "kana": "ひらがな カタカナ", "hangul": "안녕하세요 텍스트",
    "armenian": "Հայերեն", "emoji": "🎉🏽 👩‍💻", "control": "\x01x \x7f",
}


def greedy(word, initial, following):
    """The number of pieces by longest match first; -1 if there is none."""
    at, n, pieces = 0, 0, initial
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return -1
        at, n, pieces = end, n + 1, following
    return n


def by_vocabulary(word, vocabulary):
    """Straight from the vocabulary: the longest piece after a blank if any begins the word, else the longest without; then longest ones."""
    begin = next((e for e in range(len(word), 0, -1) if b" " + word[:e] in vocabulary), None)
    at = begin or next(e for e in range(len(word), 0, -1) if word[:e] in vocabulary)
    n = 1
    while at < len(word):
        at, n = next(e for e in range(len(word), at, -1) if word[at:e] in vocabulary), n + 1
    return n


def test_against_greedy():
    rng = random.Random(2)
    make = lambda most, n: {"".join(rng.choices("abc", k=rng.randint(1, most))).encode() for _ in range(rng.randint(0, n))}
    for _ in range(400):
        initial, following = make(5, 12), make(5, 12)
        match = LongestMatch(sorted(initial), sorted(following))
        for w in make(14, 6):
            assert match.count(w) == greedy(w, initial, following)


def test_every_script(spark):
    vocabulary = read_ranks(PATH)
    docs = spark.createDataFrame(list(SCRIPTS.items()), "doc_id string, text string").selectExpr("row_number() over (order by doc_id) as doc_id", "text")
    for r in docs.join(token_counts(docs, PATH), "doc_id").collect():
        words = r.text.encode().split()
        assert (r.n_words, r.n_unknown) == (len(words), 0)
        assert r.n_tokens == sum(by_vocabulary(w, vocabulary) for w in words)


def test_query(spark):
    texts = [None, "", " \n\t ", "The undeniable idiosyncrasies", "naïve 本 \x01x", "q" * 40_000, "本" * 20_000, "a b\x0bc\x1cd", "a b\x0bc\x1cd"]
    docs = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)] + [(None, "hi", 1)], "doc_id long, text string, n_words int")
    initial, following = map(set, pieces_of_ranks(PATH))
    rows = token_counts(docs, PATH).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        words = ("hi" if r.doc_id is None else texts[r.doc_id] or "").encode().split()
        if r.doc_id in (5, 6):
            assert r.n_words == 1 and r.n_unknown == 0 and r.n_tokens > 1000
            continue
        assert (r.n_words, r.n_tokens, r.n_unknown) == (len(words), sum(greedy(w, initial, following) for w in words), 0)
    assert token_counts(docs.limit(0), PATH).collect() == []
