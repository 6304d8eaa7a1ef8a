"""The corpus operators where a part of the job is easily left out."""

import random

import public_tokenizers as P
import pytest

from wayfern.llm import decontam, lang_id, line_dedup, queries, secret_scan, token_store


def blocks_brute(docs, least=line_dedup.BLOCK_WORDS):
    """Lines of each document in any stretch of ``least`` words that any earlier document holds."""
    out = {}
    for i, (lines, words) in enumerate(docs):
        gone = set()
        for earlier, _ in docs[:i]:
            for x in range(len(earlier)):
                for y in range(len(lines)):
                    k = 0
                    while x + k < len(earlier) and y + k < len(lines) and earlier[x + k] == lines[y + k]:
                        k += 1
                    if sum(words[y : y + k]) >= least:
                        gone.update(range(y, y + k))
        if gone:
            out[i] = sorted(gone)
    return out


def test_line_blocks_of_all_pairs(spark):
    rnd = random.Random(9)
    vocabulary = ["", "one", "two words", "three words here", "a line of five words", "here is another line of seven words", "this line alone has eight words in it", "five other words are here"]
    for n in (3, 8):
        texts = ["\n".join(rnd.choices(vocabulary, k=rnd.randint(0, n))) for _ in range(120)]
        want = blocks_brute([line_dedup.line_hashes(x) for x in texts])
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
        got = {r.d: r.gone for r in line_dedup.deletions(docs).collect()}
        assert want and got == want


def test_line_blocks_behind_other_holders(spark):
    a, b = "the first of two lines", "and the second of them"
    passage = "a passage of eight words that comes twice"
    texts = [a + "\nown", b + "\nanother", f"{a}\n{b}", f"x\n{a}\n{b}", f"{passage}\n-\n{passage}", f"y\n{passage}\nz\n{passage}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.d: r.gone for r in line_dedup.deletions(docs).collect()} == {3: [1, 2], 5: [1, 3]}


def test_line_blocks_of_short_lines_and_unspaced_scripts(spark):
    verse = "\n".join(f"word{i} too" for i in range(30))
    chinese = "这是一个在两份文件中重复出现的段落"
    thai = "ย่อหน้านี้ซ้ำกันในเอกสารสองฉบับ"
    texts = [f"a\n{verse}", f"b\n{verse}\nc", f"d\n{chinese}", f"e\n{chinese}", f"f\n{thai}", f"g\n{thai}", "h\n你好", "i\n你好"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.d: r.gone for r in line_dedup.deletions(docs).collect()} == {1: list(range(1, 31)), 3: [1], 5: [1]}
    assert line_dedup.line_hashes("two words\n日本語 and kana かな\n你好，世界。")[1] == [2, 5, 2]


TRAIN = "If a train travels from Paris at 60 km per hour for 3 hours then how far from Paris will the train be"


def contaminated(spark, items, texts):
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    return {(r.doc_id, r.item_id): (r.span_words, r.changed) for r in decontam.find(docs, bench).collect()}


def test_values_of_other_word_counts(spark):
    texts = [TRAIN.replace("Paris", "New York"), "So. " + TRAIN.replace("60", "one hundred twenty"), TRAIN.replace("Paris", "Rio").replace("60", "ninety five"), "If a train travels then how far will it be"]
    assert contaminated(spark, [TRAIN], texts) == {(d, 0): (23, True) for d in range(3)}
    assert contaminated(spark, [texts[0]], [TRAIN, texts[0]]) == {(0, 0): (25, True), (1, 0): (25, False)}


def frames(spark, items, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")


@pytest.mark.parametrize("n", [8, 9, 20])
def test_a_passage_of_many_questions_is_found(spark, n):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choices("abcdefghijklmnop", k=6))
    passage = " ".join(word() for _ in range(60))
    docs, bench = frames(spark, [f"{passage} " + " ".join(word() for _ in range(12)) for _ in range(n)], [f"before it {passage} and behind", " ".join(word() for _ in range(80))])
    rows = decontam.find_classes(docs, bench).collect()
    assert len(rows) == 8 and {r.doc_id for r in rows} == {0} and {r.shared for r in rows} == {n > 8} and all(r.span_words >= 60 for r in rows)
    assert {(r.doc_id, r.item_id) for r in decontam.find(docs, bench, common=None).collect()} == {(0, k) for k in range(n)}


def test_every_question_of_a_passage_is_compared(spark, tmp_path):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choices("abcdefghijklmnop", k=6))
    passage = " ".join(word() for _ in range(30))
    docs, bench = frames(spark, [f"{passage} " + " ".join(word() for _ in range(12)) for _ in range(20)], [f"before it {passage} and behind"])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {(r.doc_id, r.class_id, r.shared) for r in queries.op5_decontamination(spark, str(tmp_path)).collect()} == {(0, k, True) for k in range(20)}


def test_a_family_of_one_template_is_one_class(spark):
    text = "a farmer has {} red apples in the barn and gives {} of them to the neighbour who lives across the road, how many are left"
    items = [text.format(2 * k + 1, k + 5000) for k in range(150)]
    docs, bench = frames(spark, items, [text.format(k + 200, 9000 + k) for k in range(150)] + [items[7]])
    rows = {r.doc_id: r for r in decontam.find_classes(docs, bench).collect()}
    assert len(rows) == 151 and {(r.class_id, r.n_items) for r in rows.values()} == {(0, 150)}
    assert (rows[150].item_id, rows[150].changed) == (7, False) and rows[0].changed
    assert sorted((r.class_id, r.item_id) for r in decontam.members(bench).collect()) == [(0, k) for k in range(150)]
    assert decontam.find(docs, bench).count() == 151 * 150


def test_copies_of_items_with_few_literals(spark):
    items = ["Compute 12 + 7 - 3 + 44 - 9 + 15 - 8 + 21 - 6 + 30", "Invited: " + " ".join(f"Name{chr(97 + i)} Other{chr(97 + i)}" for i in range(12)).replace("Name", "Na"), "Compute 12 times 7"]
    items.append("The first list has 1 2 3 4 5 6 7 and the second has 8 9 10 11 12 13 14 and nothing else")
    texts = [f"Text before. {x} and behind it" for x in items] + ["Compute 12 + 7 - 3 + 44 - 9 + 15 - 8 + 21 - 6 + 31 and".replace("1", "2"), "Compute 13 times 7"]
    assert contaminated(spark, items, texts) == {(0, 0): (11, False), (1, 1): (25, False), (2, 2): (4, False), (3, 3): (25, False)}


def test_languages_of_many_copies_are_learned(spark, monkeypatch):
    counts = {}

    def fit(words, found, languages, path):
        counts.update(zip(languages, found.sum(0).tolist(), strict=True))

    monkeypatch.setattr(lang_id, "fit", fit)
    copied = [(f"{chr(97 + i)} {lang}", lang) for lang in ("aa", "bb", "cc", "dd") for i in range(10)] * 500
    distinct = [("x" * (1 + i // 26) + chr(97 + i % 26), "ee") for i in range(2000)]
    lang_id.train(spark.createDataFrame(copied + distinct, "text string, lang string"), P.path(queries.PIECES))
    assert counts == {"aa": 20, "bb": 20, "cc": 20, "dd": 20, "ee": lang_id.SAMPLE_DOCS}


def test_word_markers_equal_the_library():
    from tokenizers import Tokenizer

    path = P.path(queries.WORD_BPE)
    fresh, own = Tokenizer.from_file(path), token_store.WordEncoder(path)
    rnd = random.Random(10)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "|>", "<", "a", "Word", "é", "3", "'s", ".", "|", " ", " ", "\n", "\t", "日本"]
    texts = ["a <|endoftext|> b", "a<|endoftext|>b", '"<|endoftext|>".', *("".join(rnd.choices(parts, k=rnd.randint(1, 12))) for _ in range(3000))]
    assert own.encode_batch(texts[:1])[0].tolist() == [320, 49407, 321]
    for text, ids in zip(texts, own.encode_batch(texts), strict=True):
        assert ids.tolist() == fresh.encode(text, add_special_tokens=False).ids


def test_secrets_of_letters_only():
    rule = secret_scan.EntropyRule()
    assert secret_scan.entropy_spans("key qWkRxXpLmNZtWbvBnYcDdHfG end", rule) == [(4, 28, "entropy_alnum")]
    for text in ("abcdefghijklmnopqrstuvwx", "Some-Words_joined/By-dashes-only", "/usr/local/share/Applications/bin", "-" * 40, "ABCDEFGHIJKLMNOPQRSTUV"):
        assert secret_scan.entropy_spans(text, rule) == []
