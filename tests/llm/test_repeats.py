"""Rows that repeat, texts of very many lines and tables without languages: what must not cost the square of its number."""

import time

from pyspark.sql import functions as F

from pixelloom.llm import jaccard_join, line_dedup

LINE = "This line of more than forty code points recurs in many documents"


def test_jaccard_join_of_one_id_repeated(spark):
    base = " ".join(f"w{i}" for i in range(60))
    near = " ".join(f"w{i}" for i in range(61))
    rows = [(7, base)] * 5000 + [(None, base)] * 2000 + [(8, near), (9, "other words that stand alone here"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    jaccard_join.classes(docs.limit(50)).count()
    began = time.time()
    got = jaccard_join.classes(docs).groupBy("doc_id", "n_shingles", "component_id").count().collect()
    assert time.time() - began < 150
    assert {tuple(r) for r in got} == {(7, 56, 7, 5000), (None, 56, 7, 2000), (8, 57, 7, 1), (9, 2, 9, 1), (None, 0, None, 1)}


def test_line_dedup_of_a_text_of_very_many_common_lines(spark):
    text = "\n".join(f"{LINE} number {i}" for i in range(100_000))
    docs = spark.createDataFrame([(i, text + f"\nown {i}") for i in range(6)], "doc_id long, text string").repartition(3)
    line_dedup.dedup_lines(docs.limit(1)).count()
    began = time.time()
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs).select("doc_id", "dedup_n_lines", "dedup_n_dropped", F.md5("dedup_text").alias("h"), F.substring("dedup_text", 1, 6).alias("t")).collect()}
    assert time.time() - began < 150
    assert all((got[i].dedup_n_lines, got[i].dedup_n_dropped, got[i].t) == (100_001, 100_000, f"own {i}") for i in range(5)) and got[5].dedup_n_dropped == 0


def test_line_dedup_tells_rows_of_null_ids_apart(spark):
    rows = [(None, f"{LINE}\nmine {i}\n{LINE}") for i in range(2000)] + [(i, LINE) for i in range(5)] + [(4, f"x\n{LINE}\ny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = line_dedup.dedup_lines(docs).collect()
    assert sorted(r.dedup_text for r in got if r.doc_id is None) == sorted(f"mine {i}" for i in range(2000))
    assert sorted(r.dedup_text for r in got if r.doc_id is not None) == sorted(["", "", "", "", LINE, f"x\n{LINE}\ny"])
    placed = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs.filter("doc_id < 4 or doc_id is null").limit(2004), min_docs=2, in_place=True).filter("doc_id is not null").collect()}
    assert placed == {0: "", 1: "", 2: "", 3: LINE}


def test_pipeline_without_any_language(spark):
    import corpus_pipeline as C

    docs = spark.createDataFrame([(i, f"text {i}", None, "s") for i in range(20)], "doc_id long, text string, lang string, source string")
    assert {r.doc_id for r in C.keep_languages(spark, docs, "").collect()} == set(range(20))


def test_lines_are_counted_by_document(spark):
    from pixelloom.llm import quality_rules

    own = lambda i: " ".join(f"w{i}x{j}" for j in range(60))
    often = "a line that many documents of the host hold " * 9
    rows = [(1, "h", f"{own(1)}\n{often}")] * 9 + [(i, "h", f"{own(i)}\n{often}") for i in range(2, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert {r.n_lost for r in quality_rules.judge(docs).collect()} == {0}  # thirteen rows, five documents
    more = docs.unionAll(spark.createDataFrame([(6, "h", f"{own(6)}\n{often}")], docs.schema))
    assert {(r.doc_id, r.n_lost) for r in quality_rules.judge(more).collect()} == {(1, 0), *((i, 81) for i in range(2, 7))}


def test_most_frequent_languages_are_learned(spark):
    from pixelloom.llm import language_id

    rows = [(i, f"text {i} {'abc' * (i % 9)}", f"l{i % 40}") for i in range(400)] + [(1000 + i, f"other words {i}", "z") for i in range(50)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most=3)
    assert sorted(model.languages) == ["l0", "l1", "z"]


def test_list_is_read_from_its_file(tmp_path):
    from pixelloom.llm import url_filter

    (tmp_path / "list.txt").write_text("# sites\n\nHTTP://Spam.Example.COM\nx.org/a?b#c\n")
    assert url_filter.read_list(tmp_path / "list.txt") == ["spam.example.com/", "x.org/a"]
    assert all(key in url_filter.OP4_SQL for key in (k.partition("/")[0] for k in url_filter.read_list()))


def test_statistics_of_a_text_by_hand():
    import math

    from pixelloom.llm import quality_model

    text = b"The cat sat.\nThe cat sat.\n- a Dog, 12 \xc3\xa9\n\nsupercalifragilistic #1 !"
    got = dict(zip(quality_model.FEATURES, quality_model.statistics(text)))
    words = text.split()
    counts = {w: words.count(w) for w in words}
    triples = list(zip(words, words[1:], words[2:]))
    letters = sum(chr(b).isalpha() and b < 128 or b >= 128 for b in text)
    lines = ["The cat sat.", "The cat sat.", "- a Dog, 12 \xc3\xa9", "supercalifragilistic #1 !"]
    entropy = lambda c: -sum(n / sum(c) * math.log2(n / sum(c)) for n in c)
    want = {
        "log_words": math.log1p(len(words)), "mean_word": sum(map(len, words)) / len(words), "long_word_share": 1 / len(words), "distinct_share": len(counts) / len(words),
        "top_word_share": 2 / len(words), "repeat_share": sum(triples.count(t) > 1 for t in triples) / len(triples), "symbol_share": text.count(b"#") / len(text),
        "punctuation_share": sum(text.count(bytes([m])) for m in b".,;:!?'\"()-") / len(text), "upper_share": 3 / letters, "digit_share": 3 / len(text),
        "space_share": sum(text.count(bytes([m])) for m in b" \n") / len(text), "wide_share": 2 / len(text), "alpha_word_share": sum(w.isalpha() for w in words) / len(words),
        "mean_line": len(words) / 4, "dup_line_share": 1 / 4, "dup_line_chars": len("The cat sat.") / len(text), "end_mark_share": 3 / 4, "bullet_share": 1 / 4,
        "byte_entropy": entropy([text.count(bytes([b])) for b in set(text)]), "word_entropy": entropy(list(counts.values())) / max(1.0, math.log2(len(words))),
    }
    assert len(lines) == 4 and set(got) == set(want)
    for name, value in want.items():
        assert abs(got[name] - value) < 1e-12, name
    assert quality_model.statistics(b" \n") == [0.0] * len(quality_model.FEATURES)
