"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from gridloom.llm import chat_format, decontaminate, license_scan, line_dedup, lm_scoring, near_dedup, quality_rules, sentencepiece_codec, suffix_dedup, url_filter

PROSE = " ".join(f"word{i % 97}x{i % 13}" for i in range(120))
ROWS = [(1, None), (2, ""), (3, " \t\n "), (4, PROSE), (4, PROSE), (5, PROSE), (None, PROSE), (6, "one two"), (7, "ONE two"), (8, "é漢 \U0001f600 x" * 30), (9, "a" * 3000), (10, "\n".join([PROSE, "", PROSE]))]
#: Names that operators use themselves.
CLASH = "doc_id long, text string, kept boolean, node string, k long, d long, w string, band int, h int, score double, t string, words int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, True, "n", 1, 2, "w", 3, 4, 0.5, "t", 7) for i, t in ROWS], CLASH)


DOCUMENTS = {
    "op1": lambda d: suffix_dedup.strip(d),
    "op2": lambda d: lm_scoring.score(d),
    "op3": lambda d: license_scan.label(d),
    "op4": lambda d: near_dedup.groups(d),
    "op7": lambda d: sentencepiece_codec.digest(d),
    "op8": lambda d: line_dedup.report(d),
    "op9": lambda d: quality_rules.judge(d),
}


@pytest.mark.parametrize("op", DOCUMENTS)
def test_a_row_for_each_row(docs, op):
    got = DOCUMENTS[op](docs).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in ROWS)
    twice = [tuple(r) for r in got if r.doc_id == 4]
    assert twice[0] == twice[1]  # repeated rows get the same result


@pytest.mark.parametrize("op", DOCUMENTS)
def test_empty_table(docs, op):
    assert DOCUMENTS[op](docs.filter("false")).collect() == []


def test_suffix_dedup(docs):
    got = {r.doc_id: r for r in suffix_dedup.strip(docs).collect()}
    assert got[1].n_bytes == got[2].n_bytes == 0 and got[8].n_removed > 0
    assert got[4].n_removed == got[5].n_removed == got[10].n_bytes - 2 - len(PROSE) == len(PROSE)
    assert got[9].n_removed == 3000 and got[9].n_spans == 1 and got[9].kept == b""
    assert got[10].n_removed >= 2 * len(PROSE)


def test_near_dedup(docs):
    got = {(r.doc_id, r.n_shingles): r for r in near_dedup.groups(docs).collect()}
    assert got[(1, 0)].kept and got[(2, 0)].component_id == 2 and got[(3, 0)].kept
    assert {r.component_id for r in got.values() if r.doc_id in (4, 5, None)} == {4}
    assert got[(7, 1)].component_id == 6 and not got[(7, 1)].kept


def test_near_dedup_keeps_columns(docs):
    left = near_dedup.dedup(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect() if r.doc_id)[:3] == [1, 2, 3]


def test_lm_scoring(docs):
    got = {r.doc_id: r for r in lm_scoring.score(docs).collect()}
    assert got[None].held_out and got[1].n_tokens == got[3].n_tokens == 1
    assert got[6].n_tokens == 3 and got[6].base_score == got[7].base_score and got[6].score < 0


def test_license_scan(spark):
    d = spark.createDataFrame([(1, "Released under the MIT License."), (2, "mit-license mit  License"), (3, "Licensed under CC BY-NC 4.0."), (4, "summit license"), (5, "GNU General Public License, version 3, GENERAL public\nlicense"), (6, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.label(d).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].base_labels, got[1].score) == (1, 3, "mit", 1.0)
    assert (got[2].n_base, got[2].first_word, got[2].last_word) == (2, 0, 2)
    assert (got[3].n_base, got[3].base_labels, got[3].labels) == (0, "", "cc-by-nc")
    assert got[4].labels == "" and got[5].n_base == 2 and got[6].n_words == 0


def test_url_filter(spark):
    urls = ["http://a.net/x", "http://a.net", "https://www.Example.NET/en/p?utm_source=f", "http://example.com/de/1", "http://b.org/fr/", "HTTP://b.org:80/x/?b=2&a=1#t", "http://b.org/x?a=1&b=2&ref=y", None, "nothing", "http://notnet/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_filter.judge(pages, url_filter.repeated_urls(pages)).collect()}
    assert len(got) == len(urls)
    assert (got[0].rule, got[0].verdict) == ("net/", "block") and (got[1].rule, got[1].path) == (None, "")
    assert (got[2].host, got[2].rule, got[2].verdict) == ("www.example.net", "example.net/en/", "allow")
    assert got[3].verdict == "block" and got[4].rule == "org/fr/"
    assert got[5].verdict == got[6].verdict == "block" and got[5].listed  # one canonical url
    assert got[7].host == got[8].host == "" and got[8].verdict == "allow" and got[9].rule is None
    none = url_filter.judge(pages, spark.createDataFrame([], "canonical string")).filter("listed").count()
    assert none == 0 and url_filter.judge(pages.filter("false"), url_filter.repeated_urls(pages)).count() == 0


def test_bloom_passes_all_listed_and_few_others(spark):
    listed = spark.range(5000).selectExpr("concat('l', id) AS canonical")
    others = spark.range(5000).selectExpr("concat('o', id) AS canonical")
    filt = url_filter.bloom(listed, n_blocks=512)
    assert url_filter.possible(listed, filt, n_blocks=512).count() == 5000
    assert url_filter.possible(others, filt, n_blocks=512).count() < 500


def test_quality_rules(spark):
    clean = " ".join(f"plain{i}" for i in range(40))
    d = spark.createDataFrame([(1, clean), (2, "short text"), (3, clean + " ###" * 30), (4, "a b c d e f g h " * 10), (5, None), (6, "one two three four\n" * 9), (7, " ".join("wxyz"[i % 4] * 3 + str(i) for i in range(30)))], "doc_id long, text string")
    got = {r.doc_id: r for r in quality_rules.judge(d).collect()}
    assert [i for i in sorted(got) if got[i].kept] == [1, 7]
    assert (got[4].n_words, got[4].n_repeat_words) == (80, 80) and got[6].n_dup_lines == 8
    assert {r.doc_id for r in quality_rules.keep(d).collect()} == {1, 7}


def test_line_dedup(spark):
    a, b, c = ("x" * 120, "y" * 130, "z" * 140)
    d = spark.createDataFrame([(2, f"{a}\nown line\n{b}"), (1, f"{a}\n{b}"), (3, f"new\n{c}\nshort"), (4, f"{c}\nshort\nmore"), (5, "short\nother"), (6, f"{a}\n{b}")], "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.report(d).collect()}
    assert got[1].n_removed == got[3].n_removed == got[5].n_removed == 0
    assert got[2].kept_text == "own line" and got[4].kept_text == "more" and got[6].kept_text == ""
    assert sorted(r.doc_id for r in line_dedup.dedup(d).collect()) == [1, 2, 3, 4, 5]


def test_patience_diff():
    assert line_dedup.aligned([1, 2, 3, 4], [1, 9, 3, 4]) == [(0, 0), (2, 2), (3, 3)]
    assert line_dedup.aligned([5, 1, 6, 2], [1, 7, 2, 5]) == [(1, 0), (3, 2)]
    assert line_dedup.aligned([], [1]) == [] and line_dedup.aligned([1, 1, 1], [1, 1]) == [(0, 0), (1, 1)]


def test_decontamination(spark):
    item = " ".join(f"item{i}" for i in range(30))
    bench = spark.createDataFrame([(0, item), (1, None), (2, "few words"), (3, "")], "item_id long, text string")
    changed = item.replace("item29", "other").replace("item0 ", "else ")
    broken = " ".join(f"item{i}" if i % 6 else "gap" for i in range(30))
    d = spark.createDataFrame([(1, PROSE + " " + item.upper() + " " + PROSE), (2, PROSE + " " + changed), (3, broken), (4, None), (5, "Few Words"), (6, PROSE)], "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.search(d, bench).collect())
    assert got == [(1, 0), (2, 0), (5, 2)]
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.search(d, bench, block_items=1).collect()) == got
    assert sorted(r.doc_id for r in decontaminate.clean(d, bench).collect()) == [3, 4, 6]
    assert decontaminate.search(d, bench.filter("false")).count() == 0 and decontaminate.search(d.filter("false"), bench).count() == 0


def test_chat_format(spark):
    d = spark.createDataFrame([(1, 0, "system", "be"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 3, None, "<|im_end|>"), (1, 1, "ann", "hi"), (2, 0, "system", "x"), (None, 0, "cy", "z")], "conv_id long, turn long, role string, text string")
    got = chat_format.rotate(d).collect()
    assert {r.perspective for r in got if r.conv_id == 1} == {"ann", "bob", "unknown"} and not [r for r in got if r.conv_id == 2]
    ann = sorted((r for r in got if r.conv_id == 1 and r.perspective == "ann"), key=lambda r: r.char_start)
    text = "".join(r.segment for r in ann)
    assert len(ann) == 5 and all(text[r.char_start : r.char_end] == r.segment for r in ann)
    assert [text[r.mask_start : r.mask_end] for r in ann if r.trained] == ["hi<|im_end|>"] * 2
    assert "user name=bob\n<|im_end|>" in text and "<| im_end|>" in text
    small = chat_format.rotate(d, block_turns=1).collect()
    assert sorted(map(str, small)) == sorted(map(str, got))
    assert chat_format.rotate(d.filter("false")).count() == 0


def test_components_of_a_chain(spark):
    from gridloom.llm import graph

    edges = spark.range(60).select(F.format_string("%03d", F.col("id")).alias("a"), F.format_string("%03d", F.col("id") + 1).alias("b")).filter("id <> 30")
    got = {r.node: r.root for r in graph.components(edges).collect()}
    assert len(got) == 61 and {got["000"], got["030"]} == {"000"} and got["060"] == "031"
