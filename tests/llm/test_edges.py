"""Every operator over nulls, empty and very long texts, ties, repeated rows, empty tables and columns with clashing names."""

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from strandmix.llm import bpe, langid, licenses, ngram_join, packing, pii, quality_fm, quality_rules, suffixes, tiff, url_rules

LONG = "the word goes on and on " * 9000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, host string, key string, t int, node int, n int, rule_stats int, removed int, odd_id int, gram int"
ROWS = [
    (1, "one two three four five six seven", "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, None),
    (4, " \t\n", "de", "b"),
    (None, "one two three four five six seven", None, "a"),
    (None, None, None, None),
    (5, "one two three four five six seven", "en", "a"),
    (5, "one two three four five six seven", "en", "a"),
    (6, LONG, "en", "b"),
    (7, "ÄÖÜ 漢字 👍🏽 é \x00 \x1c x", "de", "b"),
    (8, "word", "en", "b"),
]


def table(spark, rows=ROWS):
    return spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None, *["x"] * 3, *[1] * 7) for r in rows], SCHEMA)


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, None), (None, 1, 1), (8, None, 0), (6, 0, 1), (4, 0, 0)], "doc_id long, quality int, toxic int")


WORD, BYTE, PIECE = (P.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
OPERATORS = {
    "ngram_join": lambda s, d: ngram_join.jaccard_join(d),
    "pii": lambda s, d: pii.find_pii(d),
    "tiff": lambda s, d: tiff.media_digests(d),
    "quality_rules": lambda s, d: quality_rules.judge(d),
    "licenses": lambda s, d: licenses.scan(d),
    "langid": lambda s, d: langid.identify(d, langid.train(d, PIECE), PIECE),
    "bpe": lambda s, d: bpe.encode_decode(d, BYTE, P.PATTERN),
    "quality_fm": lambda s, d: quality_fm.score(d, quality_fm.train(d, labels(s))),
    "suffixes": lambda s, d: suffixes.cut_repeats(d),
    "urls": lambda s, d: url_rules.filter_urls(s, d.withColumnsRenamed({"doc_id": "page_id", "text": "url"}), labels(s)).withColumnRenamed("page_id", "doc_id"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row(spark, name):
    got = OPERATORS[name](spark, table(spark)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in ROWS)
    same = [tuple(v for k, v in r.asDict().items()) for r in got if r.doc_id == 5]
    assert same[0] == same[1]


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    full = OPERATORS[name](spark, table(spark))
    none = OPERATORS[name](spark, table(spark, []))
    assert none.count() == 0 and none.columns == full.columns


def test_packing_of_edges(spark):
    got = packing.pack_documents(table(spark), WORD).collect()
    per = {}
    for r in got:
        per.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    assert set(per) == {r[0] for r in ROWS}
    assert per[2] == [(0, 1, 1)] and per[3] == [(0, 1, 1)]
    assert sum(x[1] for x in per[5]) == 2 * per[5][0][2]
    assert packing.pack_documents(table(spark, []), WORD).count() == 0


@pytest.mark.parametrize(
    "keep",
    [
        lambda s, d: quality_fm.keep_good(d, quality_fm.train(d, labels(s))),
        lambda s, d: quality_rules.keep_good(d),
        lambda s, d: ngram_join.keep_one(d),
        lambda s, d: pii.mask_pii(d, chars_col="n_chars"),
    ],
)
def test_stages_keep_the_columns(spark, keep):
    docs = table(spark)
    got = keep(spark, docs)
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    assert got.exceptAll(docs).count() == 0  # there is no personal data to mask
    assert keep(spark, table(spark, [])).count() == 0


def test_one_of_each_group_stays(spark):
    got = ngram_join.keep_one(table(spark)).collect()
    ids = [r.doc_id for r in got]
    assert ids.count(1) == 1 and 5 not in ids
    assert [r.text for r in got if r.doc_id is None] == [None]  # the other one without an id is a copy of document 1
    assert {2, 3, 4, 6, 7, 8} <= set(ids)


def test_repeated_id_with_other_text(spark):
    rows = [(9, "alpha beta gamma delta epsilon zeta", "en", "a"), (9, "quite another text of some seven words", "en", "a"), (None, "quite another text of some seven words", "en", "a"), (None, "a third text of six words", "en", "a")]
    rows += [rows[0], rows[3]]
    got = ngram_join.keep_one(table(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, rows[3][1]), (9, rows[0][1]), (9, rows[1][1])]


def test_null_columns_of_any_kind(spark):
    empty = table(spark).select(*(F.lit(None).cast(t).alias(c) for c, t in table(spark).dtypes))
    for run in OPERATORS.values():
        assert run(spark, empty).count() == len(ROWS)
